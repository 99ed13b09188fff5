"""Near matches against comparing every window with every query."""

import math
import random

import pytest

from cohortlens.operators import search as S


def plainly(queries, texts, mismatches, anchors, similar, fraction):
    out = []
    for q in {q for q in queries if q is not None and len(q) > mismatches}:
        for key, t in texts:
            for p in range(len(t or "") - len(q) + 1):
                w = t[p : p + len(q)]
                same = [a == b for a, b in zip(q, w)]
                close = [s or any(a in g and b in g for g in similar) for s, a, b in zip(same, q, w)]
                if sum(same) < len(q) - mismatches or (similar and sum(close) < math.ceil(fraction * len(q))):
                    continue
                if all(same[(len(q) if a == -1 else a) - 1] for a in anchors if a == -1 or a <= len(q)):
                    out.append((q, key, p, w, sum(same), "exact" if all(same) else "near"))
    return sorted(out, key=str)


@pytest.mark.parametrize("mismatches, anchors, similar, fraction", [(2, (2, -1), (), 1.0), (2, (2, -1), ("ab", "cd☃"), 1.0), (1, (), ("abc",), 0.8), (0, (1,), (), 1.0), (3, (9, -1), ("ad", "bd"), 0.5)])
def test_near_matches_equal_all_windows(spark, monkeypatch, mismatches, anchors, similar, fraction):
    r = random.Random(mismatches)
    word = lambda n: "".join(r.choice("abcd☃🤷") for _ in range(n))
    queries = [word(r.randint(1, 9)) for _ in range(40)] + [None, "", "abcabc", "abcabc"]
    texts = [(k, word(r.randint(0, 120))) for k in range(25)] + [(90, None), (91, ""), (92, "abcabcabc"), (92, "abcabcabc"), (None, "abcabc")]
    texts += [(100 + k, q[:1] + "a" + q[2:]) for k, q in enumerate(queries) if q]
    want = plainly(queries, texts, mismatches, anchors, similar, fraction)
    q = spark.createDataFrame([(x,) for x in queries], "q string")
    db = spark.createDataFrame([(k, t, "x") for k, t in texts], "k int, t string, query string").repartition(3)
    for letters in (4_000_000, 60):
        monkeypatch.setattr(S, "QUERY_LETTERS", letters)
        got = S.near_matches(q, db, "q", "k", "t", mismatches, anchors, similar, fraction)
        assert got.columns == ["query", "k", "at", "found", "identities", "tier"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert want and S.near_matches(q.limit(0), db, "q", "k", "t").count() == 0 and S.near_matches(q, db.limit(0), "q", "k", "t").count() == 0
