"""Importance resampling against a plain computation: nulls, long words, line ends, ties, repeated rows, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import resampling

DOCS = "doc_id long, text string, weight string, rank string, __n string, bucket string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    out = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(*r, k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
    return out, drawn


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcDEé☃9") for _ in range(r.randint(1, 9))) for _ in range(200)] + ["x" * 64, "y" * 65, "Z" * 300, "🤷" * 40]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))
    common = [line() for _ in range(5)]
    base = ["\n".join(r.choice(common) if r.random() < 0.4 else line() for _ in range(r.randint(1, 6))) for _ in range(120)]
    return [*base, *base[:9], None, "", "\n\n", "one", "One\ntwo", "a\n \n!\nb", "\nx y\n", "tab\tcr\rnul\x00 end", " ".join(r.choice(vocabulary) for _ in range(30_000))]


def test_equals_a_plain_computation(spark, texts):
    rows = [(k // 2 if 40 < k < 60 else None if k in (7, 9) else k, t) for k, t in enumerate(texts)]
    target = [texts[3], texts[5], None, "", "brand new words"]
    docs = spark.createDataFrame([(*r, "w", "r", "n", "b") for r in rows], DOCS).repartition(4)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "__n", "bucket", "n_words", "n_features", "weight", "score", "rank"]
    got = [(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()]
    want, drawn = plain(rows, target)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([r[:5] for r in got], key=order) == sorted(want, key=order)
    assert sorted((r for r in got if r[5] is not None), key=lambda r: r[5]) == drawn


def test_crcs_of_words_and_pairs():
    texts = ["a bb " + "c" * 70 + " d " + "e" * 64 + " " + "f" * 65 + " " + "g" * 1000 + " h", "é ☃"]
    words, _ = resampling.lower_words(pa.array(texts))
    crcs = resampling.word_crcs(words)
    flat = [w for t in texts for w in t.split()]
    assert crcs.tolist() == [zlib.crc32(w.encode()) for w in flat]
    second = np.arange(1, len(flat))
    assert resampling.pair_crcs(words, crcs, second).tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(flat, flat[1:])]


def test_segments_count_what_whole_texts_hold(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter(zlib.crc32(f.encode()) % 997 for t in texts for f in features(t)[1])
    got = resampling.bucket_counts(rows, "text", 997)
    assert got.tolist() == [want[b] for b in range(997)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    got = resampling.resample(some, none, least_words=1, percent=100).collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(3, 1)]
    assert resampling.resample(some, none, least_words=3).where(F.col("rank").isNotNull()).count() == 0
