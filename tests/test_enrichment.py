"""Enrichment nulls against plain computations: draws, small p values, left-out genes, collapsed sets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import enrich as E, nulls as N, ranking as R


def running_sum(rank, stat):
    """Score of a set of places (from 0) in a ranking, by the whole walk."""
    hit = np.isin(np.arange(len(stat)), rank)
    miss = len(stat) - hit.sum()
    walk = np.append(np.cumsum(np.where(hit, np.abs(stat) / np.abs(stat)[hit].sum(), -1 / miss if miss else 0)), 0.0)
    top, bottom = walk.max(), min(walk.min(), 0)
    return top if top > -bottom + 1e-12 else bottom if top < -bottom - 1e-12 else 0.0


def plain_p(es, stat, size, most, n_perm, seed):
    null = np.array([running_sum(np.random.default_rng([seed, d]).choice(len(stat), most, replace=False)[:size], stat) for d in range(n_perm)])
    same = null[null >= 0] if es >= 0 else null[null < 0]
    return (1 + (np.abs(same) >= abs(es)).sum()) / (1 + len(same)), es / np.abs(same).mean() if len(same) else None


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(12)
    stat = np.sort(rng.normal(size=120))[::-1]
    members = {s: sorted(int(g) for g in rng.choice(120, int(rng.integers(8, 25)), replace=False)) for s in range(8)}
    members[8], members[9] = sorted({*members[0], 1, 2}), list(range(0, 12))
    members[10] = list(range(0, 20))
    ranked = spark.createDataFrame([(g, float(x), g + 1) for g, x in enumerate(stat)], "g int, stat double, rank int").repartition(3).cache()
    sets = spark.createDataFrame([(s, g) for s, all_of in members.items() for g in all_of], "s int, g int").repartition(3).cache()
    return stat, members, ranked, sets


def test_scores_of_draws_equal_the_running_sum():
    rng = np.random.default_rng(3)
    stat = rng.normal(size=50)
    ranks = np.stack([rng.choice(50, 12, replace=False) for _ in range(20)])
    for size in (1, 5, 12):
        got = N.null_scores(ranks + 1, np.abs(stat)[ranks], 50, size)
        assert np.allclose(got, [running_sum(r[:size], stat) for r in ranks], atol=1e-12)


def test_ranks_without_some_others():
    for removed in ([], [1], [3, 4, 9], [10, 9, 8][::-1], list(range(1, 9))):
        rest = [r for r in range(1, 11) if r not in removed]
        assert N.original_ranks(np.arange(1, len(rest) + 1), np.array(removed, dtype=np.int64)).tolist() == rest


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_p_values_equal_plain_draws(spark, case, monkeypatch, chunk):
    stat, members, ranked, sets = case
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "DRAWS", 16)
    keyed = ranked.withColumn("d", F.lit(None).cast("int")).unionByName(ranked.withColumn("d", F.lit(1))).where("d = 1")
    got = {r["s"]: r for r in E.enrichment_test(keyed, sets, ["d"], "s", "g", n_perm=50, seed=4, least=1, few=0).collect()}
    most = max(map(len, members.values()))
    assert set(got) == set(members)
    for s, all_of in members.items():
        es = running_sum(all_of, stat)
        p, nes = plain_p(es, stat, len(all_of), most, 50, 4)
        assert math.isclose(got[s]["es"], es, abs_tol=1e-9) and math.isclose(got[s]["pval"], p) and math.isclose(got[s]["nes"], nes, rel_tol=1e-9)


def test_small_p_values_by_splitting_equal_all_sets():
    n, k = 50, 5
    stat = np.sort(np.random.default_rng(5).normal(size=n))[::-1]
    every = np.array(list(itertools.combinations(range(n), k)))
    score = np.concatenate([N._scores_of(part + 1, np.abs(stat)[part], n) for part in np.array_split(every, 50)])
    for sign in (1, -1):
        s = np.sort(sign * score)[::-1]
        targets = np.array([s[1], s[20], s[2000], s[200_000]])
        exact = np.array([(s >= t - 1e-12).mean() for t in targets])
        got = N.split_tail(np.abs(stat), np.arange(1, n + 1), n, k, sign, targets - 1e-12, 801, 3, 1e-50)
        assert exact[0] < 2e-6 and (np.abs(np.log(got / exact)) < math.log(2)).all(), (got, exact)


def test_small_p_values_have_no_floor(spark):
    n, k = 50, 5
    stat = np.sort(np.random.default_rng(5).normal(size=n))[::-1]
    every = np.array(list(itertools.combinations(range(n), k)))
    score = np.concatenate([N._scores_of(part + 1, np.abs(stat)[part], n) for part in np.array_split(every, 50)])
    best, usual = every[np.argmax(score)], every[np.argsort(score)[int(len(score) * 0.7)]]
    ranked = spark.createDataFrame([(g, float(x), g + 1) for g, x in enumerate(stat)], "g int, stat double, rank int")
    sets = spark.createDataFrame([(name, int(g)) for name, all_of in (("best", best), ("usual", usual)) for g in all_of], "s string, g int")
    got = {r["s"]: r for r in E.enrichment_test(ranked, sets, [], "s", "g", n_perm=300, least=1, chains=401).collect()}
    up = score[score > 0]
    for name, all_of in (("best", best), ("usual", usual)):
        es = running_sum(all_of, stat)
        exact = (up >= es - 1e-9).mean()
        assert abs(math.log(got[name]["pval"] / exact)) < math.log(2), (name, got[name]["pval"], exact)
    assert got["best"]["pval"] < 1e-5 < 1 / 301


def test_a_left_out_gene_equals_a_ranking_without_it(spark, case):
    stat, members, ranked, sets = case
    candidates = spark.createDataFrame([(0,), (60,), (999,)], "g int")
    got = {(r["left_out"], r["s"]): r for r in E.leave_one_out(ranked, sets, candidates, "s", "g", n_perm=40, least=1, few=0).collect()}
    for gone in (0, 60, 999):
        rest = ranked.where(F.col("g") != gone)
        plain = E.enrichment_test(R.rank_desc(rest.withColumn("d", F.lit(1)), "d", "stat", "g"), sets.where(F.col("g") != gone), ["d"], "s", "g", n_perm=40, least=1, few=0)
        for r in plain.collect():
            one = got.pop((gone, r["s"]))
            assert one["size"] == r["size"] and one["leading_edge"] == r["leading_edge"]
            assert all(math.isclose(one[c], r[c], rel_tol=1e-9, abs_tol=1e-12) for c in ("es", "pval", "nes", "padj"))
    assert not got


def test_collapsed_sets_equal_rankings_made_anew(spark, case):
    stat, members, ranked, sets = case
    n_perm, limit = 60, 0.2
    tested = E.enrichment_test(ranked, sets, [], "s", "g", n_perm=n_perm, least=1, few=0)
    order = [r["s"] for r in sorted(tested.collect(), key=lambda r: (r["pval"], r["s"]))]
    p_of = {}
    for parent in order:
        later = [s for s in order[order.index(parent) + 1 :] if {*members[s]} & {*members[parent]}]
        for side in (True, False):
            genes = [g for g in range(len(stat)) if (g in members[parent]) == side]
            part = {s: [genes.index(g) for g in members[s] if (g in members[parent]) == side] for s in later}
            part = {s: x for s, x in part.items() if x}
            most = max(map(len, part.values()), default=0)
            for s, places in part.items():
                p_of.setdefault((parent, s), []).append(plain_p(running_sum(places, stat[genes]), stat[genes], len(places), most, n_perm, 1)[0])
    kept = []
    for s in order:
        if not any((q, s) in p_of and min(p_of[q, s]) > limit for q in kept):
            kept.append(s)
    got = E.collapse_sets(tested, ranked, sets, "s", "g", p=limit, n_perm=n_perm)
    assert "Cartesian" not in got._jdf.queryExecution().toString()
    assert {r["s"]: r["kept"] for r in got.collect()} == {s: s in kept for s in order}
    assert 1 < len(kept) < len(order)


def test_places_over_all_rows(spark):
    rows = [(k, float(k % 7)) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(6)
    got = R.rank_over_all(df, [F.col("x").desc(), F.col("k")]).orderBy("rank").collect()
    assert [(r["k"], r["rank"]) for r in got] == [(k, i + 1) for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]
    assert R.rank_over_all(df.limit(0), [F.col("x")]).count() == 0
