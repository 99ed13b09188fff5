"""Properties and traps of the cohort operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import aggregate as A, enrich as E, graph as G, intervals as I, mapping as M, ranking as R, search as Q, sets as T


def test_components_do_not_depend_on_edge_order(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    for some in (edges, edges[::-1]):
        got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(some, "src long, dst long")).collect()}
        assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 200: 200}
    assert G.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def merged_plainly(rows):
    """(contig, start, end, names) of merged intervals, one after the other."""
    out = []
    for c, s, e, name in sorted((r for r in rows if r[2] > r[1]), key=lambda r: (str(r[0]), r[1], r[2])):
        if out and out[-1][0] == c and s <= out[-1][2]:
            out[-1] = (c, out[-1][1], max(out[-1][2], e), out[-1][3] | {name})
        else:
            out.append((c, s, e, {name}))
    return out


def test_merged_intervals_equal_a_plain_sweep(spark):
    rng = np.random.default_rng(1)
    n = 300
    rows = [("c" if k % 3 else "d" if k % 2 else None, int(s), int(s + w), "ABC"[k % 3] if k % 7 else None) for k, (s, w) in enumerate(zip(rng.integers(0, 3000, n), rng.integers(0, 12, n)))]
    rows += [("c", 5, 900, "long"), ("d", 2, 2950, "A"), ("c", 5, 5, "empty"), ("c", 9, 3, "bad"), rows[0]]
    df = spark.createDataFrame(rows, "contig string, s long, e long, name string").repartition(3)
    want = merged_plainly(rows)
    key = lambda r: tuple(str(x) for x in r)
    for block in (1, 16, 1 << 16):
        got = [tuple(r) for r in I.merge_intervals(df, ["contig"], block=block).collect()]
        assert sorted(got, key=key) == sorted([w[:3] for w in want], key=key)
        named = [(r["contig"], r["s"], r["e"], r["name"]) for r in I.merge_intervals(df, ["contig"], block=block, name="name").collect()]
        assert sorted(named, key=key) == sorted([(*w[:3], x) for w in want for x in w[3]], key=key)
    assert I.merge_intervals(df.limit(0), ["contig"], name="name").count() == 0
    two = spark.createDataFrame([("c", 0, 10, "A"), ("c", 5, 20, "B")], "contig string, s long, e long, name string")
    assert sorted(map(tuple, I.merge_intervals(two, ["contig"], name="name").select("s", "e", "name").collect())) == [(0, 20, "A"), (0, 20, "B")]


def test_range_joins_have_no_cartesian_plan(spark):
    df = spark.createDataFrame([("c", 0, 100), ("c", 50, 150), ("d", 1, 2)], "contig string, s long, e long")
    t = I.overlap_pairs(df, df, width=16)
    assert t.count() == 5
    plan = t._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bh_is_monotone_and_equals_the_definition(spark):
    rng = np.random.default_rng(2)
    p = [*rng.random(50).round(2), None]
    rows = [(k, None if x is None else float(x)) for k, x in enumerate(p)]
    got = {r["k"]: r["padj"] for r in R.bh_adjust(spark.createDataFrame(rows, "k int, p double"), "p").collect()}
    order = sorted((x, k) for k, x in rows if x is not None)
    least = 1.0
    for i in range(len(order) - 1, -1, -1):
        least = min(least, order[i][0] * len(order) / (i + 1))
        assert math.isclose(got[order[i][1]], least) or order[i][0] == order[min(i + 1, len(order) - 1)][0]
    assert got[50] is None


def test_mirrored_ranking_has_the_opposite_score(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=60)
    sets = spark.createDataFrame([(1, int(g)) for g in rng.choice(60, 25, False)], "s int, g int")
    es = []
    for sign in (1, -1):
        df = spark.createDataFrame([(0, k, float(sign * x)) for k, x in enumerate(z)], "d int, g int, stat double")
        ranked = R.rank_desc(df, "d", "stat", "g")
        row = E.enrichment_score(ranked, sets, ["d"], "s", "g").first()
        es.append(row["es"])
        assert row["leading_edge"]
    assert math.isclose(es[0], -es[1])


def test_enrichment_test_and_collapse_without_keys(spark):
    rng = np.random.default_rng(5)
    ranked = R.rank_desc(spark.createDataFrame([(0, k, float(x)) for k, x in enumerate(rng.normal(size=200))], "d int, g int, stat double"), "d", "stat", "g").drop("d")
    sets = spark.createDataFrame([(s, int(g)) for s in range(3) for g in rng.choice(200, 30, False)], "s int, g int")
    tested = E.enrichment_test(ranked, sets, [], "s", "g", n_perm=40)
    assert all(0 < r["pval"] <= 1 and r["padj"] >= r["pval"] - 1e-12 for r in tested.collect())
    kept = {r["s"]: r["kept"] for r in E.collapse_sets(tested, ranked, sets, "s", "g", n_perm=40).collect()}
    assert len(kept) == 3 and any(kept.values())


def test_enrichment_nulls_of_long_rankings(spark):
    n = 250_000
    ranked = spark.range(n).select(F.lit(0).alias("d"), F.col("id").alias("g"), (n / 2 - F.col("id")).alias("stat"), (F.col("id") + 1).cast("int").alias("rank"))
    sets = spark.createDataFrame([(1, g) for g in range(0, 3000, 100)] + [(2, g) for g in range(50, n, n // 40)], "s int, g long")
    got = {r["s"]: r for r in E.enrichment_test(ranked, sets, ["d"], "s", "g", n_perm=60).collect()}
    assert set(got) == {1, 2} and got[1]["pval"] < 0.05 < got[2]["pval"]


def test_hwe_exact():
    p = G.hwe_p([0, 57, 50], [0, 14, 25], [0, 50, 25])
    assert p[0] == 1 and math.isclose(p[1], 0.8422798, rel_tol=1e-3) and p[2] > 0.9


def test_correlation_p_value(spark):
    rows = [(0, float(k), float(k % 4)) for k in range(12)] + [(1, 1.0, 2.0)] * 5 + [(2, 1.0, 2.0)]
    got = {r["k"]: (r["r"], r["p"]) for r in E.group_correlation(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").collect()}
    r, n = np.corrcoef(*zip(*[(a, b) for k, a, b in rows if k == 0]))[0, 1], 12
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    grid = np.linspace(t, 400, 2_000_001)
    density = math.gamma(5.5) / math.sqrt(10 * math.pi) / math.gamma(5) * (1 + grid**2 / 10) ** -5.5
    assert math.isclose(got[0][0], r) and math.isclose(got[0][1], 2 * float(((density[1:] + density[:-1]) / 2 * np.diff(grid)).sum()), rel_tol=1e-4)
    assert got[1] == (None, None) and got[2] == (None, None)


def test_kinship_of_identical_samples(spark):
    rows = [(s, k, k % 3) for s in ("a", "b") for k in range(12)]
    assert G.pairwise_kinship(spark.createDataFrame(rows, "s string, k int, d int"), "s", "k", "d").first()["kinship"] == 0.5


def test_strict_mapping_raises(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    with pytest.raises(ValueError, match="b"):
        M.strict_map(df, "x", {"a": "A"}, "y")
    with pytest.raises(ValueError):
        M.expectations(df, {"known": F.col("x").isNotNull()})
    with pytest.raises(ValueError):
        Q.explode_positional(spark.createDataFrame([("1,2",)], "v string"), [], "v", ["a"])


def test_scalar_edges(spark):
    df = spark.createDataFrame([("0/1", "5,5", "10"), ("./1", "5", "0"), (None, None, None)], "gt string, ad string, dp string")
    got = df.select(S.carries_alt("gt"), S.not_reference("gt"), S.allele_fraction("ad", "dp")).collect()
    assert [tuple(r) for r in got] == [(True, True, 0.5), (False, True, None), (False, False, None)]
    nan = spark.createDataFrame([(float("nan"), 1.0), (None, None)], "a double, b double")
    assert [r[0] for r in nan.select(S.row_max_ignore_null("a", "b")).collect()] == [1.0, None]


def test_specificity_of_two_classes(spark):
    df = spark.createDataFrame([("g", "a", 3.0), ("h", "b", 1.0)], "g string, c string, v double")
    got = {r["g"]: (r["log2_ratio"], r["higher_in"]) for r in A.specificity(df, "g", "c", "v", ["b", "a"]).collect()}
    assert got == {"g": (2.0, "a"), "h": (-1.0, "b")}


def test_communities_and_hubness(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], "set_a string, set_b string, similarity double")
    nodes = spark.createDataFrame([(c,) for c in "abcxyz"], "s string")
    got = {r["s"]: r["community"] for r in G.similarity_graph(edges, nodes, "s").collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] and got["z"] == "z"
    sig = spark.createDataFrame([("s1", "g"), ("s1", "h"), ("s2", "g"), ("s2", "h"), ("s3", "g")], "s string, g string")
    hub = {r["g"]: (r["n_signatures"], r["n_components"]) for r in T.hubness(sig, spark.createDataFrame([("g",), ("k",)], "g string"), "s", "g", 0.9).collect()}
    assert hub == {"g": (3, 2), "k": (0, 0)}


def test_low_complexity_filter_equals_brute_force(spark):
    from collections import Counter
    from math import log2
    from random import Random

    from cohortlens.operators.search import low_complexity_filter

    r = Random(3)
    reads = [(k, k // 2, "".join(r.choice("ACGT"[: 1 + k % 4]) for _ in range(r.choice([10, 19, 20, 80, 700])))) for k in range(60)] + [(90, 45, "AC" * 30), (91, 45, "A" * 40), (92, 46, None)]

    def entropy(s):
        if s is None or len(s) < 20:
            return None
        windows = [s[i : i + 20] for i in range(len(s) - 19)]
        one = lambda w: -sum(v / 16 * log2(v / 16) for v in Counter(w[j : j + 5] for j in range(16)).values()) / 4
        return sum(map(one, windows)) / len(windows)

    score = {k: entropy(s) for k, _, s in reads}
    passed = lambda k: score[k] is None or score[k] >= 0.7
    df = spark.createDataFrame(reads, "k int, name int, seq string")
    for both, test in ((True, any), (False, all)):
        got = {x["k"]: x["entropy"] for x in low_complexity_filter(df, "k", "name", "seq", both=both).collect()}
        want = {k for k, name, _ in reads if test(passed(j) for j, n, _ in reads if n == name)}
        assert set(got) == want and all((got[k] is None) == (score[k] is None) and (got[k] is None or abs(got[k] - score[k]) < 1e-9) for k in want)
