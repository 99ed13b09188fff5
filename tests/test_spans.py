"""Range joins with levels of bins, and kinship by bit words, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import graph as G, intervals as I


def random_intervals(seed, n, longest):
    rng = np.random.default_rng(seed)
    length = np.exp(rng.uniform(0, np.log(longest), n)).astype(int)
    return [("c" if k % 4 else "d" if k % 8 else None, int(s), int(s + w), k) for k, (s, w) in enumerate(zip(rng.integers(0, 2_000_000, n), length))]


@pytest.mark.parametrize("width", [1, 64, 5000])
def test_pairs_of_intervals_of_all_lengths(spark, width):
    a = random_intervals(1, 250, 1_500_000) + [("c", 5, 5, 900), ("c", 9, 3, 901), ("c", 0, 3_000_000, 902), ("c", 64, 128, 903)]
    b = random_intervals(2, 250, 40_000) + [("c", 128, 192, 900), ("c", 127, 128, 901), ("c", 7, 7, 902), ("d", 0, 10**12, 903)]
    schema = "contig string, s long, e long, k long"
    got = I.overlap_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), width=width)
    found = sorted((r["k"], r["b_k"]) for r in got.collect())
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[2] > x[1] and y[2] > y[1] and x[1] < y[2] and y[1] < x[2])
    assert found == want
    assert I.overlap_pairs(spark.createDataFrame([], schema), spark.createDataFrame(b, schema)).count() == 0


def test_a_long_region_makes_few_rows(spark):
    rows = spark.createDataFrame([(0, 1_000_000), (123, 1_000_123), (7, 8)], "s long, e long")
    every = [(1, k, I._level(F.col("s"), F.col("e"), 64) <= k) for k in range(I.TOP_LEVEL + 1)]
    n = rows.withColumn("at", I._places(F.lit(0), F.col("s"), F.col("e"), 64, every)).groupBy("s", "e").count().collect()
    assert all(r["count"] < 40 for r in n)


def test_merged_and_masked_positions_need_no_contig_window(spark):
    sequences = spark.createDataFrame([("c", "ACGT" * 5000)], "contig string, seq string")
    masked = spark.createDataFrame([("c", 10, 20), ("c", 15, 9000), ("c", 9000, 9001), ("c", 30, 25), ("c", -4, 3)], "contig string, s long, e long")
    out = I.mask_intervals(sequences, masked, "contig", "seq", chunk=512).orderBy("s").collect()
    text = "".join(r["seq"] for r in out)
    assert text == "".join("N" if 10 <= k < 9001 else x for k, x in enumerate("ACGT" * 5000)) and sum(r["n_masked"] for r in out) == 8991


@pytest.mark.parametrize("tile, each", [(128, 64), (3, 1)])
def test_kinship_equals_all_pairs(spark, monkeypatch, tile, each):
    monkeypatch.setattr(G, "TILE", tile)
    monkeypatch.setattr(G, "BLOCKS_EACH", each)
    monkeypatch.setattr(G, "BLOCK_SITES", 70)
    rng = np.random.default_rng(8)
    d = rng.integers(-1, 3, (10, 300))
    d[9] = -1  # a sample without a call
    d[8, :] = np.where(np.arange(300) < 5, 0, -1)
    rows = [(f"s{i}", j, None if d[i, j] < 0 else int(d[i, j])) for i in range(10) for j in range(300)] + [(None, 3, 1)]
    got = {(r["a"], r["b"]): r for r in G.pairwise_kinship(spark.createDataFrame(rows, "s string, k int, d int").repartition(5), "s", "k", "d", least=None).collect()}
    for i in range(10):
        for j in range(i + 1, 10):
            x, y = d[i], d[j]
            both = (x >= 0) & (y >= 0)
            if not both.any():
                assert (f"s{i}", f"s{j}") not in got
                continue
            r = got.pop((f"s{i}", f"s{j}"))
            hx, hy = ((x == 1) & both).sum(), ((y == 1) & both).sum()
            hh, o, m = ((x == 1) & (y == 1)).sum(), (np.abs(x - y)[both] == 2).sum(), min(hx, hy)
            assert (r["n_sites"], r["het_het"], r["opposite"]) == (both.sum(), hh, o)
            assert r["kinship"] is None if m == 0 else abs(r["kinship"] - ((hh - 2 * o) / (2 * m) + 0.5 - (hx + hy) / (4 * m))) < 1e-12
    assert not got
