"""Operators over ranges of the whole table: order statistics, bins, strata, flags, sweeps; and their plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import aggregate as A, enrich as E, ranking as R

VALUES = [3.0, 1.0, 1.0, None, float("nan"), 7.5, 1.0, -2.0, 9.0, 9.0]


@pytest.mark.parametrize("values", [VALUES, [5.0], [2.0, 2.0, 2.0], np.random.default_rng(1).normal(size=501).round(2).tolist()])
def test_order_statistics_equal_numpy(spark, values):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").repartition(3)
    known = [x for x in values if x is not None and not math.isnan(x)]
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    assert np.allclose(R.order_statistics(rows, F.col("x"), shares), np.quantile(known, shares))
    breaks = R.quantile_breaks(rows, "x", 4).first()["breaks"]
    assert np.allclose(breaks, list(dict.fromkeys(np.quantile(known, [0, 0.25, 0.5, 0.75, 1]))))


def test_order_statistics_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert R.order_statistics(rows, F.col("x"), [0.5, 1]) == [None, None]
    assert R.quantile_breaks(rows, "x", 4).first()["breaks"] == []
    assert [r["high"] for r in A.qc_flags(rows, "x").collect()] == [None, None]


def test_flags_equal_the_definition(spark):
    rows = spark.createDataFrame([(k, None if x is None else str(x)) for k, x in enumerate([*VALUES, 400.0])] + [(99, "n/a")], "k int, x string").repartition(3)
    known = np.array([x for x in [*VALUES, 400.0] if x is not None and not math.isnan(x)])
    middle = np.median(known)
    most = middle + 3 * np.median(np.abs(known - middle))
    got = {r["k"]: r["high"] for r in A.qc_flags(rows, "x").collect()}
    assert got == {**{k: None if x is None or math.isnan(x) else x > most for k, x in enumerate([*VALUES, 400.0])}, 99: None} and got[10]


def test_bins_over_all_equal_bins_of_one_group(spark):
    rows = spark.createDataFrame([(k, (k * 37) % 11 if k % 9 else None, 1) for k in range(205)], "k int, x int, one int").repartition(5)
    got, want = R.equal_frequency_bins(rows, "k", "x", 10, 7), R.equal_frequency_bins(rows, "k", "x", 10, 7, by=["one"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_totals(spark):
    rows = [(k % 3 if k % 7 else None, k, (k * 5) % 13) for k in range(200)]
    got = R.running_totals(spark.createDataFrame(rows, "g int, o int, v long").repartition(4), ["g"], "o", "v", "upto", "total").collect()
    for r in got:
        same = [x for x in rows if x[0] == r["g"]]
        assert r["upto"] == sum(v for _, o, v in same if o <= r["o"]) and r["total"] == sum(v for *_, v in same)
    assert len(got) == 200


def test_matched_nulls_equal_counting(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(0, 3)) if k % 31 else None, float(rng.integers(0, 30) / 30) if k % 11 else None, bool(k % 5 == 0)) for k in range(300)]
    out = E.matched_null_test(spark.createDataFrame(rows, "g int, s int, p double, c boolean").repartition(4), "g", "s", "p", "c", least_pool=40)
    got = {r["g"]: r for r in out.collect()}
    asked = [r for r in rows if r[3] and r[2] is not None]
    assert set(got) == {r[0] for r in asked}
    for g, s, p, _ in asked:
        pool = [r[2] for r in rows if r[1] == s and not r[3] and r[2] is not None]
        n = sum(x <= p for x in pool)
        assert (got[g]["n_le"], got[g]["pool"], got[g]["small_pool"]) == (n, len(pool), len(pool) < 40)
        assert math.isclose(got[g]["p_matched"], (1 + n) / (1 + len(pool)))
