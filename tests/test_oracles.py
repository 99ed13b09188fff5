"""Every registered cohort query with an oracle, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cohortlens import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return str([str(y) for y in x])
        if x is None or (isinstance(x, (float, np.floating)) and np.isnan(x)) or x is pd.NA:
            return ""
        if isinstance(x, (bool, np.bool_)):
            return str(float(x))
        if isinstance(x, (int, float, np.integer, np.floating)):
            return f"{float(x):.8f}".replace("-0.00000000", "0.00000000")
        return str(x)

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
