"""Every registered query of the rest of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from pingframe.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="last", kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(name, spark, db):
    """Those without SQL are in test_brute.py."""
    got = ordered(registry.QUERIES[name](spark, SF).toPandas())
    want = ordered(db.execute(registry.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got:
        a, b = got[c], want[c]
        both_null = a.isna() & b.isna()
        if a.dtype.kind == "f":
            same = np.isclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9)
        else:
            same = a == b
        assert (same | both_null).all(), (c, a[~(same | both_null)].head(3).tolist(), b[~(same | both_null)].head(3).tolist())
