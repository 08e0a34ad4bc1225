"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import math

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql
from quire.plans.catalog import QUERIES
from quire.sources.tables import TABLES
from tests.conftest import SF_SMALL

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def norm(df: pd.DataFrame):
    cols = sorted(df.columns)

    def v(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT:
            return None
        if isinstance(x, float):
            return round(x, 6)
        if hasattr(x, "isoformat"):
            return str(pd.Timestamp(x))
        return x
    out = [tuple(v(r[c]) for c in cols) for r in df.to_dict("records")]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(oracle_sql())
    assert not missing


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["doc_id", "version", "updated_at", "updated_by", "deals"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    gc, gr = norm(got)
    wc, wr = norm(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
