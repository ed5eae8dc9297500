"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math

import duckdb
import pytest

from trailmark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else v.item() if hasattr(v, "item") else v
    found = [tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(found, key=lambda r: tuple((v is None, isinstance(v, str), str(v) if isinstance(v, str) else v or 0) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        wanted = con.sql(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
