"""Every registered query against its DuckDB oracle on the smallest tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from slantscan.plans import registry
from slantscan.sources.tables import TABLES

from conftest import SF_SMALL


def canon(df):
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False):
        vals = []
        for v in rec:
            if v is None or (isinstance(v, float) and v != v):
                vals.append("NULL")
            elif isinstance(v, float):
                vals.append(repr(round(v, 9)))
            elif hasattr(v, "item"):
                vals.append(repr(v.item()))
            else:
                vals.append(repr(v))
        rows.append("|".join(vals))
    return len(df), cols, hashlib.md5("\n".join(sorted(rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and {"is_biased", "confidence", "explanation", "alternative"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = duck.execute(E.oracle_sql()[name]).df()
    assert canon(sp) == canon(dk)
