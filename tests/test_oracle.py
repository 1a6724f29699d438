"""The correctness gate: every registered query against its DuckDB oracle at
sf0.01 (row count, column names, order-insensitive values), plus entry()."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from wavelake.plans import catalog
from wavelake.plans.tables import TABLES

from conftest import SF_ORACLE


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


_TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["result_id", "sample_index", "frequency_hz", "magnitude", "phase"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_ORACLE)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in sdf.schema.fields:
        assert _TYPE_MAP.get(f.dataType.simpleString()) == duck_types[f.name], f.name
    assert len(s_rows) == len(d_rows)
    assert _bag(sdf.columns, s_rows) == _bag(rel.columns, d_rows)
