"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, normal

SF = "/root/testdata/sf0.001"
CHECKED = ["replace_nondetects", "exceedance_rates", "km_summary", "gehan_test", "censored_trend",
           "heatmap_cells", "derived_hardness", "enrich_lookups", "partition_fractions", "qq_normal"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"parameter", "acute_pct"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(normal(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want
