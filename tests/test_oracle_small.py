"""A sample of registered queries against their DuckDB SQL at sf0.001."""
import collections

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "pages documents events".split()
KEYS = ["scan_body", "scan_headers", "scan_strict", "findings_dedupe", "top_patterns_10", "report_rows",
        "link_resolve", "robots_filter", "crawl_order", "missing_headers", "scan_summary", "sink_html"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("key", KEYS)
def test_against_duckdb(spark, con, key):
    df = E.queries()[key](spark, SF)
    cols = sorted(df.columns)
    s = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(E.oracle_sql()[key])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    d = collections.Counter(tuple(norm(r[i]) for i in idx) for r in rel.fetchall())
    assert s == d


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
