"""Registered queries against their DuckDB twins on the smallest table set."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001
from tools.oracle_check import rows
from vigil.sources.testdata import TABLES

FAST = ["ts_increase", "http_error_rate", "latency_p95", "error_signatures", "redact", "log_normalise",
        "rule_pod_restart", "suppress_explained", "incident_sessions", "memory_search_relaxed", "split_sections",
        "ground_hypotheses", "evidence_select", "enqueue_dedup", "log_around", "log_enrich", "camel_keys",
        "findings_text", "pod_status", "evidence_digest", "triage_floor"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    s = entry.queries()[name](spark, SF0001).toPandas()
    d = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert rows(s) == rows(d)


def test_every_query_has_a_builder_and_sql_is_subset():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "incident_id" in df.columns
