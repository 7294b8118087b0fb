"""Every SQL counterpart belongs to a query; a few run against DuckDB here."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, canonical

SF = "/root/testdata/sf0.001"
QUICK = (
    "latest_state", "job_audit", "conditional_finalize", "change_fingerprint", "metric_sums",
    "illegal_transitions", "redact_documents", "response_validation", "queue_gauges",
)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["error_class", "start_outcome", "n"]


@pytest.mark.parametrize("name", QUICK)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), columns)
