"""Registered queries against their reference SQL in DuckDB.

A sample of them runs by default; set ALL_QUERIES=1 for every one."""

import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

import __spark_entry__ as entry  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
DEFAULT = [
    "quality_checks_events_roles", "quality_checks_lineitem", "quality_checks_documents", "feature_types_part_text", "column_profile_documents",
    "drift_issues_events", "drift_numeric_psi_lineitem", "drift_categorical_documents", "clean_simulation", "fix_preview", "fix_accumulated",
    "repeated_key_rows", "contract_events_dirty", "history_record", "scoring_rules", "chart_correlations", "null_normalize", "monitor_name",
]
CHOSEN = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else DEFAULT


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return "" if value is None else value if isinstance(value, str) else repr(value + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
