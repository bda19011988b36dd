"""Fixes, accumulated fixes and plan properties."""

import pytest
from pyspark.sql import functions as F

from datavitals import Scan, apply_issue_fix, preview_issue_fix, simulate_cleaning
from datavitals.operators.guidance import ADVICE, SCORING_RULES, enrich
from datavitals.operators.remediation import NO_FIX, apply_fixes, repeated_key_rows
from datavitals.operators.scoring import DIMENSIONS, HEALTH_POINTS


def fix(df, issue, column):
    return apply_issue_fix(df, {"issue_type": issue, "column": column})


def test_rare_groups_and_nulls(spark):
    values = [f"c{i:02d}" for i in range(24) for _ in range(2)] + ["c00"] * 50 + [None] * 3 + ["once"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    high, _ = fix(df, "high_cardinality_categorical", "c")
    assert high.filter("c = 'OTHER'").count() == 4 * 2 + 3 + 1 and high.filter("c IS NULL").count() == 0
    rare, _ = fix(df, "imbalanced_categorical", "c")
    assert rare.filter("c = 'OTHER'").count() == 1 and rare.filter("c IS NULL").count() == 3


def test_long_labels_are_looked_up_by_digest(spark):
    a, b = "a" * 400, "a" * 399 + "b"
    df = spark.createDataFrame([(a,)] * 60 + [(b,)] * 60 + [("once" * 40,)] + [(None,)] * 2, "c string")
    rare, _ = fix(df, "imbalanced_categorical", "c")
    assert {(r["c"], r["count"]) for r in rare.groupBy("c").count().collect()} == {(a, 60), (b, 60), ("OTHER", 1), (None, 2)}
    again = repeated_key_rows(df, ["c"])
    assert again.count() == 122 and again.columns == ["c"]


def test_fills(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (None, None, None)], "n int, s string, e string")
    assert [r["n"] for r in fix(df, "missing_values", "n")[0].collect()] == [1.0, 2.0, 1.5]
    assert [r["s"] for r in fix(df, "missing_values", "s")[0].collect()] == ["b", "a", "a"]
    assert {r["e"] for r in fix(df, "missing_values", "e")[0].collect()} == {"UNKNOWN"}


def test_numbers_and_times(spark):
    df = spark.createDataFrame([("1,250", "2026-01-05 13:30:00"), (" -3.5 ", "bad"), ("$4", None)], "t string, at string")
    assert [r["t"] for r in fix(df, "possible_wrong_dtype", "t")[0].collect()] == [1250.0, -3.5, None]
    rows = fix(df, "suspicious_timestamp_granularity", "at")[0].collect()
    assert [(r["at_dayofweek"], r["at_hour"]) for r in rows] == [(0, 13), (None, None), (None, None)]


@pytest.mark.parametrize("issue", ["target_quality_risk", "target_imbalance_risk", "entity_id_integrity_risk", "empty_dataset"])
def test_no_fix(spark, issue):
    df = spark.range(5)
    assert fix(df, issue, "id") == (df, [NO_FIX])
    assert fix(df, "constant_column", "absent")[1] == [NO_FIX]


def test_preview_and_accumulate(spark):
    df = spark.createDataFrame([(i // 2, None if i % 4 == 0 else float(i // 2 % 5), "x") for i in range(60)], "k int, v double, c string")
    row, (fixed, actions) = preview_issue_fix(df, {"issue_type": "constant_column", "column": "c"})
    assert row.first()["improvement"] == 15 and fixed.columns == ["k", "v"] and actions == ["c: constant, dropped"]
    issues = Scan(df).issues.collect()
    done, log = apply_fixes(df, issues, stage_every=2)
    assert done.filter("v IS NULL").count() == 0 and "c" not in done.columns and len(log) == len(issues)


def test_cleaning_keeps_rows_and_can_be_switched_off(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (3, 3.0)], "a int, b double")
    assert simulate_cleaning(df).df.columns == ["a"]   # filled with 3.0, b is constant
    kept = simulate_cleaning(df, remove_constant_columns=False)
    assert kept.dropped_rows == 1 and kept.filled == {"b": 3.0}
    off = simulate_cleaning(df, drop_duplicates=False, fill_numeric_median=False, remove_constant_columns=False)
    assert off.df.count() == 4 and off.actions == ["nothing to clean"]


def test_repeated_keys_with_a_hot_key(spark):
    keys = ["hot"] * 400 + [f"k{i // 2}" for i in range(600)] + ["alone", None, None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int").repartition(5)
    assert repeated_key_rows(df, ["k"], hot_share=0.01).count() == 400 + 600 + 2
    assert repeated_key_rows(df, ["k"], hot_share=1.0).count() == 1002


def test_guidance_covers_every_issue_type(spark):
    assert set(DIMENSIONS) < set(ADVICE) and {kind for _, _, kind in SCORING_RULES} < set(ADVICE) and set(HEALTH_POINTS) == {"critical", "warning", "minor"}
    df = spark.createDataFrame([(1, 0, "brand_new", "col", "minor", 0.5, "m", None)],
                               "check_ord int, col_ord int, issue_type string, column string, severity string, metric_value double, metric string, feature_type string")
    row = enrich(df).first()
    assert row["display_name"] == "Brand New" and row["ml_impact"] == "m"


def test_scans_use_no_python_workers_and_prune_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(2000).selectExpr("id", "CAST(id % 7 AS string) AS s", "id * 0.5 AS v", "repeat('x', 50) AS unused").write.parquet(path)
    from datavitals.functions.cells import fields_of, positional
    from datavitals.plans.frequency import field_frequencies, per_column

    df = spark.read.parquet(path)
    freq = field_frequencies(positional(df), fields_of(df)[:2], {1: 1})
    plan = per_column(*freq)._jdf.queryExecution().toString()
    assert "Python" not in plan and "unused" not in plan.split("== Physical Plan ==")[1]
    assert Scan(df).issues.filter(F.col("issue_type") == "constant_column").first()["column"] == "unused"
