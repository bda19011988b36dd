"""Exactness in the column's own type, equal rows, names that differ in case, and plans without needless sorts."""

import json
import hashlib
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from datavitals import Scan, compare_datasets, simulate_cleaning
from datavitals.operators.drift import shift_table
from datavitals.operators.remediation import apply_issue_fix
from datavitals.plans.facts import table_facts, without_repeats
from datavitals.sources.history import fingerprint, fingerprint_of


def found(df, **options):
    return {(r["issue_type"], r["column"]) for r in Scan(df, **options).issues.collect()}


def test_wide_integers_are_not_constant(spark):
    df = spark.createDataFrame([(2**53, "a"), (2**53 + 1, "b"), (2**53, "c")], "n long, s string")
    assert ("constant_column", "n") not in found(df)
    assert simulate_cleaning(df).removed_columns == []


def test_decimals_are_counted_exactly(spark):
    values = [Decimal("12345678901234567890.01"), Decimal("12345678901234567890.02"), Decimal("12345678901234567890.03")]
    df = spark.createDataFrame([(v, 1) for v in values], "d decimal(38,2), k int")
    facts = table_facts(df)
    assert facts.values[0]["n_unique"] == 3 and facts.values[1]["n_unique"] == 1
    assert simulate_cleaning(df).removed_columns == ["k"]


def test_a_text_never_equals_a_digest(spark):
    long = "x" * 100
    digest = hashlib.sha256(long.encode()).hexdigest()
    facts = table_facts(spark.createDataFrame([(long,), (digest,), ("#" + digest,)], "s string"))
    assert facts.values[0]["n_unique"] == 3


def test_float_columns_are_counted(spark):
    metrics = Scan(spark.createDataFrame([(1.5,), (1.5,), (2.5,), (None,)], "v double")).metrics.first()
    assert (metrics["n_unique"], metrics["unique_ratio"]) == (2, 0.5)


@pytest.mark.parametrize("values,flat", [
    ([*map(str, range(1000, 1030)), "inf"], False),
    ([f"{10**12 + i}" for i in range(40)], True),     # a tiny spread around a large mean
    ([f"{10**12 + i * 10**10}" for i in range(40)], False),
])
def test_low_variance_of_numeric_texts(spark, values, flat):
    df = spark.createDataFrame([(v,) for v in values], "ref_value string").withColumnRenamed("ref_value", "reading")
    numbers = [float(v) for v in values]
    mean = sum(numbers) / len(numbers)
    std = math.sqrt(sum((x - mean) ** 2 for x in numbers) / len(numbers)) if math.isfinite(mean) else math.nan
    metrics = Scan(df).metrics.first()
    assert math.isnan(metrics["num_std"]) if math.isnan(std) else metrics["num_std"] == pytest.approx(std)
    assert (std / mean < 0.01) == flat


def test_equal_rows_are_dropped_as_they_are_counted(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 1), (2.0, 1), (2.0, 1), (3.0, None)], "v double, k int")
    cleaned = simulate_cleaning(df, fill_numeric_median=False, remove_constant_columns=False)
    assert cleaned.dropped_rows == 2 == df.count() - cleaned.df.count()
    once = spark.range(50).selectExpr("id", "CAST(id AS string) AS s", "CAST(NULL AS int) AS n")
    assert without_repeats(once) is once
    assert without_repeats(df.limit(0)).count() == 0


def test_names_that_differ_in_case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1.0, 10, "a"), (None, 10, "b"), (3.0, 10, "a")], "Income double, income int, s string")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    cleaned = simulate_cleaning(df)
    assert cleaned.removed_columns == ["income"] and cleaned.df.columns == ["Income", "s"]
    fixed, actions = apply_issue_fix(df, {"issue_type": "missing_values", "column": "Income"})
    assert fixed.columns == df.columns and actions == ["Income: gaps filled with the median"]
    assert sorted(r[0] for r in fixed.collect()) == [1.0, 2.0, 3.0]


def test_fingerprint_of_any_names(spark):
    for names in (["a", "b"], ["é", 'a"b'], ["back\\slash", "tab\t\n\x01\x7f", "😀"], [""]):
        row = spark.range(1).select(fingerprint_of(F.array(*[F.lit(n) for n in names])).alias("f")).first()
        assert row["f"] == fingerprint(names) == hashlib.sha256(json.dumps(names).encode()).hexdigest()[:16]


def test_long_labels_stay_whole(spark):
    a, b = "a" * 300, "b" * 300
    base = spark.createDataFrame([(b,), (b,), ("c",)], "s string")
    new = spark.createDataFrame([(a,), (a,), ("c",), ("c",)], "s string")
    row = compare_datasets(base, new).categorical_table.first()
    assert (row["baseline_dominant"], row["new_dominant"], row["new_categories"]) == (b, a, a)


def test_drift_aggregates_without_sorting_all_values(spark):
    df = spark.range(100).selectExpr("id", "CAST(id % 7 AS string) AS s", "id * 0.5D AS v")
    report = compare_datasets(df, df)
    for names in (report.numeric, report.categorical):
        table = shift_table(report.sides, report.fields, names, set(report.categorical), report.counted, report.options)
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortAggregate") <= (2 if names == report.categorical else 0)
