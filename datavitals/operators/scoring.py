"""Scores, rankings and summaries of issue rows (small relations, one row per finding)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from datavitals.functions.cells import rounded

# Points a finding costs, by severity.
HEALTH_POINTS = {"critical": 15, "warning": 5, "minor": 2}
DRIFT_POINTS = {"critical": 18, "warning": 7, "minor": 2}
# Score bands, best first, and their labels.
HEALTH_LABELS = ((85, "Strong"), (65, "Needs review"), (40, "High risk"), (None, "Critical"))
RISK_LEVELS = ((85, "Low"), (65, "Moderate"), (40, "High"), (None, "Critical"))
DRIFT_LABELS = ((85, "Stable"), (65, "Moderate drift"), (40, "High drift"), (None, "Critical drift"))
# Expected gain of fixing an issue = base by severity + bonus by type, within 1..20.
IMPACT_BASE = {"critical": 12, "warning": 6, "minor": 3}
IMPACT_BONUS = {
    "duplicate_rows": 4, "constant_column": 4, "potential_target_leakage": 8, "likely_id_column": 5,
    "too_many_unique_values": 5, "high_cardinality_categorical": 4, "numeric_outliers_iqr": 3,
    "suspicious_timestamp_granularity": 4,
}
# Order of downstream risk among equal impacts.
RISK_RANK = {
    "potential_target_leakage": 0, "duplicate_rows": 1, "likely_id_column": 2, "too_many_unique_values": 3,
    "high_cardinality_categorical": 4, "numeric_outliers_iqr": 5, "missing_values": 6,
    "suspicious_timestamp_granularity": 7, "possible_wrong_dtype": 8,
}
SEVERITY_RANK = {"critical": 0, "warning": 1, "minor": 2}
# Quality dimension of each issue type.
DIMENSIONS = {
    "missing_values": "Completeness", "duplicate_rows": "Integrity", "constant_column": "Feature utility",
    "high_cardinality_categorical": "Feature encoding", "numeric_outliers_iqr": "Distribution",
    "likely_id_column": "Leakage/generalization", "too_many_unique_values": "Leakage/generalization",
    "potential_target_leakage": "Leakage/generalization",
    "suspicious_timestamp_granularity": "Train-serving reliability",
    "possible_wrong_dtype": "Schema reliability", "imbalanced_categorical": "Segment coverage",
}


def lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def banded(score: Column, bands) -> Column:
    result = F.lit(bands[-1][1])
    for bar, label in reversed(bands[:-1]):
        result = F.when(score >= bar, label).otherwise(result)
    return result


def points(table: dict = HEALTH_POINTS) -> Column:
    return lookup(table, F.col("severity"), 0)


def clamped(total: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.coalesce(total, F.lit(0)))).cast("int")


def health_score(issues: DataFrame) -> DataFrame:
    """One row: health_score, label."""
    return issues.agg(clamped(F.sum(points())).alias("health_score")).withColumn(
        "label", banded(F.col("health_score"), HEALTH_LABELS)
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row with the three buckets, zeros kept."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])


def score_breakdown(issues: DataFrame) -> DataFrame:
    """Deduction and running score per issue, in list order.

    The window has no partition key on purpose: an issue list is bounded by the number of
    columns times the number of checks, whatever the table's size."""
    order = Window.orderBy("check_ord", "col_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return issues.select(
        "check_ord", "col_ord", "issue_type", "column", "severity",
        (-points()).alias("deduction"),
        F.greatest(F.lit(0), F.lit(100) - F.sum(points()).over(order)).cast("int").alias("running_score"),
    )


def severity_rank() -> Column:
    return lookup(SEVERITY_RANK, F.col("severity"), 3)


def top_risks(issues: DataFrame, limit: int = 5) -> DataFrame:
    return issues.orderBy(severity_rank(), "check_ord", "col_ord").limit(limit)


def first_issues(issues: DataFrame, limit: int) -> DataFrame:
    """First issues in list order (the report's 8 or 10), without re-sorting by severity."""
    return issues.orderBy("check_ord", "col_ord").limit(limit)


def impact() -> Column:
    raw = lookup(IMPACT_BASE, F.col("severity"), 1) + lookup(IMPACT_BONUS, F.col("issue_type"), 0)
    return F.least(F.lit(20), F.greatest(F.lit(1), raw))


def recommendations(issues: DataFrame, limit: int = 6) -> DataFrame:
    order = Window.orderBy(
        severity_rank(), F.desc("expected_impact"), lookup(RISK_RANK, F.col("issue_type"), 99), "check_ord", "col_ord"
    )
    ranked = issues.withColumn("expected_impact", impact()).withColumn("priority", F.row_number().over(order))
    return ranked.filter(F.col("priority") <= limit).select(
        "priority", "issue_type", "column", "severity", "expected_impact"
    )


def fix_plan(issues: DataFrame, limit: int = 6) -> DataFrame:
    order = Window.orderBy(F.desc(points()), "check_ord", "col_ord")
    ranked = issues.withColumn("priority", F.row_number().over(order)).filter(F.col("priority") <= limit)
    return ranked.select("priority", "issue_type", "column", "severity", points().alias("expected_gain"))


def common_issue_types(issues: DataFrame, limit: int = 3) -> DataFrame:
    """Most frequent issue types; the one seen first wins a tie."""
    seen = F.struct("check_ord", "col_ord")
    return (
        issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("seen"))
        .orderBy(F.desc("n"), "seen").limit(limit).select("issue_type", "n")
    )


def dimension_breakdown(issues: DataFrame) -> DataFrame:
    return (
        issues.withColumn("category", lookup(DIMENSIONS, F.col("issue_type"), "Other"))
        .groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    )


def observability(issues: DataFrame, column_count: int) -> DataFrame:
    """One row: issue density, share of columns with an issue, risk level."""
    width = max(1, column_count)
    touched = F.count_distinct(F.when(F.col("column") != "dataset", F.col("column")))
    return issues.agg(
        rounded(F.count(F.lit(1)) / width, 2).alias("issue_density"),
        rounded(touched / width * 100, 1).alias("problematic_columns_pct"),
        banded(clamped(F.sum(points())), RISK_LEVELS).alias("risk_level"),
    )


def with_column_stats(issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each issue with its column's statistics and the table's shape; dataset-level issues get the shape and NULLs. The metrics
    relation has one row per column, so it is the broadcast side."""
    stats = metrics.select(
        "column", "dtype", rounded(F.col("missing_rate"), 4).alias("missing_rate"),
        rounded(F.col("unique_ratio"), 4).alias("unique_ratio"), rounded(F.col("outlier_rate"), 4).alias("outlier_rate"),
        *[rounded(F.col(c), 4).alias(c) for c in ("mean", "std_pop", "min", "p25", "median", "p75", "max")],
    )
    shape = metrics.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("kind") != "dataset").alias("columns")).first()
    return issues.join(F.broadcast(stats), "column", "left").withColumns({
        "table_rows": F.lit(shape["rows"]).cast("bigint"), "table_columns": F.lit(shape["columns"]).cast("bigint")})
