"""Profiles: table overview, per-column summaries, frequency tables and modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datavitals.functions.cells import cell, fields_of, positional, rounded
from datavitals.plans.facts import metrics_frame, table_facts
from datavitals.plans.frequency import as_text, value_freq
from datavitals.plans.labels import keyed, top_labels, with_labels
from datavitals.plans.options import ScanOptions
from datavitals.session import stage

STATS = ("mean", "std_pop", "min", "p25", "median", "p75", "max")


def table_overview(df: DataFrame) -> DataFrame:
    """One row: row count, column count, names and logical dtypes."""
    fields = fields_of(df)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(fields)).alias("column_count"),
        F.array(*[F.lit(f.name) for f in fields]).alias("columns"),
        F.array(*[F.lit(f.dtype) for f in fields]).alias("dtypes"),
    )


def dtype_summary(df: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """column, dtype, missing, missing_rate, unique; no rows for an empty table."""
    facts = table_facts(df, None, options, unique="all", probs=(), fences=False)
    frame = metrics_frame(df.sparkSession, facts, options)
    return frame.filter("rows > 0").select(
        "column", "dtype", "missing", rounded(F.col("missing_rate"), 4).alias("missing_rate"),
        F.col("n_unique").alias("unique"),
    )


def column_profile(df: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Per-column context: rates, distinct ratio and, for numeric columns, the seven statistics
    and the share outside the IQR fences, rounded to four places."""
    facts = table_facts(df, None, options, unique="all")
    shown = [rounded(F.col(c), 4).alias(c) for c in ("missing_rate", "unique_ratio", *STATS, "outlier_rate")]
    return metrics_frame(df.sparkSession, facts, options).select("column", "dtype", *shown)


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: missing cells in the whole table."""
    cells = positional(df)
    total = " + ".join(f"count_if({c} IS NULL)" for c in cells.columns) or "0"
    return cells.selectExpr(f"CAST({total} AS bigint) AS missing_cells")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mode): most frequent value of each column as text, the lowest winning a tie.

    All columns are counted in one shuffle of keys (plans/labels.py); then the largest count of each column, the least head
    that reaches it, and last the labels with that head."""
    fields = [f for f in fields_of(df) if f.kind != "opaque" and f.name in columns]
    cells = positional(df)
    entries = ", ".join(f"struct({f.ord} AS ord, {as_text(f, f.pos)} AS value)" for f in fields)
    values = cells.selectExpr(f"inline(array({entries}))").where("value IS NOT NULL")
    counts = values.selectExpr("ord", *keyed("value")).groupBy("ord", "long", "key", "head").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "frequencies")
    most = counts.groupBy("ord").agg(F.max("n").alias("n"))                                     # one row a column
    leading = counts.join(F.broadcast(most), ["ord", "n"])
    first = leading.groupBy("ord").agg(F.min("head").alias("head"))
    named = with_labels(leading.join(F.broadcast(first), ["ord", "head"]), values)
    names = df.sparkSession.createDataFrame([(f.ord, f.name) for f in fields], "ord int, column string")
    return named.groupBy("ord", "n").agg(F.min("value").alias("mode")).join(F.broadcast(names), "ord").select("column", "n", "mode")


def top_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """(value, n) of one column's most frequent non-null values in their own type; ties go to
    the lower value. Limit is small, so Spark keeps only that many rows per task. Texts are counted by
    digest where they are long (plans/labels.py)."""
    if next(f for f in fields_of(df) if f.name == column).kind == "string":
        return top_labels(df, column, limit)
    counts = df.select(cell(column).alias("value")).filter("value is not null").groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(limit)


def category_shares(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Share of each category among the column's non-null rows, largest first."""
    total = df.agg(F.count(cell(column)).alias("total"))
    return top_values(df, column, limit).select("value", "n", (F.col("n") / total.scalar()).alias("share"))


def key_candidates(metrics: DataFrame) -> DataFrame:
    """Columns whose every row is distinct, with the default missing limit they should keep."""
    return metrics.filter("unique_ratio = 1").select("column", "dtype", F.lit(0.05).alias("max_missing_rate"))
