"""The aggregates behind charts; drawing is left to the caller."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from datavitals.functions.cells import cell, fields_of, number_or_null, positional, quoted, stripped
from datavitals.operators.drift import category_changes
from datavitals.operators.scoring import SEVERITY_RANK
from datavitals.plans.comoments import comoments
from datavitals.plans.facts import table_facts
from datavitals.plans.options import ScanOptions

HISTOGRAM_BINS, OVERLAY_BINS = 30, 35


def missing_by_column(metrics: DataFrame) -> DataFrame:
    """Missing percentage of the columns that miss anything, or one placeholder row."""
    shown = metrics.filter("missing > 0").select("column", (F.col("missing_rate") * 100).alias("missing_pct"))
    none = metrics.agg(F.max("missing").alias("worst")).filter("coalesce(worst, 0) = 0").select(
        F.lit("No missing values").alias("column"), F.lit(0.0).alias("missing_pct")
    )
    return shown.unionByName(none).orderBy(F.desc("missing_pct"), "column")


def missing_matrix(df: DataFrame, order_by: list[str], rows: int = 200) -> DataFrame:
    """0/1 per cell for the first rows by an explicit order (tables have none of their own)."""
    first = df.orderBy(*[cell(c) for c in order_by]).limit(rows)
    return first.select(*[cell(c) for c in order_by], *[
        cell(c).isNull().cast("int").alias(f"{c}_missing") for c in df.columns if c not in order_by
    ])


def severity_distribution(issues: DataFrame) -> DataFrame:
    """All three severities in fixed order, zeros kept."""
    counts = issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])
    return counts.unpivot([], list(SEVERITY_RANK), "severity", "n")


def severities_present(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def unique_ratios(metrics: DataFrame, limit: int = 30) -> DataFrame:
    return metrics.select("column", "n_unique", "unique_ratio").orderBy(F.desc("unique_ratio"), "column").limit(limit)


def _binned(v: Column, low: float, high: float, bins: int) -> Column:
    """Zero-based equal-width bin, counted in whole widths from the least value; the largest value belongs to the last bin.
    (`width_bucket` rounds in another order, and puts some values that lie on an edge one bin off.)"""
    width = (high - low) / bins
    if low == high or not width:   # one value, or a span too small to be parted
        return F.lit(0)
    if not math.isfinite(width):
        return F.lit(None).cast("int")
    return F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, n) of the non-empty equal-width bins."""
    values = df.select(cell(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    span = values.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if span["low"] is None:
        return values.select(F.lit(0).alias("bin"), "v", "v", F.lit(0).alias("n")).limit(0).toDF("bin", "low", "high", "n")
    low, width = span["low"], (span["high"] - span["low"]) / bins
    counts = values.groupBy(_binned(F.col("v"), low, span["high"], bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n"
    )


def box_stats(df: DataFrame, column: str, options: ScanOptions | None = None) -> DataFrame:
    """One row: min, quartiles, max and the IQR fences."""
    facts = table_facts(df.select(cell(column).alias(column)), options=options, unique="none", fences=False)
    f = facts.fields[0]
    q = facts.quantiles.get(0, {})
    row = {"min": facts.of(f, "min"), "p25": q.get(0.25), "median": q.get(0.5), "p75": q.get(0.75), "max": facts.of(f, "max")}
    if q:
        iqr = row["p75"] - row["p25"]
        row |= {"lower_fence": row["p25"] - 1.5 * iqr, "upper_fence": row["p75"] + 1.5 * iqr}
    names = ("min", "p25", "median", "p75", "max", "lower_fence", "upper_fence")
    schema = pa.schema([(n, pa.float64()) for n in names])
    return df.sparkSession.createDataFrame(pa.Table.from_pylist([{n: row.get(n) for n in names}], schema=schema))


# A spread on a pair's rows below this share of the column's own counts as none: it is what rounding leaves.
LEAST_SPREAD = 1e-12


def correlations(df: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, both ways round, over the rows where both have a finite
    value. NULL where there are no such rows or either column does not vary over them.

    One pass over the table for up to 512 columns (plans/comoments.py); nothing but one row a pair leaves a task."""
    fields = [f for f in fields_of(df) if f.numeric]
    schema = "column_a string, column_b string, corr double"
    if len(fields) < 2:
        return df.sparkSession.createDataFrame([], schema)
    found = comoments(positional(df).selectExpr(*[f"CAST({f.pos} AS double) AS {f.pos}" for f in fields]))
    names = pa.table({"i": pa.array(range(len(fields)), pa.int32()), "name": [f.name for f in fields]})
    names = df.sparkSession.createDataFrame(names)
    own = found.where("i = j").selectExpr("i", f"{LEAST_SPREAD} * c_ii / n AS least")
    named = names.join(F.broadcast(own), "i", "left")   # one row a column
    ends = F.broadcast(named.selectExpr("i AS j", "name AS j_name", "least AS j_least"))
    pairs = named.selectExpr("i", "name AS i_name", "least AS i_least", f"explode(sequence(i, {len(fields) - 1})) AS j").join(ends, "j")
    pairs = pairs.join(found, ["i", "j"], "left")
    varies = "c_ii > n * i_least AND c_jj > n * j_least"
    pairs = pairs.selectExpr("i", "j", "i_name", "j_name", f"CASE WHEN {varies} THEN greatest(-1D, least(1D, c_ij / sqrt(c_ii) / sqrt(c_jj))) END AS corr")
    ways = "array(struct(i_name AS column_a, j_name AS column_b)), CASE WHEN i < j THEN array(struct(j_name AS column_a, i_name AS column_b)) ELSE array() END"
    return pairs.selectExpr("corr", f"inline(concat({ways}))").select("column_a", "column_b", "corr")


def psi_by_column(numeric_table: DataFrame) -> DataFrame:
    return numeric_table.select("column", "psi", "severity").orderBy(F.desc("psi"), "column")


def missing_drift_bars(missing_table: DataFrame, limit: int = 30) -> DataFrame:
    """Missing percentage of both sides, long, for the columns that rose most."""
    top = missing_table.orderBy(F.desc("change"), "col_ord").limit(limit).select(
        "column", (F.col("baseline_missing_rate") * 100).alias("baseline"), (F.col("new_missing_rate") * 100).alias("new")
    )
    return top.unpivot(["column"], ["baseline", "new"], "dataset", "missing_pct")


def category_bars(baseline: DataFrame, current: DataFrame, column: str, limit: int = 15) -> DataFrame:
    """Share of both sides, long, for the categories with the largest summed share."""
    shares = category_changes(baseline, current, column)
    top = shares.orderBy(F.desc(F.col("baseline_share") + F.col("new_share")), "value").limit(limit)
    wide = top.select(
        F.col("value").alias("category"), (F.col("baseline_share") * 100).alias("baseline"), (F.col("new_share") * 100).alias("new")
    )
    return wide.unpivot(["category"], ["baseline", "new"], "dataset", "frequency")


def _as_number(df: DataFrame, column: str) -> Column:
    f = next(f for f in fields_of(df) if f.name == column)
    return F.expr(number_or_null(stripped(quoted(column)))) if f.kind == "string" else cell(column).cast("double")


def overlay_histogram(baseline: DataFrame, current: DataFrame, column: str, bins: int = OVERLAY_BINS) -> DataFrame:
    """(dataset, bin, n) of both sides over one common set of equal-width bins."""
    both = baseline.select(_as_number(baseline, column).alias("v"), F.lit("baseline").alias("dataset")).unionByName(
        current.select(_as_number(current, column).alias("v"), F.lit("new").alias("dataset"))
    ).filter("v is not null and not isnan(v)")
    span = both.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if span["low"] is None:
        return both.select("dataset", F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    return both.groupBy("dataset", _binned(F.col("v"), span["low"], span["high"], bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
