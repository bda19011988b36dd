"""Exports: cleaned tables, cleaning records and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and quotes doubled, as `read_csv` reads it."""
    df.write.mode(mode).options(header=True, escape='"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def cleaning_record(comparison: DataFrame, label: str) -> DataFrame:
    """One row with the state before and after cleaning, from a cleaning comparison."""

    def side(prefix: str):
        return F.struct(
            F.col(f"{prefix}_rows").alias("rows"), F.col(f"{prefix}_columns").alias("columns"),
            F.col(f"{prefix}_score").alias("health_score"), F.col(f"{prefix}_issue_count").alias("issue_count"),
        )

    return comparison.select(
        F.lit(label).alias("label"), side("original").alias("original"), side("cleaned").alias("cleaned_preview")
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_contract(document: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a one-row contract document as plain JSON text."""
    document.select(F.col("contract").alias("value")).write.mode(mode).text(path)
