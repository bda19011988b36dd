"""Table-level normalisation of values and column names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datavitals.functions.cells import positional, text_or_null
from datavitals.functions.names import normalized_names


def normalize_values(df: DataFrame) -> DataFrame:
    """Strip text cells, turn null-like words and NaN into NULL; other cells stay as they are."""
    return positional(df, text_or_null).toDF(*df.columns)


def normalize_table(df: DataFrame) -> DataFrame:
    """Normalised values under unique, trimmed, lower-case names."""
    return positional(df, text_or_null).toDF(*normalized_names(df.columns))
