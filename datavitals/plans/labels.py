"""Frequencies of long texts: counted by digest, with only the labels that are shown fetched afterwards.

A label of up to 64 bytes is its own key; a longer one is keyed by 128 bits of its SHA-256. Beside the key travels the
label's head, its first 16 characters, which sorts as the labels do: whatever comes first among labels comes first among
their heads, so that the few that may win are known before any label is read. Their texts are looked up in a second scan
by a semi join on the key. Nothing longer than 64 bytes is shuffled but the labels that may be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datavitals.functions.cells import SHORT_TEXT, cell
from datavitals.session import stage

HEAD = 16               # characters, so at most 64 bytes
BROADCAST_KEYS = 10_000


def keyed(value: str, long: str = "long", key: str = "key", head: str = "head") -> list[str]:
    """SQL columns for a text: whether it is long, its key and its head."""
    return [
        f"octet_length({value}) > {SHORT_TEXT} AS {long}",
        f"CASE WHEN octet_length({value}) > {SHORT_TEXT} THEN left(sha2({value}, 256), 32) ELSE {value} END AS {key}",
        f"left({value}, {HEAD}) AS {head}",
    ]


def with_labels(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """Add `value`, the whole label, to `wanted` rows (ord, long, key, ...), from a table of (ord, value).

    The wanted keys are staged and counted; few are broadcast. A label comes back once from each task that has it."""
    wanted = stage(wanted, "labels")
    short = wanted.where("NOT long").withColumn("value", F.col("key"))
    keys = wanted.where("long").select("ord", "key")
    few = keys.count() <= BROADCAST_KEYS
    long = values.where(f"octet_length(value) > {SHORT_TEXT}").selectExpr("ord", "value", "left(sha2(value, 256), 32) AS key")
    met = long.join(F.broadcast(keys) if few else keys, ["ord", "key"], "left_semi")
    found = met.groupBy("ord", "key").agg(F.collect_set("value")[0].alias("value"))
    return short.unionByName(wanted.where("long").join(found, ["ord", "key"]).select(*short.columns))


def top_labels(df: DataFrame, column: str, limit: int) -> DataFrame:
    """(value, n) of a text column's most frequent labels; ties go to the lower label."""
    values = df.select(F.lit(0).alias("ord"), cell(column).alias("value")).where("value IS NOT NULL")
    counts = values.selectExpr("ord", *keyed("value")).groupBy("ord", "long", "key", "head").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "frequencies")
    shown = counts.orderBy(F.desc("n"), "head").limit(limit).agg(F.min("n").alias("n")).first()
    if shown["n"] is None:
        return values.select("value", F.lit(0).cast("bigint").alias("n")).limit(0)
    # all labels above the least count that is shown, and those of that count whose head may still be among the first
    first = counts.where(f"n = {shown['n']}").orderBy("head").limit(limit).agg(F.max("head").alias("head")).first()
    wanted = counts.where((F.col("n") > shown["n"]) | ((F.col("n") == shown["n"]) & (F.col("head") <= first["head"])))
    return with_labels(wanted, values).orderBy(F.desc("n"), "value").limit(limit).select("value", "n")
