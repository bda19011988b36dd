"""Run history: an append-only Parquet table, one row per scan, partitioned by monitor."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from datavitals.operators.checks import Scan
from datavitals.operators.guidance import enrich
from datavitals.operators.scoring import clamped, points
from datavitals.session import stage

_ISSUE = T.ArrayType(T.StructType([
    T.StructField(n, T.StringType()) for n in ("issue_type", "display_name", "column", "severity", "metric")
]))
HISTORY = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("dataset_name", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.LongType()), T.StructField("health_score", T.IntegerType()),
    T.StructField("issue_count", T.LongType()), T.StructField("critical_count", T.LongType()),
    T.StructField("warning_count", T.LongType()), T.StructField("minor_count", T.LongType()),
    T.StructField("schema_fingerprint", T.StringType()), T.StructField("provider_used", T.StringType()),
    T.StructField("config_summary", T.StringType()), T.StructField("issue_summaries", _ISSUE),
    T.StructField("run_signature", T.StringType()),
])
_DEFAULTS = {"schema_fingerprint": "", "run_signature": ""}


def fingerprint(names: list[str]) -> str:
    """First 16 hex digits of the SHA-256 of the JSON list of column names, in order."""
    return hashlib.sha256(json.dumps([str(n) for n in names]).encode()).hexdigest()[:16]


def fingerprint_of(names: Column) -> Column:
    """The same fingerprint for an array column of names, escaped as JSON in ASCII."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(code < 0x10000, unit(code)).otherwise(
            F.concat(unit(F.floor((code - 0x10000) / 1024) + 0xD800), unit((code - 0x10000) % 1024 + 0xDC00)))
        out = F.when(code.between(32, 126), c).otherwise(out)
        for plain, short in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")):
            out = F.when(c == plain, F.lit(short)).otherwise(out)
        return out

    quoted = F.transform(names, lambda n: F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(n, ""), lambda c: c != ""), escaped), ""), F.lit('"')))
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), 256), 1, 16)


def run_record(
    scan: Scan, dataset_name: str, provider: str = "Rule-based only", config: dict | None = None,
    timestamp: str | None = None, run_id: str | None = None, source: str = "",
) -> DataFrame:
    """One history row describing a scan. Issue summaries are bounded by the number of columns."""
    facts = scan.facts
    print_ = fingerprint([f.name for f in facts.fields])
    roles = scan.roles.as_settings()
    settings = {"roles": roles, "schema_fingerprint": print_, "provider": provider, **(config or {})}
    summary = F.struct("check_ord", "col_ord", "issue_type", "display_name", "column", "severity", "metric")
    severity = F.col("severity")
    row = enrich(scan.issues).agg(
        clamped(F.sum(points())).alias("health_score"), F.count(F.lit(1)).alias("issue_count"),
        *[F.count_if(severity == s).alias(f"{s}_count") for s in ("critical", "warning", "minor")],
        F.array_sort(F.collect_list(summary)).alias("found"),
    )
    signature = F.sha2(F.concat_ws("|", F.lit(source), F.lit(f"{facts.rows}x{len(facts.fields)}"), "health_score",
                                   "issue_count", F.lit(provider), F.lit(json.dumps(settings, sort_keys=True)),
                                   F.lit(dataset_name)), 256)
    stamp = timestamp or datetime.now(timezone.utc).isoformat(timespec="seconds")
    given = {
        "run_id": F.lit(run_id or str(uuid.uuid4())), "dataset_name": F.lit(dataset_name), "timestamp": F.lit(stamp),
        "row_count": F.lit(facts.rows), "column_count": F.lit(len(facts.fields)), "schema_fingerprint": F.lit(print_),
        "provider_used": F.lit(provider), "config_summary": F.lit(json.dumps(settings, sort_keys=True)),
        "issue_summaries": F.transform("found", lambda s: F.struct(
            s["issue_type"], s["display_name"], s["column"], s["severity"], s["metric"])),
        "run_signature": signature,
    }
    return row.select(*[given.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in HISTORY])


def save_run(record: DataFrame, path: str, skip_unchanged: bool = True) -> bool:
    """Append a run; with `skip_unchanged`, not when the monitor's newest run has its signature.

    An append is idempotent by the run's id: a repeated or retried one adds nothing, and where two writers append the same run
    at the same time, readers see it once."""
    name = record.select("dataset_name").first()[0]
    known = history(record.sparkSession, path).filter(F.col("dataset_name") == name)
    record = record.join(F.broadcast(known.select("run_id")), "run_id", "left_anti").select(*HISTORY.names)
    if skip_unchanged:
        record = record.join(F.broadcast(newest(known, 1).select("run_signature")), "run_signature", "left_anti").select(*HISTORY.names)
    if record.isEmpty():
        return False
    record.write.mode("append").partitionBy("dataset_name").parquet(path)
    return True


MOST_FILES = 8   # of one monitor before they are put together


def compact_history(spark: SparkSession, path: str, most_files: int = MOST_FILES) -> list[str]:
    """Put the files of each monitor that has more than `most_files` together into one, sorted by time; returns those monitors.

    Their runs are staged first and then replace their partitions in one commit. Reading a monitor's newest
    runs lists its partition alone and opens the compacted file and the few added since."""
    counts: dict[str, int] = {}
    for file in spark.read.schema(HISTORY).parquet(path).inputFiles():   # names only; no file is opened
        monitor = next((unquote(part.split("=", 1)[1]) for part in unquote(file).split("/") if part.startswith("dataset_name=")), None)
        if monitor is not None:
            counts[monitor] = counts.get(monitor, 0) + 1
    many = sorted(m for m, n in counts.items() if n > most_files)
    if many:
        runs = stage(history(spark, path).filter(F.col("dataset_name").isin(*many)), "history")
        runs = runs.repartition("dataset_name").sortWithinPartitions("dataset_name", "timestamp", "run_id")
        runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_name").parquet(path)
    return many


def history(spark: SparkSession, path: str) -> DataFrame:
    """All runs, each once. The schema is given, so old files without a newer column read as its default
    and no file footers are merged."""
    try:
        runs = spark.read.schema(HISTORY).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HISTORY)
    runs = runs.select(*[
        F.coalesce(f.name, F.lit(_DEFAULTS[f.name])).alias(f.name) if f.name in _DEFAULTS else F.col(f.name) for f in HISTORY
    ])
    return runs.dropDuplicates(["dataset_name", "run_id"])   # two writers may have appended the same run


def newest(runs: DataFrame, limit: int = 100) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), F.desc("run_id")).limit(limit)


def monitor_runs(runs: DataFrame, dataset_name: str, limit: int = 50, schema_fingerprint: str | None = None) -> DataFrame:
    """Newest runs of one monitor, oldest first."""
    chosen = runs.filter(F.col("dataset_name") == dataset_name)
    if schema_fingerprint:
        chosen = chosen.filter(F.col("schema_fingerprint") == schema_fingerprint)
    return newest(chosen, limit).orderBy("timestamp", "run_id")


def recent_runs(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    return newest(history(spark, path), limit)


def runs_for_dataset(spark: SparkSession, path: str, dataset_name: str, limit: int = 50, schema_fingerprint: str | None = None) -> DataFrame:
    return monitor_runs(history(spark, path), dataset_name, limit, schema_fingerprint)


def health_trend(runs: DataFrame) -> DataFrame:
    return runs.select("timestamp", "health_score", "issue_count").orderBy("timestamp")


def severity_trend(runs: DataFrame) -> DataFrame:
    """Severity counts per run, long."""
    return runs.unpivot(["run_id", "timestamp"], ["critical_count", "warning_count", "minor_count"], "severity", "n")


def run_deltas(runs: DataFrame) -> DataFrame:
    """Change of each run against the one before it of the same monitor and schema."""
    order = Window.partitionBy("dataset_name", "schema_fingerprint").orderBy("timestamp", "run_id")
    return runs.select(
        "run_id", "dataset_name", "timestamp", *[
            (F.col(c) - F.lag(c).over(order)).alias(f"{c}_delta") for c in ("health_score", "issue_count", "critical_count")
        ]
    )
