"""Registered queries over what a table becomes when it is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from datavitals.operators.checks import Scan
from datavitals.operators import contract
from datavitals.operators.cleaning import compare_cleaning, simulate_cleaning
from datavitals.session import shared_folder
from datavitals.sources import history, readers, writers
from suite import duck, sources as S
from suite.fix_queries import contract_sql
from suite.registry import register
from suite.sources import Source


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/exports/{name}-{uuid.uuid4().hex}"


def _csv(spark, sf) -> DataFrame:
    """Documents, line breaks included, through CSV files."""
    path = _place(spark, "documents")
    writers.write_csv(S.DOCUMENTS.frame(spark, sf), path)
    back = readers.read_csv(spark, path)
    return back.withColumn("text", F.md5("text"))


register(
    "csv_round_trip", _csv,
    f"SELECT doc_id, md5({duck.normalized('text')}) AS text, lang, source, n_chars FROM documents",
)


def _parquet(spark, sf) -> DataFrame:
    path = _place(spark, "events")
    writers.write_parquet(S.EVENTS_DIRTY.frame(spark, sf), path)
    return readers.load(spark, path)


register("parquet_round_trip", _parquet, S.EVENTS_DIRTY.duck)


def _record(spark, sf) -> DataFrame:
    path, df = _place(spark, "record"), S.EVENTS_SHORT.frame(spark, sf)
    writers.write_json(writers.cleaning_record(compare_cleaning(df, simulate_cleaning(df).df), "conservative"), path)
    return spark.read.json(path).select("label", F.col("original.rows").alias("before"), F.col("cleaned_preview.rows").alias("after"))


register(
    "cleaning_record", _record,
    f"SELECT 'conservative' AS label, count(*) AS before, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({S.EVENTS_SHORT.duck}))) AS after FROM ({S.EVENTS_SHORT.duck})",
)


def _history(spark, sf) -> DataFrame:
    """Two monitors; the second run of the first is unchanged and not stored."""
    path = _place(spark, "history")
    for src, name, stamp in ((S.ORDERS, "orders", "2026-01-01"), (S.ORDERS, "orders", "2026-01-02"), (S.NATION, "nation", "2026-01-03")):
        history.save_run(history.run_record(Scan(src.frame(spark, sf), src.roles), name, timestamp=stamp, run_id=f"{name}-{stamp}"), path)
    return history.recent_runs(spark, path).select("run_id", "dataset_name", "timestamp", "row_count", "column_count")


register("history_append", _history, """
  SELECT 'orders-2026-01-01' AS run_id, 'orders' AS dataset_name, '2026-01-01' AS timestamp, count(*) AS row_count, 6::BIGINT AS column_count FROM orders
  UNION ALL SELECT 'nation-2026-01-03', 'nation', '2026-01-03', count(*), 3 FROM nation""")


def _wide(spark, sf) -> DataFrame:
    """Wide whole numbers that a double cannot tell apart, decimals and booleans, counted and cleaned."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    df = orders.selectExpr(
        "o_orderkey", "9007199254740992 + o_orderkey % 2 AS wide", "CAST(1e18 AS decimal(38,2)) + CAST(o_orderkey % 3 AS decimal(38,2)) / 100 AS money",
        "o_orderkey > 0 AS flag", "o_orderkey >= 0 AS sure", "CAST(NULL AS string) AS nothing")
    metrics = Scan(df).metrics.select("column", "n_unique", "missing")
    kept = F.lit(",".join(simulate_cleaning(df).df.columns))
    return metrics.withColumn("kept", kept)


register("wide_numbers", _wide, """
  WITH x AS (
    SELECT 0 AS ord, 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS n_unique, 0::BIGINT AS missing FROM orders
    UNION ALL SELECT 1, 'wide', count(DISTINCT o_orderkey % 2), 0 FROM orders
    UNION ALL SELECT 2, 'money', count(DISTINCT o_orderkey % 3), 0 FROM orders
    UNION ALL SELECT 3, 'flag', count(DISTINCT o_orderkey > 0), 0 FROM orders
    UNION ALL SELECT 4, 'sure', count(DISTINCT o_orderkey >= 0), 0 FROM orders
    UNION ALL SELECT 5, 'nothing', 0, count(*) FROM orders)
  SELECT "column", n_unique, missing, (SELECT string_agg("column", ',' ORDER BY ord) FROM x WHERE n_unique <> 1 OR missing > 0) AS kept FROM x""")


def _moment(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


_CLOCK = ("' '", "hour(ts)", "':'", "lpad(cast(minute(ts) AS string), 2, '0')", "':'", "lpad(cast(second(ts) AS string), 2, '0')")
WRITTEN_TIMES = Source(
    ("events",),
    f"""SELECT event_id, {_moment("month(ts)", "'/'", "day(ts)", "'/'", "year(ts)", *_CLOCK)} AS us_time,
          {_moment("day(ts)", "'.'", "month(ts)", "'.'", "year(ts)", *_CLOCK[:4])} AS eu_time,
          CASE WHEN event_type = 'error' THEN 'unknown' ELSE {_moment("day(ts)", "'/'", "month(ts)", "'/'", "1900 + event_id % 99")} END AS day_date,
          {_moment("1 + event_id % 12", "'/'", "1 + user_id % 12", "'/'", "1900 + event_id % 99")} AS either_date, cast(ts AS string) AS iso_time
        FROM {{events}}""",
    (("event_id", "int"), *((n, "str") for n in ("us_time", "eu_time", "day_date", "either_date", "iso_time"))),
)
_FORMS = {
    "us_time": "%m/%d/%Y %H:%M:%S", "eu_time": "%d.%m.%Y %H:%M", "day_date": "%d/%m/%Y", "either_date": "%m/%d/%Y", "iso_time": None}


def _written_times(spark, sf) -> DataFrame:
    """Times in five ways of writing, through CSV files: how many are read and how many differ, and whether the check fires."""
    path = _place(spark, "times")
    writers.write_csv(WRITTEN_TIMES.frame(spark, sf), path)
    scan = Scan(readers.read_csv(spark, path, staged=True))   # a dozen passes, none of which parses the text again
    fired = scan.issues.where("issue_type = 'suspicious_timestamp_granularity'").select("column", F.lit(True).alias("fired"))
    read = scan.metrics.where("kind = 'string'").select("column", "parsed", "parsed_unique")
    return read.join(fired, "column", "left").select("column", "parsed", "parsed_unique", F.coalesce("fired", F.lit(False)).alias("fired"))


register("timestamp_written_forms", _written_times, f"WITH src AS ({WRITTEN_TIMES.duck})" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(t) AS parsed, count(DISTINCT t) AS parsed_unique,
          count(*) >= 10 AND count(t) / count(*) >= 0.80 AND count(DISTINCT t) / count(*) > 0.80 AS fired
        FROM (SELECT {f"try_strptime({c}, '{form}')" if form else f"TRY_CAST({c} AS TIMESTAMP)"} AS t FROM src)""" for c, form in _FORMS.items()))


def _contract_json(spark, sf) -> DataFrame:
    """A contract written as JSON text and read again, one row a column."""
    path, src = _place(spark, "contract"), S.ORDERS
    writers.write_contract(contract.contract_document(contract.data_contract(src.frame(spark, sf), src.roles)), path)
    rules = "struct<dtype:string,max_missing_rate:double,nullable:boolean,min_value:double,max_value:double,allowed_values:array<string>>"
    found = spark.read.schema(f"contract_version string, required_columns array<string>, columns map<string,{rules}>").json(path)
    return found.select("contract_version", F.explode("columns").alias("column", "r")).select(
        "contract_version", "column", "r.dtype", "r.nullable", "r.min_value", "r.max_value", F.array_join("r.allowed_values", "|").alias("allowed"))


register("contract_json", _contract_json, f"SELECT '0.1' AS contract_version, \"column\", dtype, nullable, min_value, max_value, allowed FROM ({contract_sql(S.ORDERS)})")


def _older_runs(spark, sf) -> DataFrame:
    """Runs in files written before a column was added, beside newer files."""
    path, runs = _place(spark, "runs"), S.ORDER_RUNS.frame(spark, sf)
    runs.where("dataset_name = 'O'").drop("schema_fingerprint", "minor_count").write.partitionBy("dataset_name").parquet(path)
    runs.where("dataset_name <> 'O'").write.mode("append").partitionBy("dataset_name").parquet(path)
    return history.history(spark, path).select("run_id", "dataset_name", "timestamp", "row_count", "minor_count", "schema_fingerprint", "run_signature")


register("history_older_files", _older_runs, f"""
  SELECT run_id, dataset_name, timestamp, row_count, CASE WHEN dataset_name <> 'O' THEN minor_count END AS minor_count,
    CASE WHEN dataset_name = 'O' THEN '' ELSE schema_fingerprint END AS schema_fingerprint, '' AS run_signature FROM ({S.ORDER_RUNS.duck})""")


def _compacted(spark, sf) -> DataFrame:
    """Runs appended month by month, some of them twice, then compacted: newest 50 of each monitor."""
    path, runs = _place(spark, "compacted"), S.ORDER_RUNS.frame(spark, sf)
    runs = runs.repartition(12, "timestamp")
    for again in (runs, runs.where("health_score % 2 = 0")):
        again.write.mode("append").partitionBy("dataset_name").parquet(path)
    history.compact_history(spark, path)
    parts = [history.runs_for_dataset(spark, path, name) for name in ("F", "O", "P")]
    return parts[0].union(parts[1]).union(parts[2]).select("run_id", "dataset_name", "timestamp", "row_count", "issue_count")


register("history_compacted", _compacted, f"""SELECT run_id, dataset_name, timestamp, row_count, issue_count FROM ({S.ORDER_RUNS.duck})
  QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY timestamp DESC, run_id DESC) <= 50""")
register(
    "preview", lambda spark, sf: readers.preview(S.ORDERS.frame(spark, sf).orderBy(F.desc("o_totalprice"), "o_orderkey"), 25),
    "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
