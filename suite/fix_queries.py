"""Registered queries over cleaning, fixes, contracts and the run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datavitals.functions.cells import rounded
from datavitals.functions.names import MONITOR_PREFIXES, monitor_name
from datavitals.operators import cleaning, contract, remediation
from datavitals.operators.checks import Scan
from datavitals.operators.guidance import ADVICE
from datavitals.sources import history
from suite import duck, sources as S
from suite.duck import WEIGHT, case_of
from suite.registry import register
from suite.sources import Source

_SHORT = S.EVENTS_SHORT.duck
_DISTINCT = f"SELECT DISTINCT * FROM ({_SHORT})"
_CLEANED = f"""SELECT user_id, event_type, props, coalesce(tens, (SELECT quantile_cont(tens, 0.5) FROM ({_DISTINCT}))) AS tens FROM ({_DISTINCT})"""
_CLEANED_COLS = [("user_id", "int"), ("event_type", "str"), ("props", "str"), ("tens", "float")]


def _clean(spark, sf) -> DataFrame:
    return cleaning.simulate_cleaning(S.EVENTS_SHORT.frame(spark, sf)).df


register("clean_simulation", _clean, _CLEANED)


def _steps(spark, sf) -> DataFrame:
    """Only the median step: duplicates and constant columns stay."""
    return cleaning.simulate_cleaning(S.EVENTS_SHORT.frame(spark, sf), drop_duplicates=False, remove_constant_columns=False).df


register("clean_median_only", _steps, f"SELECT * REPLACE (coalesce(tens, (SELECT quantile_cont(tens, 0.5) FROM ({_SHORT}))) AS tens) FROM ({_SHORT})")


def _totals(src: str, columns: list[tuple[str, str]], prefix: str, roles: dict | None = None) -> str:
    """A one-row subquery with a table's totals and score."""
    missing = " + ".join(f'count(*) - count("{n}")' for n, _ in columns)
    return f"""(SELECT * FROM ({duck.issues(src, columns, **(roles or {}))} SELECT (SELECT count(*) FROM src) AS {prefix}_rows,
        CAST({len(columns)} AS INTEGER) AS {prefix}_columns, (SELECT {missing} FROM src) AS {prefix}_missing,
        CAST(greatest(0, least(100, 100 - coalesce(sum({WEIGHT}), 0))) AS INTEGER) AS {prefix}_score, count(*) AS {prefix}_issue_count FROM i))"""


def _delta(before: str, after: str, a: str, b: str) -> str:
    return f"SELECT *, {b}_score - {a}_score AS improvement FROM {before}, {after}"


def _compare(spark, sf) -> DataFrame:
    df = S.EVENTS_SHORT.frame(spark, sf)
    before = Scan(df)
    return cleaning.compare_scans(before, Scan(cleaning.simulate_cleaning(df, before=before).df))


register(
    "clean_comparison", _compare,
    _delta(_totals(_SHORT, list(S.EVENTS_SHORT.columns), "original"), _totals(_CLEANED, _CLEANED_COLS, "cleaned"), "original", "cleaned"),
)
register(
    "health_delta", lambda spark, sf: cleaning.health_delta(S.EVENTS_BEFORE.frame(spark, sf), S.EVENTS_AFTER.frame(spark, sf)),
    _delta(_totals(S.EVENTS_BEFORE.duck, list(S.EVENTS_BEFORE.columns), "baseline"),
           _totals(S.EVENTS_AFTER.duck, list(S.EVENTS_AFTER.columns), "batch"), "baseline", "batch"),
)


# one fix per issue type -----------------------------------------------------------------------

def _fix(name: str, src: Source, issue: str, column: str, sql: str, places: str = "") -> None:
    def run(spark, sf) -> DataFrame:
        out = remediation.apply_issue_fix(src.frame(spark, sf), {"issue_type": issue, "column": column})[0]
        return out.withColumn(places, rounded(F.col(places), 6)) if places else out

    register(name, run, sql)


_DIRTY = S.EVENTS_DIRTY.duck
_fix("fix_duplicate_rows", S.EVENTS_SHORT, "duplicate_rows", "dataset", _DISTINCT)
_fix("fix_missing_numeric", S.EVENTS_DIRTY, "missing_values", "value",
     f"SELECT * REPLACE (round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ({_DIRTY}))), 6) AS value) FROM ({_DIRTY})", "value")
_fix("fix_missing_text", S.EVENTS_DIRTY, "missing_values", "props",
     f"""SELECT * REPLACE (coalesce(props, (SELECT props FROM ({_DIRTY}) WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1)) AS props)
         FROM ({_DIRTY})""")
_fix("fix_constant_column", S.EVENTS_DIRTY, "constant_column", "source_version", f"SELECT * EXCLUDE (source_version) FROM ({_DIRTY})")
_fix("fix_high_cardinality", S.PART_TEXT, "high_cardinality_categorical", "description",
     f"""SELECT * REPLACE (CASE WHEN description IN (SELECT description FROM ({S.PART_TEXT.duck}) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
           THEN description ELSE 'OTHER' END AS description) FROM ({S.PART_TEXT.duck})""")
_fix("fix_high_cardinality_nulls", S.EVENTS_DIRTY, "high_cardinality_categorical", "props",
     f"""SELECT * REPLACE (CASE WHEN props IN (SELECT props FROM ({_DIRTY}) WHERE props IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
           THEN props ELSE 'OTHER' END AS props) FROM ({_DIRTY})""")
_fix("fix_outliers", S.DOCUMENTS, "numeric_outliers_iqr", "n_chars",
     """SELECT * EXCLUDE (q1, q3) REPLACE (round(least(greatest(n_chars::DOUBLE, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS n_chars)
        FROM documents, (SELECT quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.75) AS q3 FROM documents)""", "n_chars")
_fix("fix_outliers_nulls", S.EVENTS_DIRTY, "numeric_outliers_iqr", "value",
     f"""SELECT * EXCLUDE (q1, q3) REPLACE (CASE WHEN value IS NOT NULL
             THEN round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) END AS value) FROM ({_DIRTY}),
           (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ({_DIRTY}))""", "value")
_fix("fix_drop_identifier", S.CUSTOMER, "likely_id_column", "c_name", "SELECT * EXCLUDE (c_name) FROM customer")
_fix("fix_wrong_dtype", S.PART_COMMA, "possible_wrong_dtype", "size_text",
     f"SELECT * REPLACE (TRY_CAST(replace(trim(size_text), ',', '') AS DOUBLE) AS size_text) FROM ({S.PART_COMMA.duck})")
_fix("fix_imbalanced", S.EVENTS_DIRTY, "imbalanced_categorical", "props",
     f"""SELECT * REPLACE (CASE WHEN props IS NULL OR props IN (SELECT props FROM ({_DIRTY}) WHERE props IS NOT NULL GROUP BY 1
           HAVING count(*) >= greatest(2, (SELECT count(*) FROM events) * 0.01)) THEN props ELSE 'OTHER' END AS props) FROM ({_DIRTY})""")
_fix("fix_timestamp", S.EVENTS, "suspicious_timestamp_granularity", "ts",
     "SELECT * EXCLUDE (ts), CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek, CAST(hour(ts) AS INTEGER) AS ts_hour FROM events")
_fix("fix_timestamp_text", S.EVENTS_TEXT_TIME, "suspicious_timestamp_granularity", "created_at",
     """SELECT event_id, user_id, CAST(isodow(ts) - 1 AS INTEGER) AS created_at_dayofweek, CAST(hour(ts) AS INTEGER) AS created_at_hour FROM events""")
_fix("fix_none_available", S.LINEITEM_TARGET, "target_quality_risk", "deep_discount", S.LINEITEM_TARGET.duck)


def _preview(spark, sf) -> DataFrame:
    return remediation.preview_issue_fix(S.EVENTS_SHORT.frame(spark, sf), {"issue_type": "missing_values", "column": "tens"})[0]


_FILLED = f"SELECT * REPLACE (coalesce(tens, (SELECT quantile_cont(tens, 0.5) FROM ({_SHORT}))) AS tens) FROM ({_SHORT})"
register(
    "fix_preview", _preview,
    _delta(_totals(_SHORT, list(S.EVENTS_SHORT.columns), "before"), _totals(_FILLED, list(S.EVENTS_SHORT.columns), "after"), "before", "after"),
)


def _accumulated(spark, sf) -> DataFrame:
    df = S.EVENTS_SHORT.frame(spark, sf)
    return remediation.apply_fixes(df, Scan(df).issues.collect(), stage_every=2)[0]


register(
    "fix_accumulated", _accumulated,
    # Issue order: missing props, missing tens, duplicate rows, constant column, outliers of tens.
    f"""WITH a AS ({_SHORT}),
        b AS (SELECT * REPLACE (coalesce(props, (SELECT props FROM a WHERE props IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS props,
                coalesce(tens, (SELECT quantile_cont(tens, 0.5) FROM a)) AS tens) FROM a),
        c AS (SELECT DISTINCT user_id, event_type, props, tens FROM b),
        q AS (SELECT quantile_cont(tens, 0.25) AS q1, quantile_cont(tens, 0.75) AS q3 FROM c)
        SELECT user_id, event_type, props, least(greatest(tens, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS tens FROM c, q""",
)
register(
    "missing_flag", lambda spark, sf: remediation.flag_and_fill(S.EVENTS_SHORT.frame(spark, sf), "tens"),
    f"SELECT * REPLACE (coalesce(tens, (SELECT quantile_cont(tens, 0.5) FROM ({_SHORT}))) AS tens), tens IS NULL AS tens_was_missing FROM ({_SHORT})",
)
register(
    "labelled_rows", lambda spark, sf: remediation.labelled_rows(S.LINEITEM_TARGET.frame(spark, sf), "deep_discount"),
    f"SELECT * FROM ({S.LINEITEM_TARGET.duck}) WHERE deep_discount IS NOT NULL",
)
register(
    "repeated_key_rows",
    lambda spark, sf: remediation.repeated_key_rows(S.LINEITEM.frame(spark, sf), ["l_orderkey", "l_linenumber"]),
    """SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
)
register(
    "repeated_key_rows_hot", lambda spark, sf: remediation.repeated_key_rows(S.EVENTS_DIRTY.frame(spark, sf), ["event_type", "props"]),
    f"SELECT * FROM ({_DIRTY}) QUALIFY count(*) OVER (PARTITION BY event_type, props) > 1",
)


# contracts ------------------------------------------------------------------------------------

_KIND = {"int": "int64", "float": "float64", "str": "object", "ts": "datetime64[ns]"}


def contract_sql(src: Source) -> str:
    parts = []
    for i, (n, k) in enumerate(src.columns):
        c = f'"{n}"'
        num = k in ("int", "float")
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS col_ord, '{n}' AS "column", '{_KIND[k]}' AS dtype, 0.05::DOUBLE AS max_missing_rate,
            count({c}) < count(*) AS nullable, {f'min({c})::DOUBLE' if num else 'NULL::DOUBLE'} AS min_value,
            {f'max({c})::DOUBLE' if num else 'NULL::DOUBLE'} AS max_value,
            CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 20 THEN (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM src WHERE {c} IS NOT NULL)) END AS allowed,
            {'true' if n == src.roles.entity_id else 'NULL::BOOLEAN'} AS "unique", count(DISTINCT {c}) = count(*) AS monitor_as_key FROM src""")
    return f"WITH src AS ({src.duck}) " + " UNION ALL ".join(parts)


for _name, _src in (("orders", S.ORDERS), ("nation", S.NATION), ("events_dirty", S.EVENTS_DIRTY), ("labels", S.LABELS)):
    register(
        f"contract_{_name}",
        lambda spark, sf, src=_src: contract.data_contract(src.frame(spark, sf), src.roles)
        .withColumn("allowed", F.array_join("allowed_values", "|")).drop("allowed_values", "is_inferred"),
        contract_sql(_src),
    )


# run history ----------------------------------------------------------------------------------

_RUNS = S.ORDER_RUNS.duck
register("history_recent", lambda spark, sf: history.newest(S.ORDER_RUNS.frame(spark, sf)),
         f"SELECT * FROM ({_RUNS}) ORDER BY timestamp DESC, run_id DESC LIMIT 100")
register("history_monitor", lambda spark, sf: history.monitor_runs(S.ORDER_RUNS.frame(spark, sf), "O", 50, "fp-O"),
         f"SELECT * FROM ({_RUNS}) WHERE dataset_name = 'O' AND schema_fingerprint = 'fp-O' ORDER BY timestamp DESC, run_id DESC LIMIT 50")
register("history_trend", lambda spark, sf: history.health_trend(history.monitor_runs(S.ORDER_RUNS.frame(spark, sf), "F")),
         f"SELECT timestamp, health_score, issue_count FROM (SELECT * FROM ({_RUNS}) WHERE dataset_name = 'F' ORDER BY timestamp DESC LIMIT 50)")
register("history_severity_trend", lambda spark, sf: history.severity_trend(S.ORDER_RUNS.frame(spark, sf)),
         " UNION ALL ".join(f"SELECT run_id, timestamp, '{c}' AS severity, {c} AS n FROM ({_RUNS})" for c in ("critical_count", "warning_count", "minor_count")))
register(
    "history_deltas", lambda spark, sf: history.run_deltas(S.ORDER_RUNS.frame(spark, sf)),
    "SELECT run_id, dataset_name, timestamp, " + ", ".join(
        f"{c} - lag({c}) OVER (PARTITION BY dataset_name, schema_fingerprint ORDER BY timestamp, run_id) AS {c}_delta"
        for c in ("health_score", "issue_count", "critical_count")) + f" FROM ({_RUNS})",
)


def _record(spark, sf) -> DataFrame:
    scan = Scan(S.EVENTS_ROLES.frame(spark, sf), S.EVENTS_ROLES.roles)
    row = history.run_record(scan, "events", timestamp="2026-01-01T00:00:00+00:00", run_id="r1")
    return row.select("run_id", "dataset_name", "timestamp", "row_count", "column_count", "health_score", "issue_count", "critical_count",
                      "warning_count", "minor_count", "schema_fingerprint", F.size("issue_summaries").alias("summaries"))


def _names(src: Source) -> str:
    return "[" + ", ".join(f'"{n}"' for n, _ in src.columns) + "]"


register(
    "history_record", _record,
    f"""{S.EVENTS_ROLES.duck_issues} SELECT 'r1' AS run_id, 'events' AS dataset_name, '2026-01-01T00:00:00+00:00' AS timestamp,
        (SELECT count(*) FROM src) AS row_count, {len(S.EVENTS_ROLES.columns)}::BIGINT AS column_count,
        CAST(greatest(0, least(100, 100 - coalesce(sum({WEIGHT}), 0))) AS INTEGER) AS health_score, count(*) AS issue_count,
        count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'warning') AS warning_count,
        count(*) FILTER (severity = 'minor') AS minor_count, substring(sha256('{_names(S.EVENTS_ROLES)}'), 1, 16) AS schema_fingerprint,
        CAST(count(*) AS INTEGER) AS summaries FROM i""",
)


def _summaries(spark, sf) -> DataFrame:
    scan = Scan(S.EVENTS_ROLES.frame(spark, sf), S.EVENTS_ROLES.roles)
    row = history.run_record(scan, "events", timestamp="2026-01-01T00:00:00+00:00", run_id="r1")
    return row.select(F.inline("issue_summaries")).select("issue_type", "display_name", "column", "severity")


register(
    "history_record_summaries", _summaries,
    f"""{S.EVENTS_ROLES.duck_issues} SELECT issue_type, {case_of('issue_type', {k: v.display_name for k, v in ADVICE.items()}, 'issue_type')} AS display_name,
        "column", severity FROM i""",
)


def _fingerprints(spark, sf) -> DataFrame:
    out = None
    for src in (S.ORDERS, S.LINEITEM, S.EVENTS):
        df = src.frame(spark, sf)
        names = F.array(*[F.lit(n) for n in df.columns])
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(src.tables[0]).alias("name"), "row_count", history.fingerprint_of(names).alias("fingerprint"))
        out = one if out is None else out.unionByName(one)
    return out


register("schema_fingerprint", _fingerprints, " UNION ALL ".join(
    f"SELECT '{s.tables[0]}' AS name, count(*) AS row_count, substring(sha256('{_names(s)}'), 1, 16) AS fingerprint FROM {s.tables[0]}"
    for s in (S.ORDERS, S.LINEITEM, S.EVENTS)))
_PREFIX = "|".join(MONITOR_PREFIXES)
register(
    "monitor_name",
    lambda spark, sf: S.MONITOR_FILES.frame(spark, sf).select(monitor_name(F.col("path")).alias("monitor")).groupBy("monitor").agg(F.count(F.lit(1)).alias("n")),
    f"""SELECT regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]*$', ''), '^({_PREFIX})', '') AS monitor, count(*) AS n
        FROM ({S.MONITOR_FILES.duck}) GROUP BY 1""",
)
