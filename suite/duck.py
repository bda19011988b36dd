"""Reference SQL for the scan queries, written for DuckDB.

Builds one statement that computes a table's column metrics and evaluates every check on them.
It shares nothing with the Spark side but the rules' wording."""

from __future__ import annotations

# The name fragments that decide feature types and leakage.
TIME = "date|time|timestamp|created|updated"
IDENT = "id|uuid|guid|key|identifier"
SAFE = "price|volume|temperature|temp|sensor|reading|return|returns|amount|value|rate|ratio|score|measurement"
LEAK = "target|label|outcome|churned|converted|conversion|defaulted|fraud|post_|after_"


def text(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def normalized(column: str) -> str:
    t = text(column)
    return f"CASE WHEN lower({t}) IN ('', 'null', 'nan', 'n/a', 'na') THEN NULL ELSE {t} END"


def _column(i: int, name: str, kind: str) -> str:
    c = f'"{name}"'
    numeric = kind in ("int", "float")
    v = f"{c}::DOUBLE" if numeric else "NULL::DOUBLE"
    t = text(c) if kind == "str" else (f"{c}::VARCHAR" if numeric else "NULL::VARCHAR")
    num = f"TRY_CAST({t} AS DOUBLE)" if kind == "str" else v
    parsed = f"TRY_CAST({t} AS TIMESTAMP)" if kind == "str" else ("NULL::TIMESTAMP" if kind == "bool" else f"{c}")
    dtype = {"int": "int64", "float": "float64", "str": "object", "bool": "bool", "ts": "datetime64[ns]"}[kind]
    distinct = "NULL::BIGINT" if kind == "opaque" else f"count(DISTINCT {c})"

    def share(pattern: str) -> str:
        return f"avg(CASE WHEN regexp_matches({t}, '{pattern}') THEN 1 ELSE 0 END) FILTER ({c} IS NOT NULL)"

    both = f"avg(CASE WHEN regexp_matches({t}, '[A-Za-z]') AND regexp_matches({t}, '\\d') THEN 1 ELSE 0 END) FILTER ({c} IS NOT NULL)"
    return f"""
      SELECT {i} AS col_ord, '{name}' AS "column", '{kind}' AS kind, '{dtype}' AS dtype, count(*) AS "rows",
        count(*) - count({c}) AS missing, count({c}) AS present, {distinct} AS n_unique,
        (SELECT max(k) FROM (SELECT count(*) AS k FROM src WHERE {c} IS NOT NULL GROUP BY {c})) AS top_n,
        avg({v}) AS mean, stddev_pop({v}) AS std_pop, min({v}) AS "min", quantile_cont({v}, 0.25) AS p25,
        quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.75) AS p75, max({v}) AS "max",
        {share('^-?[0-9,]+([.][0-9]+)?$') if kind == 'str' else 'NULL::DOUBLE'} AS numeric_like,
        median(length({t})) AS median_len,
        1 - {share(chr(92) + 's')} AS compact, {both} AS mixed, {share('[-_]')} AS sep,
        {share('^[0-9a-fA-F]{8}-[0-9a-fA-F-]{13,}$')} AS uuid_like,
        count({num}) AS num_present, avg({num}) AS num_mean, stddev_pop({num}) AS num_std, count(DISTINCT {num}) AS num_unique,
        count({parsed}) AS parsed, count(DISTINCT {parsed}) AS parsed_unique
      FROM src"""


def _fences(i: int, name: str) -> str:
    return f"""
      SELECT {i} AS col_ord, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(v) AS outlier_rate
      FROM (SELECT "{name}"::DOUBLE AS v, (SELECT p25 FROM m WHERE col_ord = {i}) AS q1,
                   (SELECT p75 FROM m WHERE col_ord = {i}) AS q3 FROM src)
      WHERE q3 <> q1"""


def metrics(src: str, columns: list[tuple[str, str]]) -> str:
    """WITH clause ending in `f`: one row per column with metrics, outlier rate and feature type."""
    numeric = [(i, n) for i, (n, k) in enumerate(columns) if k in ("int", "float")]
    fences = " UNION ALL ".join(_fences(i, n) for i, n in numeric) or "SELECT NULL AS col_ord, NULL AS outlier_rate"
    return f"""
    WITH src AS ({src}),
    m AS ({" UNION ALL ".join(_column(i, n, k) for i, (n, k) in enumerate(columns))}),
    o AS ({fences}),
    t AS (SELECT m.*, o.outlier_rate, n_unique / "rows" AS ratio,
            coalesce(kind <> 'ts' AND kind <> 'bool' AND median_len >= 8 AND compact >= 0.9
                     AND (mixed >= 0.5 OR sep >= 0.5 OR uuid_like >= 0.5), false) AS token,
            regexp_matches(lower("column"), '{IDENT}') AS ident, regexp_matches(lower("column"), '{SAFE}') AS safe,
            regexp_matches(lower("column"), '{TIME}') AS timed,
            coalesce(kind IN ('int', 'float', 'str') AND num_present >= 10 AND num_unique > 2 AND num_mean <> 0
                     AND num_std / abs(num_mean) < 0.01, false) AS flat
          FROM m LEFT JOIN o USING (col_ord)),
    f AS (SELECT *, CASE
            WHEN timed THEN 'timestamp-like'
            WHEN kind = 'str' AND (ident OR token) THEN 'identifier-like'
            WHEN kind = 'str' AND median_len >= 30 THEN 'free-text-like'
            WHEN kind = 'str' THEN 'categorical'
            WHEN kind = 'float' OR kind = 'bool' THEN 'continuous numeric'
            WHEN kind = 'int' AND present = 0 THEN 'continuous numeric'
            WHEN kind = 'int' AND ident AND ratio >= 0.90 THEN 'identifier-like'
            WHEN kind = 'int' AND NOT safe AND ratio >= 0.98 THEN 'identifier-like'
            WHEN kind = 'int' AND n_unique <= least(20, greatest(2, "rows" // 10)) THEN 'ordinal'
            WHEN kind = 'int' THEN 'continuous numeric'
            ELSE 'categorical' END AS feature_type FROM t)"""


def _quoted(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")" if values else "('')"


def issues(src: str, columns: list[tuple[str, str]], target="", timestamp="", entity="", protected=(), excluded=()) -> str:
    """metrics() plus `i`: the issue rows."""
    skip = _quoted([x for x in (*protected, *excluded, timestamp, entity) if x])
    keys = [k for k in (entity, timestamp) if k]
    key_list = ", ".join(f'"{k}"' for k in keys)
    complete = " AND ".join(f'"{k}" IS NOT NULL' for k in keys)
    all_columns = ", ".join(f'"{n}"' for n, _ in columns)
    likely = f"""(kind <> 'opaque' AND "column" NOT IN {skip} AND "rows" >= 2 AND present > 0 AND ratio >= 0.95
                 AND feature_type <> 'continuous numeric' AND (ident OR token OR (flat AND NOT safe)))"""
    parsed_ok = """(kind IN ('int', 'float', 'ts') AND present / "rows" >= 0.80 AND ratio > 0.80)
                OR (kind = 'str' AND parsed / "rows" >= 0.80 AND parsed_unique / "rows" > 0.80)"""
    parts = [
        f"""SELECT 1 AS check_ord, col_ord, 'missing_values' AS issue_type, "column",
              CASE WHEN missing / "rows" > 0.40 THEN 'critical' WHEN missing / "rows" >= 0.05 THEN 'warning' ELSE 'minor' END AS severity,
              missing / "rows" AS metric_value, NULL AS feature_type FROM f WHERE missing > 0""",
        f"""SELECT 2, -1, 'duplicate_rows', 'dataset', CASE WHEN (n - d) / n > 0.20 THEN 'critical' ELSE 'warning' END, (n - d) / n, NULL
            FROM (SELECT sum(k) AS n, count(*) AS d FROM (SELECT count(*) AS k FROM src GROUP BY {all_columns})) WHERE n > d""",
        """SELECT 3, col_ord, 'constant_column', "column", 'critical', 1.0, NULL FROM f WHERE missing = 0 AND n_unique = 1""",
        f"""SELECT 4, col_ord, 'high_cardinality_categorical', "column", 'warning', ratio, NULL FROM f
            WHERE "column" NOT IN {skip} AND "rows" >= 2 AND kind = 'str' AND feature_type = 'categorical' AND n_unique >= 50 AND ratio >= 0.30""",
        """SELECT 5, col_ord, 'numeric_outliers_iqr', "column", CASE WHEN outlier_rate > 0.10 THEN 'critical' ELSE 'minor' END, outlier_rate, NULL
           FROM f WHERE kind IN ('int', 'float') AND present >= 4 AND n_unique > 1 AND p75 <> p25 AND outlier_rate > 0""",
        f"""SELECT 6, col_ord, 'likely_id_column', "column", 'warning', ratio, feature_type FROM f WHERE {likely}""",
        """SELECT 7, col_ord, 'possible_wrong_dtype', "column", 'minor', numeric_like, NULL FROM f WHERE kind = 'str' AND numeric_like >= 0.80""",
        f"""SELECT 8, col_ord, 'imbalanced_categorical', "column", 'warning', top_n / present, NULL FROM f
            WHERE kind = 'str' AND "column" NOT IN {_quoted(protected)} AND n_unique >= 2 AND top_n / present >= 0.95""",
        f"""SELECT 9, col_ord, 'suspicious_timestamp_granularity', "column", 'warning',
              CASE WHEN kind = 'str' THEN parsed_unique / "rows" ELSE ratio END, NULL
            FROM f WHERE "rows" >= 10 AND timed AND "column" <> '{timestamp}' AND ({parsed_ok})""",
        f"""SELECT 10, col_ord, 'potential_target_leakage', "column", 'warning', NULL, NULL FROM f
            WHERE regexp_matches(lower("column"), '{LEAK}') AND "column" <> '{target}'""",
        f"""SELECT 12, col_ord, 'too_many_unique_values', "column", CASE WHEN feature_type = 'identifier-like' THEN 'warning' ELSE 'minor' END,
              ratio, feature_type FROM f WHERE "column" NOT IN {skip} AND "rows" >= 10 AND NOT {likely}
              AND feature_type IN ('identifier-like', 'free-text-like') AND n_unique > 20 AND ratio > 0.80""",
    ]
    if entity:
        parts.append(f"""SELECT 11, (SELECT col_ord FROM f WHERE "column" = '{entity}'), 'entity_id_integrity_risk', '{entity}',
              CASE WHEN (n - d) / n <= 0.20 THEN 'warning' ELSE 'critical' END, (n - d) / n, NULL
            FROM (SELECT sum(k) AS n, count(*) AS d FROM (SELECT count(*) AS k FROM src WHERE {complete} GROUP BY {key_list})) WHERE n > d""")
    if target:
        parts.append(f"""SELECT 13, col_ord, 'target_quality_risk', "column", CASE WHEN missing / "rows" > 0.05 THEN 'critical' ELSE 'warning' END,
              missing / "rows", NULL FROM f WHERE "column" = '{target}' AND missing > 0""")
        parts.append(f"""SELECT 14, col_ord, 'target_imbalance_risk', "column", 'warning', top_n / present, NULL FROM f
              WHERE "column" = '{target}' AND n_unique >= 2 AND top_n / present >= 0.90""")
    return metrics(src, columns) + ",\n    i AS (" + "\n UNION ALL ".join(parts) + ")"


WEIGHT = "CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 WHEN 'minor' THEN 2 ELSE 0 END"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END"


def case_of(column: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN " + "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"
