"""Registered queries over one table's scan: checks, profiles, scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datavitals.functions.cells import rounded
from datavitals.functions.normalize import normalize_values
from datavitals.operators import checks, chartdata, guidance, profile, scoring
from datavitals.operators.checks import Scan
from datavitals.operators.cleaning import simulate_cleaning
from suite import duck, sources as S
from suite.duck import RANK, WEIGHT, case_of
from suite.registry import register
from suite.sources import Source

ISSUES = """SELECT CAST(check_ord AS INTEGER) AS check_ord, CAST(col_ord AS INTEGER) AS col_ord, issue_type, "column", severity,
  round(CAST(metric_value AS DOUBLE), 6) AS metric_value, feature_type FROM i"""


def issue_rows(src: Source, spark, sf_dir) -> DataFrame:
    return Scan(src.frame(spark, sf_dir), src.roles).issues


def shown(issues: DataFrame) -> DataFrame:
    return issues.select(
        "check_ord", "col_ord", "issue_type", "column", "severity", rounded(F.col("metric_value"), 6).alias("metric_value"), "feature_type"
    )


def _check(name: str, src: Source, *types: str) -> None:
    """Issues of the given types (all when none is named) of one source."""
    wanted = ", ".join(f"'{t}'" for t in types)
    register(
        name,
        lambda spark, sf: shown(issue_rows(src, spark, sf).filter(F.col("issue_type").isin(*types)) if types else issue_rows(src, spark, sf)),
        f"{src.duck_issues} {ISSUES}" + (f" WHERE issue_type IN ({wanted})" if types else ""),
    )


_check("missing_issues", S.EVENTS_DIRTY, "missing_values")
_check("duplicate_rows_critical", S.LINEITEM_FLAGS, "duplicate_rows")
_check("duplicate_rows_warning", S.EVENTS_SHORT, "duplicate_rows")
_check("constant_columns", S.EVENTS_DIRTY, "constant_column")
_check("high_cardinality_categorical", S.PART_TEXT, "high_cardinality_categorical")
_check("iqr_outliers", S.DOCUMENTS, "numeric_outliers_iqr")
_check("likely_id_columns", S.CUSTOMER, "likely_id_column")
_check("likely_id_low_variance", S.CUSTOMER_SERIAL, "likely_id_column")
_check("too_many_unique_values", S.DOCUMENTS, "too_many_unique_values", "likely_id_column")
_check("possible_wrong_dtype", S.PART_TEXT, "possible_wrong_dtype")
_check("imbalanced_categorical", S.LINEITEM_TARGET, "imbalanced_categorical")
_check("timestamp_granularity", S.EVENTS_DIRTY, "suspicious_timestamp_granularity")
_check("timestamp_granularity_text", S.EVENTS_TEXT_TIME, "suspicious_timestamp_granularity", "likely_id_column")
_check("target_leakage_names", S.LINEITEM_NAMES, "potential_target_leakage")
_check("entity_key_duplicates", S.LINEITEM_KEY, "entity_id_integrity_risk")
_check("target_quality_and_imbalance", S.LINEITEM_TARGET, "target_quality_risk", "target_imbalance_risk")
_check("target_minority", S.LABELS_RARE, "target_quality_risk", "target_imbalance_risk")
_check("target_balanced", S.LABELS, "target_quality_risk", "target_imbalance_risk")
for _name, _src in (
    ("lineitem", S.LINEITEM), ("orders", S.ORDERS), ("customer", S.CUSTOMER), ("events", S.EVENTS), ("documents", S.DOCUMENTS),
    ("conversations", S.CONVERSATIONS), ("pages", S.PAGES), ("benchmark", S.BENCHMARK), ("supplier", S.SUPPLIER),
    ("nation", S.NATION), ("region", S.REGION), ("lineitem_gaps", S.LINEITEM_GAPS), ("events_dirty", S.EVENTS_DIRTY), ("events_roles", S.EVENTS_ROLES),
):
    _check(f"quality_checks_{_name}", _src)


def _empty(spark, sf) -> DataFrame:
    """A table whose rows were all filtered out upstream raises exactly one issue."""
    df = spark.read.parquet(f"{sf}/orders.parquet")
    return shown(Scan(df.filter(F.col("o_totalprice") < 0)).issues)


register("empty_dataset", _empty, """SELECT 0 AS check_ord, -1 AS col_ord, 'empty_dataset' AS issue_type, 'dataset' AS "column",
  'critical' AS severity, 0.0::DOUBLE AS metric_value, NULL::VARCHAR AS feature_type
  FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0) WHERE n = 0""")


# feature types and profiles -------------------------------------------------------------------

def _types(src: Source, spark, sf) -> DataFrame:
    return Scan(src.frame(spark, sf), src.roles).metrics.select("col_ord", "column", "dtype", "feature_type")


for _name, _src in (
    ("lineitem", S.LINEITEM), ("customer", S.CUSTOMER), ("documents", S.DOCUMENTS), ("orders", S.ORDERS), ("part_text", S.PART_TEXT),
    ("customer_serial", S.CUSTOMER_SERIAL), ("events_dirty", S.EVENTS_DIRTY), ("conversations", S.CONVERSATIONS),
):
    register(
        f"feature_types_{_name}", lambda spark, sf, src=_src: _types(src, spark, sf),
        f'{_src.duck_metrics} SELECT CAST(col_ord AS INTEGER) AS col_ord, "column", dtype, feature_type FROM f',
    )

_PROFILE = ", ".join(f'round({c}, 4) AS "{c.strip(chr(34))}"' for c in ("mean", "std_pop", '"min"', "p25", "median", "p75", '"max"'))
for _name, _src in (("lineitem", S.LINEITEM), ("customer", S.CUSTOMER), ("events_dirty", S.EVENTS_DIRTY), ("documents", S.DOCUMENTS)):
    register(
        f"column_profile_{_name}", lambda spark, sf, src=_src: profile.column_profile(src.frame(spark, sf)),
        f"""{_src.duck_metrics} SELECT "column", dtype, round(missing / "rows", 4) AS missing_rate, round(ratio, 4) AS unique_ratio,
            {_PROFILE}, round(outlier_rate, 4) AS outlier_rate FROM f""",
    )
    register(
        f"dtype_summary_{_name}", lambda spark, sf, src=_src: profile.dtype_summary(src.frame(spark, sf)),
        f'{_src.duck_metrics} SELECT "column", dtype, missing, round(missing / "rows", 4) AS missing_rate, n_unique AS "unique" FROM f',
    )

register(
    "table_overview",
    lambda spark, sf: profile.table_overview(S.CUSTOMER.frame(spark, sf)).select(
        "row_count", "column_count", F.array_join("columns", ",").alias("columns"), F.array_join("dtypes", ",").alias("dtypes")),
    """SELECT count(*) AS row_count, 5::INTEGER AS column_count, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns,
       'int64,object,int64,float64,object' AS dtypes FROM customer""",
)
register(
    "missing_cells", lambda spark, sf: profile.missing_cells(S.EVENTS_DIRTY.frame(spark, sf)),
    f"SELECT {' + '.join(f'count(*) - count({n})' for n, _ in S.EVENTS_DIRTY.columns)} AS missing_cells FROM ({S.EVENTS_DIRTY.duck})",
)
register(
    "value_freq",
    lambda spark, sf: profile.value_freq(S.EVENTS_DIRTY.frame(spark, sf), ["user_id", "event_type", "props"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c}::VARCHAR AS "value", count(*) AS n FROM ({S.EVENTS_DIRTY.duck}) GROUP BY 2"""
        for c in ("user_id", "event_type", "props")),
)
register(
    "modes", lambda spark, sf: profile.modes(S.DOCUMENTS.frame(spark, sf), ["text", "lang", "source"]),
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", count(*) AS n, {c} AS mode FROM documents GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""
        for c in ("text", "lang", "source")),
)
register(
    "category_shares",
    lambda spark, sf: profile.category_shares(S.PART_TEXT.frame(spark, sf), "description").select("value", "n", rounded(F.col("share"), 6).alias("share")),
    f"""SELECT description AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share
        FROM ({S.PART_TEXT.duck}) GROUP BY 1 ORDER BY n DESC, value LIMIT 20""",
)
register(
    "unique_key_notes",
    lambda spark, sf: profile.key_candidates(Scan(S.CUSTOMER.frame(spark, sf), unique="all").metrics),
    f"""{S.CUSTOMER.duck_metrics} SELECT "column", dtype, 0.05::DOUBLE AS max_missing_rate FROM f WHERE ratio = 1""",
)
register(
    "null_normalize",
    lambda spark, sf: normalize_values(S.EVENTS_DIRTY.frame(spark, sf)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("props").alias("with_props"), F.count("value").alias("with_value")),
    f"SELECT event_type, count(*) AS n, count(props) AS with_props, count(value) AS with_value FROM ({S.EVENTS_DIRTY.duck}) GROUP BY 1",
)
register(
    "role_filter",
    lambda spark, sf: checks.ml_columns(
        Scan(S.EVENTS_ROLES.frame(spark, sf), S.EVENTS_ROLES.roles).metrics, S.EVENTS_ROLES.roles).select("column", "feature_type"),
    f"""{S.EVENTS_ROLES.duck_metrics} SELECT "column", feature_type FROM f
        WHERE "column" NOT IN ('props', 'event_id', 'event_time', 'user_id')""",
)


# scores and rankings --------------------------------------------------------------------------

def _dirty(spark, sf) -> DataFrame:
    return issue_rows(S.EVENTS_ROLES, spark, sf)


_I = S.EVENTS_ROLES.duck_issues
_SCORE = f"CAST(greatest(0, least(100, 100 - coalesce(sum({WEIGHT}), 0))) AS INTEGER)"
_LABEL = "CASE WHEN {s} >= 85 THEN '{0}' WHEN {s} >= 65 THEN '{1}' WHEN {s} >= 40 THEN '{2}' ELSE '{3}' END"

for _name, _src in (("orders", S.ORDERS), ("events_dirty", S.EVENTS_ROLES), ("documents", S.DOCUMENTS)):
    register(
        f"health_score_{_name}", lambda spark, sf, src=_src: scoring.health_score(issue_rows(src, spark, sf)),
        f"{_src.duck_issues} SELECT s AS health_score, {_LABEL.format('Strong', 'Needs review', 'High risk', 'Critical', s='s')} AS label FROM (SELECT {_SCORE} AS s FROM i)",
    )
register(
    "severity_counts", lambda spark, sf: scoring.severity_counts(_dirty(spark, sf)),
    f"""{_I} SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
        count(*) FILTER (severity = 'minor') AS minor FROM i""",
)
register(
    "score_breakdown", lambda spark, sf: scoring.score_breakdown(_dirty(spark, sf)),
    f"""{_I} SELECT CAST(check_ord AS INTEGER) AS check_ord, CAST(col_ord AS INTEGER) AS col_ord, issue_type, "column", severity,
        CAST(-({WEIGHT}) AS INTEGER) AS deduction,
        CAST(greatest(0, 100 - sum({WEIGHT}) OVER (ORDER BY check_ord, col_ord ROWS UNBOUNDED PRECEDING)) AS INTEGER) AS running_score FROM i""",
)
register(
    "observability", lambda spark, sf: scoring.observability(_dirty(spark, sf), len(S.EVENTS_ROLES.columns)),
    f"""{_I} SELECT round(n / 8, 2) AS issue_density, round(k / 8 * 100, 1) AS problematic_columns_pct,
        {_LABEL.format('Low', 'Moderate', 'High', 'Critical', s='s')} AS risk_level
        FROM (SELECT count(*) AS n, count(DISTINCT "column") FILTER ("column" <> 'dataset') AS k, {_SCORE} AS s FROM i)""",
)
register(
    "issue_by_severity", lambda spark, sf: shown(checks.by_severity(_dirty(spark, sf), "warning")),
    f"{_I} {ISSUES} WHERE severity = 'warning'",
)
register(
    "top_risks", lambda spark, sf: shown(scoring.top_risks(_dirty(spark, sf))),
    f"{_I} {ISSUES} ORDER BY {RANK}, check_ord, col_ord LIMIT 5",
)
register(
    "report_issues", lambda spark, sf: shown(scoring.first_issues(_dirty(spark, sf), 8)),
    f"{_I} {ISSUES} ORDER BY check_ord, col_ord LIMIT 8",
)
_IMPACT = f"least(20, greatest(1, {case_of('severity', scoring.IMPACT_BASE, '1')} + {case_of('issue_type', scoring.IMPACT_BONUS, '0')}))"
register(
    "issue_impact",
    lambda spark, sf: _dirty(spark, sf).select("issue_type", "column", "severity", scoring.impact().alias("impact")),
    f'{_I} SELECT issue_type, "column", severity, CAST({_IMPACT} AS INTEGER) AS impact FROM i',
)
register(
    "recommendations", lambda spark, sf: scoring.recommendations(_dirty(spark, sf)),
    f"""{_I} SELECT CAST(p AS INTEGER) AS priority, issue_type, "column", severity, CAST(e AS INTEGER) AS expected_impact FROM (
          SELECT *, {_IMPACT} AS e, row_number() OVER (ORDER BY {RANK}, {_IMPACT} DESC,
            {case_of('issue_type', scoring.RISK_RANK, '99')}, check_ord, col_ord) AS p FROM i) WHERE p <= 6""",
)
register(
    "fix_plan", lambda spark, sf: scoring.fix_plan(_dirty(spark, sf)),
    f"""{_I} SELECT CAST(p AS INTEGER) AS priority, issue_type, "column", severity, CAST({WEIGHT} AS INTEGER) AS expected_gain FROM (
          SELECT *, row_number() OVER (ORDER BY {WEIGHT} DESC, check_ord, col_ord) AS p FROM i) WHERE p <= 6""",
)
register(
    "issue_type_top3", lambda spark, sf: scoring.common_issue_types(_dirty(spark, sf)),
    f"{_I} SELECT issue_type, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, min(check_ord * 1000 + col_ord) LIMIT 3",
)
register(
    "issue_breakdown", lambda spark, sf: scoring.dimension_breakdown(_dirty(spark, sf)),
    f"""{_I} SELECT {case_of('issue_type', scoring.DIMENSIONS, "'Other'")} AS category, severity, count(*) AS n FROM i GROUP BY 1, 2""",
)
_STATS = [f'"{c}"' for c in ("mean", "std_pop", "min", "p25", "median", "p75", "max")]
register(
    "issue_with_stats",
    lambda spark, sf: (lambda scan: scoring.with_column_stats(scan.issues, scan.metrics))(
        Scan(S.EVENTS_ROLES.frame(spark, sf), S.EVENTS_ROLES.roles)).select(
            "issue_type", "column", "severity", "dtype", "missing_rate", "unique_ratio", "outlier_rate", *[c.strip('"') for c in _STATS], "table_rows", "table_columns"),
    f"""{_I} SELECT issue_type, i."column", severity, dtype, round(missing / "rows", 4) AS missing_rate, round(ratio, 4) AS unique_ratio,
        round(outlier_rate, 4) AS outlier_rate, {', '.join(f'round({c}, 4) AS {c}' for c in _STATS)},
        (SELECT count(*) FROM src) AS table_rows, {len(S.EVENTS_ROLES.columns)}::BIGINT AS table_columns FROM i LEFT JOIN f ON i."column" = f."column" """,
)
_TITLES = {k: v.display_name for k, v in guidance.ADVICE.items()}
_TEXTS = ("ml_impact", "business_impact", "why_this_matters", "suggested_fix", "example_code")


def _text_of(field: str) -> str:
    text = case_of("issue_type", {k: getattr(v, field) for k, v in guidance.ADVICE.items()}, "NULL")
    return f"""replace({text}, '{{column}}', "column") AS {field}"""


register(
    "enrich",
    lambda spark, sf: guidance.enrich(_dirty(spark, sf)).select("issue_type", "column", "severity", "display_name", *_TEXTS),
    f"""{_I} SELECT issue_type, "column", severity, {case_of('issue_type', _TITLES, 'issue_type')} AS display_name, {', '.join(map(_text_of, _TEXTS))} FROM i""",
)
register(
    "scoring_rules", lambda spark, sf: guidance.rules_fired(_dirty(spark, sf)).select("rule", "severity", "issue_type", F.col("fired").cast("bigint").alias("fired")),
    _I + " UNION ALL ".join(
        f"""SELECT '{rule.replace("'", "''")}' AS rule, '{severity}' AS severity, '{kind}' AS issue_type, count(*) AS fired FROM i
            WHERE issue_type = '{kind}' AND severity = '{severity}'""" for rule, severity, kind in guidance.SCORING_RULES),
)


# chart data -----------------------------------------------------------------------------------

register(
    "chart_missing_by_column",
    lambda spark, sf: chartdata.missing_by_column(Scan(S.EVENTS_DIRTY.frame(spark, sf)).metrics).select("column", rounded(F.col("missing_pct"), 6).alias("missing_pct")),
    f"""{S.EVENTS_DIRTY.duck_metrics} SELECT "column", round(missing / "rows" * 100, 6) AS missing_pct FROM f WHERE missing > 0""",
)
register(
    "chart_no_missing", lambda spark, sf: chartdata.missing_by_column(Scan(S.ORDERS.frame(spark, sf)).metrics),
    f"""{S.ORDERS.duck_metrics} SELECT 'No missing values' AS "column", 0.0::DOUBLE AS missing_pct FROM f HAVING max(missing) = 0""",
)
register(
    "chart_missing_matrix",
    lambda spark, sf: chartdata.missing_matrix(S.EVENTS_DIRTY.frame(spark, sf), ["event_id"]),
    "SELECT event_id, " + ", ".join(f"CAST({n} IS NULL AS INTEGER) AS {n}_missing" for n, _ in S.EVENTS_DIRTY.columns if n != "event_id")
    + f" FROM ({S.EVENTS_DIRTY.duck}) ORDER BY event_id LIMIT 200",
)
register(
    "chart_severity_distribution", lambda spark, sf: chartdata.severity_distribution(_dirty(spark, sf)),
    _I + " UNION ALL ".join(f"SELECT '{s}' AS severity, count(*) AS n FROM i WHERE severity = '{s}'" for s in scoring.SEVERITY_RANK),
)
register(
    "chart_severities_present", lambda spark, sf: chartdata.severities_present(_dirty(spark, sf)),
    f"{_I} SELECT severity, count(*) AS n FROM i GROUP BY 1",
)
register(
    "chart_unique_ratio",
    lambda spark, sf: chartdata.unique_ratios(Scan(S.LINEITEM.frame(spark, sf), unique="all").metrics).select(
        "column", "n_unique", rounded(F.col("unique_ratio"), 6).alias("unique_ratio")),
    f'{S.LINEITEM.duck_metrics} SELECT "column", n_unique, round(ratio, 6) AS unique_ratio FROM f',
)
register(
    "chart_histogram30", lambda spark, sf: chartdata.histogram(S.LINEITEM.frame(spark, sf), "l_extendedprice").select("bin", "n"),
    """SELECT CAST(least(29, floor((l_extendedprice - lo) / ((hi - lo) / 30))) AS INTEGER) AS bin, count(*) AS n
       FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1""",
)
register(
    "chart_box_stats",
    lambda spark, sf: chartdata.box_stats(S.DOCUMENTS.frame(spark, sf), "n_chars"),
    """SELECT *, p25 - 1.5 * (p75 - p25) AS lower_fence, p75 + 1.5 * (p75 - p25) AS upper_fence FROM (
         SELECT min(n_chars)::DOUBLE AS min, quantile_cont(n_chars::DOUBLE, 0.25) AS p25, quantile_cont(n_chars::DOUBLE, 0.5) AS median,
                quantile_cont(n_chars::DOUBLE, 0.75) AS p75, max(n_chars)::DOUBLE AS max FROM documents)""",
)
_NUM = [n for n, k in S.LINEITEM.columns if k in ("int", "float")]
register(
    "chart_correlations",
    lambda spark, sf: chartdata.correlations(S.LINEITEM.frame(spark, sf)).select("column_a", "column_b", rounded(F.col("corr"), 6).alias("corr")),
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _NUM for b in _NUM),
)
_GAPS = [n for n, _ in S.LINEITEM_GAPS.columns]
register(
    "chart_correlations_gaps",
    lambda spark, sf: chartdata.correlations(S.LINEITEM_GAPS.frame(spark, sf)).select("column_a", "column_b", rounded(F.col("corr"), 6).alias("corr")),
    f"WITH src AS ({S.LINEITEM_GAPS.duck}) " + " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL)
              AND min({b}) FILTER ({a} IS NOT NULL) < max({b}) FILTER ({a} IS NOT NULL) THEN round(corr({a}, {b}), 6) END AS corr FROM src"""
        for a in _GAPS for b in _GAPS),
)


def _nested(spark, sf) -> DataFrame:
    """Orders as rows with a map, an array and a structure: rows counted as repeated, and rows left by cleaning."""
    df = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "map('status', o_orderstatus, 'priority', o_orderpriority) AS traits", "array(o_orderpriority, CAST(NULL AS string)) AS list",
        "named_struct('year', year(o_orderdate), 'deep', map(year(o_orderdate), array(o_orderstatus))) AS whole",
        "CASE WHEN o_orderkey % 2 = 0 THEN map('a', 1, 'b', 2) ELSE map('b', 2, 'a', 1) END AS same")
    cleaned = simulate_cleaning(df)
    return cleaned.df.agg(F.count(F.lit(1)).alias("kept")).select(
        "kept", F.lit(cleaned.dropped_rows).cast("bigint").alias("dropped"), F.lit(Scan(df).facts.duplicate_rows).cast("bigint").alias("repeated"))


register("nested_rows", _nested, """
  SELECT count(*) AS kept, (SELECT count(*) FROM orders) - count(*) AS dropped, (SELECT count(*) FROM orders) - count(*) AS repeated
  FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, year(o_orderdate) FROM orders)""")
