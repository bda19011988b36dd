"""Registered queries comparing two sides of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from datavitals.functions.cells import rounded
from datavitals.operators import chartdata, drift
from datavitals.operators.drift import DriftReport
from suite import duck_drift as D, sources as S
from suite.registry import register
from suite.sources import Source

PAIRS = {
    "events": (S.EVENTS_BEFORE, S.EVENTS_AFTER),
    "lineitem": (S.ITEMS_BEFORE, S.ITEMS_AFTER),
    "documents": (S.DOCS_EN, S.DOCS_OTHER),
}
ISSUES = """SELECT CAST(check_ord AS INTEGER) AS check_ord, CAST(col_ord AS INTEGER) AS col_ord, drift_type, "column", severity,
  round(metric_value, 6) AS metric_value FROM d"""


def report(pair: tuple[Source, Source], spark, sf) -> DriftReport:
    return DriftReport(*(s.frame(spark, sf) for s in pair))


def shown(issues):
    return issues.select("check_ord", "col_ord", "drift_type", "column", "severity", rounded(F.col("metric_value"), 6).alias("metric_value"))


def _six(frame, *names):
    return frame.withColumns({n: rounded(F.col(n), 6) for n in names})


_RATES = ("baseline_missing_rate", "new_missing_rate", "change")
_RATIOS = ("baseline_unique_ratio", "new_unique_ratio", "change")


def _sql_six(inner: str, names) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in names)}, CAST(col_ord AS INTEGER) AS col_ord) FROM ({inner})"


for _name, _pair in PAIRS.items():
    register(f"drift_issues_{_name}", lambda spark, sf, p=_pair: shown(report(p, spark, sf).issues), f"{D.issues(*_pair)} {ISSUES}")
    register(
        f"drift_missing_{_name}", lambda spark, sf, p=_pair: _six(report(p, spark, sf).missing_table, *_RATES),
        f"{D.sides(*_pair)} {_sql_six(D.missing(*_pair), _RATES)}",
    )
    register(
        f"drift_numeric_psi_{_name}", lambda spark, sf, p=_pair: report(p, spark, sf).numeric_table,
        f"{D.sides(*_pair)} SELECT * REPLACE (CAST(col_ord AS INTEGER) AS col_ord) FROM ({D.numeric(*_pair)})",
    )
    register(
        f"drift_categorical_{_name}", lambda spark, sf, p=_pair: report(p, spark, sf).categorical_table,
        f"{D.sides(*_pair)} SELECT * REPLACE (CAST(col_ord AS INTEGER) AS col_ord) FROM ({D.categorical(*_pair)})",
    )
    register(
        f"drift_cardinality_{_name}", lambda spark, sf, p=_pair: _six(report(p, spark, sf).cardinality_table, *_RATIOS),
        f"{D.sides(*_pair)} {_sql_six(D.cardinality(*_pair), _RATIOS)}",
    )
    _b, _c = _pair
    _shared = len({n for n, _ in _b.columns} & {n for n, _ in _c.columns})
    register(
        f"drift_summary_{_name}", lambda spark, sf, p=_pair: report(p, spark, sf).summary,
        f"""{D.issues(*_pair)}, t AS (SELECT CAST(greatest(0, least(100, 100 - coalesce(sum({D.WEIGHT}), 0))) AS INTEGER) AS drift_score,
              count(*) AS issue_count, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
              count(*) FILTER (severity = 'minor') AS minor FROM d)
            SELECT (SELECT count(*) FROM b) AS baseline_rows, CAST({len(_b.columns)} AS INTEGER) AS baseline_columns,
              (SELECT count(*) FROM c) AS new_rows, CAST({len(_c.columns)} AS INTEGER) AS new_columns, CAST({_shared} AS INTEGER) AS shared_columns,
              t.*, CASE WHEN drift_score >= 85 THEN 'Stable' WHEN drift_score >= 65 THEN 'Moderate drift'
                        WHEN drift_score >= 40 THEN 'High drift' ELSE 'Critical drift' END AS risk_label FROM t""",
    )

_EV = PAIRS["events"]
register(
    "drift_schema", lambda spark, sf: report(_EV, spark, sf).schema_changes,
    f"{D.sides(*_EV)} SELECT * REPLACE (CAST(col_ord AS INTEGER) AS col_ord) FROM ({D.schema(*_EV)})",
)


def _wide(spark, sf):
    """User thresholds where critical lies below warning: critical is lifted to warning."""
    sides = [s.frame(spark, sf) for s in _EV]
    return _six(DriftReport(*sides, missing_warning=0.15, missing_critical=0.10).missing_table, *_RATES)


register("drift_missing_thresholds", _wide, f"{D.sides(*_EV)} {_sql_six(D.missing(*_EV, 0.15, 0.15), _RATES)}")
register(
    "drift_missing_alerts", lambda spark, sf: shown(drift.missing_alerts(report(_EV, spark, sf).issues)),
    f"{D.issues(*_EV)} {ISSUES} WHERE drift_type = 'missing_value_drift'",
)
register(
    "drift_missing_display",
    lambda spark, sf: drift.missing_display(report(PAIRS["events"], spark, sf).missing_table),
    f"""{D.sides(*_EV)} SELECT "column", printf('%.1f%%', baseline_missing_rate * 100) AS baseline_missing_pct,
          printf('%.1f%%', new_missing_rate * 100) AS new_missing_pct, printf('%+.1f%%', change * 100) AS delta_pct,
          baseline_missing_count, new_missing_count, missing_count_delta AS delta_count, severity
        FROM ({D.missing(*_EV)})""",
)
register(
    "drift_compact_issues", lambda spark, sf: shown(drift.compact_drift(report(_EV, spark, sf))["issues"]),
    f"{D.issues(*_EV)} {ISSUES} ORDER BY check_ord, col_ord LIMIT 20",
)
register(
    "drift_compact_numeric",
    lambda spark, sf: drift.compact_drift(report(PAIRS["lineitem"], spark, sf))["numeric_drift"].select("column", "psi", "severity"),
    f"""{D.sides(*PAIRS["lineitem"])} SELECT "column", psi, severity FROM ({D.numeric(*PAIRS["lineitem"])}) ORDER BY psi DESC, col_ord LIMIT 20""",
)
register(
    "drift_families", lambda spark, sf: drift.drift_families(report(_EV, spark, sf).issues),
    f"""{D.issues(*_EV)} SELECT count(*) FILTER (drift_type = 'numeric_distribution_drift') > 0 AS numeric_moved,
          count(*) FILTER (drift_type = 'categorical_distribution_drift') > 0 AS categories_moved,
          count(*) FILTER (drift_type = 'missing_value_drift') > 0 AS missingness_moved,
          count(*) FILTER (drift_type IN ('schema_removed_column', 'schema_dtype_change')) > 0 AS schema_moved,
          count(*) FILTER (drift_type = 'cardinality_drift') > 0 AS cardinality_moved FROM d""",
)
_DOC = PAIRS["documents"]
register(
    "drift_category_changes",
    lambda spark, sf: _six(drift.category_changes(*(s.frame(spark, sf) for s in _DOC), "text"), "baseline_share", "new_share"),
    f"""{D.sides(*_DOC)}, x AS (SELECT text, count(*) AS n FROM ({_DOC[0].duck}) GROUP BY 1), y AS (SELECT text, count(*) AS n FROM ({_DOC[1].duck}) GROUP BY 1)
        SELECT coalesce(x.text, y.text) AS value, coalesce(x.n, 0) AS baseline_n, coalesce(y.n, 0) AS new_n,
          round(coalesce(x.n, 0) / (SELECT sum(n) FROM x), 6) AS baseline_share, round(coalesce(y.n, 0) / (SELECT sum(n) FROM y), 6) AS new_share,
          CASE WHEN x.n IS NULL THEN 'new' WHEN y.n IS NULL THEN 'removed' ELSE 'kept' END AS status
        FROM x FULL JOIN y ON x.text = y.text""",
)
register(
    "chart_psi", lambda spark, sf: chartdata.psi_by_column(report(PAIRS["lineitem"], spark, sf).numeric_table),
    f"""{D.sides(*PAIRS["lineitem"])} SELECT "column", psi, severity FROM ({D.numeric(*PAIRS["lineitem"])})""",
)
register(
    "chart_missing_drift", lambda spark, sf: _six(chartdata.missing_drift_bars(report(_EV, spark, sf).missing_table), "missing_pct"),
    f"""{D.sides(*_EV)}, t AS ({D.missing(*_EV)})
        SELECT "column", 'baseline' AS dataset, round(baseline_missing_rate * 100, 6) AS missing_pct FROM t
        UNION ALL SELECT "column", 'new', round(new_missing_rate * 100, 6) FROM t""",
)
register(
    "chart_category_topn",
    lambda spark, sf: _six(chartdata.category_bars(*(s.frame(spark, sf) for s in _DOC), "source"), "frequency"),
    f"""{D.sides(*_DOC)}, x AS (SELECT source AS k, count(*) / (SELECT count(source) FROM b) AS s FROM b GROUP BY 1),
          y AS (SELECT source AS k, count(*) / (SELECT count(source) FROM c) AS s FROM c GROUP BY 1),
          t AS (SELECT coalesce(x.k, y.k) AS k, coalesce(x.s, 0) AS bs, coalesce(y.s, 0) AS cs FROM x FULL JOIN y ON x.k = y.k
                ORDER BY bs + cs DESC, 1 LIMIT 15)
        SELECT k AS category, 'baseline' AS dataset, round(bs * 100, 6) AS frequency FROM t UNION ALL SELECT k, 'new', round(cs * 100, 6) FROM t""",
)
register(
    "chart_overlay_histogram",
    lambda spark, sf: chartdata.overlay_histogram(*(s.frame(spark, sf) for s in _EV), "value"),
    f"""{D.sides(*_EV)}, u AS (SELECT 'baseline' AS dataset, value AS v FROM b WHERE value IS NOT NULL UNION ALL SELECT 'new', value FROM c WHERE value IS NOT NULL),
          r AS (SELECT min(v) AS lo, max(v) AS hi FROM u)
        SELECT dataset, CAST(least(34, floor((v - lo) / ((hi - lo) / 35))) AS INTEGER) AS bin, count(*) AS n FROM u, r GROUP BY 1, 2""",
)
register(
    "chart_drift_severities", lambda spark, sf: chartdata.severities_present(report(_EV, spark, sf).issues),
    f"{D.issues(*_EV)} SELECT severity, count(*) AS n FROM d GROUP BY 1",
)
register(
    "drift_compact_missing",
    lambda spark, sf: drift.compact_drift(report(_EV, spark, sf))["missing_drift"].select("column", "missing_count_delta", "severity"),
    f"""{D.sides(*_EV)} SELECT "column", missing_count_delta, severity FROM ({D.missing(*_EV)}) ORDER BY col_ord LIMIT 30""",
)
register(
    "drift_compact_categorical",
    lambda spark, sf: drift.compact_drift(report(_DOC, spark, sf))["categorical_drift"].select("column", "new_category_count", "new_dominant", "severity"),
    f"""{D.sides(*_DOC)} SELECT "column", new_category_count, new_dominant, severity FROM ({D.categorical(*_DOC)}) ORDER BY col_ord LIMIT 20""",
)


def _names(spark, sf):
    """Columns of both sides matched by trimmed, lower-case names, repeats numbered in order."""
    sides = [s.frame(spark, sf).toDF(*names) for s, names in zip(S.ITEM_SIDES, S.ITEM_NAMES, strict=True)]
    return DriftReport(*sides).numeric_table.select("column", "baseline_mean", "new_mean")


register("drift_matched_names", _names, f"{D.sides(*S.ITEM_SIDES)} " + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", (SELECT round(avg({c}), 4) FROM b) AS baseline_mean, (SELECT round(avg({c}), 4) FROM c) AS new_mean"""
    for n, c in (("income", "n0"), ("income__1", "n1"), ("a.b", "n2"), ("income__2", "n3"))))
