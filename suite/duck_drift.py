"""Reference SQL for the drift queries, written for DuckDB."""

from __future__ import annotations

from suite.duck import normalized
from suite.sources import Source

DTYPE = {"int": "int64", "float": "float64", "str": "object", "bool": "bool", "ts": "datetime64[ns]"}
STATS = ("mean", "std_pop", "min", "p25", "median", "p75", "max")


def _side(s: Source) -> str:
    cells = [f'{normalized(n) if k == "str" else n} AS {n}' for n, k in s.columns]
    return f"SELECT {', '.join(cells)} FROM ({s.duck})"


def _kinds(b: Source, c: Source) -> list[tuple[str, str, str]]:
    left, right = dict(b.columns), dict(c.columns)
    return [(n, left[n], right[n]) for n in sorted(set(left) & set(right))]


def _ords(b: Source, c: Source) -> dict[str, int]:
    return {n: i for i, n in enumerate(sorted({n for n, _ in (*b.columns, *c.columns)}))}


def _numeric(b: Source, c: Source) -> list[str]:
    return [n for n, x, y in _kinds(b, c) if {x, y} <= {"int", "float"}]


def _categorical(b: Source, c: Source) -> list[str]:
    return [n for n, x, y in _kinds(b, c) if not {x, y} <= {"int", "float"}]


def sides(b: Source, c: Source) -> str:
    return f"WITH b AS MATERIALIZED ({_side(b)}), c AS MATERIALIZED ({_side(c)})"


def schema(b: Source, c: Source) -> str:
    left, right, ords = dict(b.columns), dict(c.columns), _ords(b, c)
    out = []
    for n in ords:
        x, y = DTYPE.get(left.get(n, "")), DTYPE.get(right.get(n, ""))
        if x == y:
            continue
        kind, sev = ("schema_removed_column", "critical") if y is None else ("schema_added_column", "minor") if x is None else ("schema_dtype_change", "warning")
        out.append(f"""SELECT {ords[n]} AS col_ord, '{n}' AS "column", {f"'{x}'" if x else 'NULL'} AS baseline_dtype,
                         {f"'{y}'" if y else 'NULL'} AS new_dtype, '{kind}' AS drift_type, '{sev}' AS severity
                       FROM (SELECT (SELECT count(*) FROM b) + (SELECT count(*) FROM c) AS n) WHERE n > 0""")
    return " UNION ALL ".join(out)


def missing(b: Source, c: Source, warn: float = 0.05, crit: float = 0.20) -> str:
    ords = _ords(b, c)
    parts = [f"""SELECT {ords[n]} AS col_ord, '{n}' AS "column",
        (SELECT count(*) - count({n}) FROM b) AS bm, (SELECT count(*) - count({n}) FROM c) AS nm,
        (SELECT count(*) FROM b) AS br, (SELECT count(*) FROM c) AS nr""" for n, _, _ in _kinds(b, c)]
    return f"""SELECT col_ord, "column", bm AS baseline_missing_count, nm AS new_missing_count, nm - bm AS missing_count_delta,
        bm / greatest(1, br) AS baseline_missing_rate, nm / greatest(1, nr) AS new_missing_rate,
        nm / greatest(1, nr) - bm / greatest(1, br) AS change,
        CASE WHEN nm / greatest(1, nr) - bm / greatest(1, br) >= {crit} THEN 'critical'
             WHEN nm / greatest(1, nr) - bm / greatest(1, br) >= {warn} THEN 'warning'
             WHEN nm / greatest(1, nr) - bm / greatest(1, br) = 0 THEN 'none' ELSE 'minor' END AS severity
      FROM ({" UNION ALL ".join(parts)})"""


def _psi(n: str) -> str:
    return f"""(WITH bv AS (SELECT {n}::DOUBLE AS v FROM b WHERE {n} IS NOT NULL), cv AS (SELECT {n}::DOUBLE AS v FROM c WHERE {n} IS NOT NULL),
      q AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM bv),
      lim AS (SELECT least((SELECT min(v) FROM bv), (SELECT min(v) FROM cv)) AS lo, greatest((SELECT max(v) FROM bv), (SELECT max(v) FROM cv)) AS hi),
      inner_edges AS (SELECT CASE WHEN len(e) >= 3 THEN e[2:len(e) - 1] WHEN lo = hi THEN []
          ELSE [lo + i * ((hi - lo) / 10) for i in range(1, 10)] END AS e FROM q, lim),
      grid AS (SELECT unnest(range(0, len(e) + 1)) AS bin FROM inner_edges),
      bb AS (SELECT len(list_filter(e, lambda x: x < v)) AS bin, count(*) AS n FROM bv, inner_edges GROUP BY 1),
      cc AS (SELECT len(list_filter(e, lambda x: x < v)) AS bin, count(*) AS n FROM cv, inner_edges GROUP BY 1),
      p AS (SELECT greatest(coalesce(bb.n, 0) / greatest(1, (SELECT count(*) FROM bv)), 1e-6) AS pb,
                   greatest(coalesce(cc.n, 0) / greatest(1, (SELECT count(*) FROM cv)), 1e-6) AS pc
            FROM grid LEFT JOIN bb USING (bin) LEFT JOIN cc USING (bin))
      SELECT CASE WHEN (SELECT count(*) FROM bv) = 0 OR (SELECT count(*) FROM cv) = 0 THEN 0.0
             ELSE round(sum((pc - pb) * ln(pc / pb)), 4) END FROM p)"""


def _stats(n: str, side: str, prefix: str) -> str:
    v = f"{n}::DOUBLE"
    exprs = (f"avg({v})", f"stddev_pop({v})", f"min({v})", f"quantile_cont({v}, 0.25)", f"quantile_cont({v}, 0.5)",
             f"quantile_cont({v}, 0.75)", f"max({v})")
    return ", ".join(f"(SELECT round({e}, 4) FROM {side}) AS {prefix}_{k}" for e, k in zip(exprs, STATS))


def numeric(b: Source, c: Source) -> str:
    ords = _ords(b, c)
    parts = [f"""SELECT {ords[n]} AS col_ord, '{n}' AS "column", {_psi(n)} AS psi, {_stats(n, "b", "baseline")}, {_stats(n, "c", "new")}"""
             for n in _numeric(b, c)]
    return f"""SELECT *, CASE WHEN psi > 0.25 THEN 'critical' WHEN psi >= 0.10 THEN 'warning' ELSE 'minor' END AS severity
               FROM ({" UNION ALL ".join(parts)})"""


def _label(n: str) -> str:
    return f"{n}::VARCHAR"


def categorical(b: Source, c: Source) -> str:
    ords, parts = _ords(b, c), []
    for n in _categorical(b, c):
        parts.append(f"""
        SELECT {ords[n]} AS col_ord, '{n}' AS "column", s.* FROM (
          WITH x AS (SELECT {_label(n)} AS k, count(*) AS n FROM b WHERE {n} IS NOT NULL GROUP BY 1),
               y AS (SELECT {_label(n)} AS k, count(*) AS n FROM c WHERE {n} IS NOT NULL GROUP BY 1),
               z AS (SELECT coalesce(x.k, y.k) AS k, x.n AS bn, y.n AS cn,
                       coalesce(x.n / (SELECT sum(n) FROM x), 0) AS bf, coalesce(y.n / (SELECT sum(n) FROM y), 0) AS cf
                     FROM x FULL JOIN y ON x.k = y.k)
          SELECT count(*) FILTER (bn IS NULL) AS new_category_count, count(*) FILTER (cn IS NULL) AS removed_category_count,
            (SELECT k FROM x ORDER BY n DESC, k LIMIT 1) AS baseline_dominant, (SELECT k FROM y ORDER BY n DESC, k LIMIT 1) AS new_dominant,
            round(max(bf), 4) AS baseline_dominant_share, round(max(cf), 4) AS new_dominant_share,
            round(max(abs(cf - bf)), 4) AS max_frequency_change,
            coalesce((SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT k FROM z WHERE bn IS NULL ORDER BY k LIMIT 10)), '') AS new_categories
          FROM z) s""")
    return f"""SELECT *, CASE WHEN max_frequency_change > 0.30 OR new_category_count >= 10 THEN 'critical'
        WHEN max_frequency_change >= 0.10 OR new_category_count > 0 OR baseline_dominant IS DISTINCT FROM new_dominant THEN 'warning'
        ELSE 'minor' END AS severity FROM ({" UNION ALL ".join(parts)})"""


def cardinality(b: Source, c: Source) -> str:
    ords = _ords(b, c)
    parts = [f"""SELECT {ords[n]} AS col_ord, '{n}' AS "column", (SELECT count(DISTINCT {n}) FROM b) AS baseline_unique,
        (SELECT count(DISTINCT {n}) FROM c) AS new_unique, (SELECT count(*) FROM b) AS br, (SELECT count(*) FROM c) AS nr"""
             for n, _, _ in _kinds(b, c)]
    return f"""SELECT col_ord, "column", baseline_unique, new_unique, baseline_unique / greatest(1, br) AS baseline_unique_ratio,
        new_unique / greatest(1, nr) AS new_unique_ratio, new_unique / greatest(1, nr) - baseline_unique / greatest(1, br) AS change
      FROM ({" UNION ALL ".join(parts)})"""


def issues(b: Source, c: Source) -> str:
    """Drift issues as `d`, after sides()."""
    return f"""{sides(b, c)}, d AS (
      SELECT CASE drift_type WHEN 'schema_dtype_change' THEN 1 WHEN 'schema_removed_column' THEN 2 ELSE 3 END AS check_ord,
             col_ord, drift_type, "column", severity, NULL::DOUBLE AS metric_value
      FROM ({schema(b, c) or "SELECT 0 AS col_ord, '' AS 'column', '' AS drift_type, '' AS severity WHERE false"})
      UNION ALL SELECT 4, col_ord, 'missing_value_drift', "column", severity, change FROM ({missing(b, c)}) WHERE change >= 0.05
      UNION ALL SELECT 5, col_ord, 'numeric_distribution_drift', "column", severity, psi FROM ({numeric(b, c)}) WHERE severity IN ('warning', 'critical')
      UNION ALL SELECT 6, col_ord, 'categorical_distribution_drift', "column", severity, max_frequency_change FROM ({categorical(b, c)})
        WHERE severity IN ('warning', 'critical')
      UNION ALL SELECT 7, col_ord, 'cardinality_drift', "column", CASE WHEN change > 0.40 THEN 'critical' ELSE 'warning' END, change
        FROM ({cardinality(b, c)}) WHERE change >= 0.20)"""


WEIGHT = "CASE severity WHEN 'critical' THEN 18 WHEN 'warning' THEN 7 WHEN 'minor' THEN 2 ELSE 0 END"
