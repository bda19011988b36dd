"""Drift between a baseline table and a newer one.

Each side is scanned for its facts. Distinct counts and category shifts of both sides come from
one tagged frequency table: the sides are unioned before grouping, so comparing them needs one
shuffle and no join, and a hot category is combined map-side. Numeric drift reads the same table of
the numeric columns (plans/numbers.py): quantiles, the rows between the baseline's decile edges and
distinct counts take one pass over the rows."""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from datavitals.functions.cells import SHORT_TEXT, Field, cell, fields_of, positional, quoted, rounded
from datavitals.functions.normalize import normalize_table
from datavitals.operators.scoring import DRIFT_LABELS, DRIFT_POINTS, SEVERITY_RANK, banded, clamped, points
from datavitals.plans.facts import QUARTILES, TableFacts, first_facts, logical_dtype
from datavitals.plans.frequency import as_text, slots_of
from datavitals.plans.labels import keyed, with_labels
from datavitals.plans.numbers import counted_bins, number_counts, range_sums, tagged_counts, values_at
from datavitals.plans.options import ScanOptions
from datavitals.plans.quantiles import between, number, ranks
from datavitals.plans.together import together
from datavitals.session import stage

DECILES = tuple(i / 10 for i in range(11))
# Floor of a bin's share, number of bins, and the PSI severity bars.
PSI_FLOOR = 1e-6
PSI_BINS = 10
PSI_CRITICAL, PSI_WARNING = 0.25, 0.10
STATS = ("mean", "std_pop", "min", "p25", "median", "p75", "max")


def psi_edges(base: dict, new: dict, deciles: list[float]) -> list[float]:
    """Inner bin edges: distinct baseline deciles, or equal widths when fewer than three differ.

    The outer bins are open, so only inner edges matter; no edges means no drift to measure."""
    edges = sorted(set(deciles))
    if len(edges) < 3:
        low, high = min(base["min"], new["min"]), max(base["max"], new["max"])
        if low == high:
            return []
        step = (high - low) / PSI_BINS
        edges = [low + i * step for i in range(PSI_BINS)] + [high]
    return edges[1:-1]


MOST_BINS = PSI_BINS + 1


def bin_of(c: str, edges: list[float], first: int = 0) -> str:
    """SQL for the number of a value's bin by binary search; bins are closed on the right, the last one is open."""
    if not edges:
        return str(first)
    middle = len(edges) // 2
    low, high = bin_of(c, edges[:middle], first), bin_of(c, edges[middle + 1:], first + middle + 1)
    return f"CASE WHEN {c} <= {number(edges[middle])} THEN {low} ELSE {high} END"


def binned(sides, fields, inner: dict[str, list[float]]) -> DataFrame:
    """Rows (side, place, n): cells counted from the rows by side and place, 11 places a column in the order of `inner`."""
    both = None
    for side in (0, 1):
        places = []
        for i, (name, edges) in enumerate(inner.items()):
            c = fields[side][name].pos
            places.append(f"CASE WHEN {c} IS NOT NULL THEN {i * MOST_BINS} + {bin_of(c, edges)} END")
        part = positional(sides[side]).selectExpr(f"explode(array({', '.join(places)})) AS place").selectExpr(f"{side} AS side", "place")
        both = part if both is None else both.unionByName(part)
    return both.where("place IS NOT NULL").groupBy("side", "place").agg(F.count(F.lit(1)).alias("n"))


class DriftReport:
    """Comparison of two tables; each table of the report is built from facts collected once."""

    def __init__(
        self, baseline: DataFrame, current: DataFrame, options: ScanOptions | None = None,
        missing_warning: float = 0.05, missing_critical: float = 0.20,
    ):
        self.options = options or ScanOptions()
        self.warning, self.critical = missing_warning, max(missing_warning, missing_critical)
        self.spark = baseline.sparkSession
        self.sides = (normalize_table(baseline), normalize_table(current))
        self.fields = tuple({f.name: f for f in fields_of(d)} for d in self.sides)
        self.shared = sorted(set(self.fields[0]) & set(self.fields[1]))
        self.all_names = sorted(set(self.fields[0]) | set(self.fields[1]))

    def _pair(self, name: str) -> tuple[Field, Field]:
        return self.fields[0][name], self.fields[1][name]

    @property
    def numeric(self) -> list[str]:
        return [n for n in self.shared if all(f.numeric for f in self._pair(n))]

    @property
    def categorical(self) -> list[str]:
        numeric = set(self.numeric)
        return [
            n for n in self.shared if n not in numeric and not any(f.kind == "opaque" for f in self._pair(n))
        ]

    # facts: each is collected once, and only for the tables that need it --------------------------

    @cached_property
    def counted(self) -> tuple[TableFacts, TableFacts]:
        """Plain aggregates of both sides."""
        return tuple(together(self.spark, *[lambda d=d: first_facts(d, self.options) for d in self.sides]))

    @cached_property
    def numbers(self) -> list[tuple[list[str], DataFrame, dict]]:
        """Columns that are numbers on either side, a part of them at a time, with their counted values and the sums of their ranges."""
        names = [n for n in self.all_names if any(n in f and f[n].numeric for f in self.fields)]
        out = []
        for start in range(0, len(names), self.options.chunk):
            part = names[start:start + self.options.chunk]
            counts = number_counts(self.sides, self.fields, part)
            out.append((part, counts, range_sums(counts)))
        return out

    @cached_property
    def facts(self) -> tuple[TableFacts, TableFacts]:
        """The same with quantiles; the baseline's deciles are the edges of the PSI bins."""
        probs = (tuple(sorted({*QUARTILES, *DECILES})), QUARTILES)
        for names, counts, sums in self.numbers:
            wanted = {}
            for i, n in enumerate(names):
                for side, facts in enumerate(self.counted):
                    f = self.fields[side].get(n)
                    present = facts.of(f, "present") if f is not None and f.numeric else 0
                    if sum(r["nc" if side else "nb"] for r in sums.get(i, [])) != present:
                        raise ValueError(f"column {n}: the source changed while it was read; stage the table first")
                    if present:
                        wanted[i, side] = (f.ord, [ranks(present, p) for p in probs[side]])
            at = values_at(counts, sums, {k: [r for low, high, _ in asked for r in (low, high)] for k, (_, asked) in wanted.items()})
            for (i, side), (o, asked) in wanted.items():
                value = at[i, side]
                self.counted[side].quantiles[o] = {
                    p: between(value[low], value[high], weight) for p, (low, high, weight) in zip(probs[side], asked, strict=True)}
        return self.counted

    def _shift(self, names: list[str]) -> dict[str, dict]:
        """Columns with long texts apart: they are counted by digest, and few labels are fetched."""
        found = {}
        long = {n for n in names if n in set(self.categorical) and self._longest(n) > SHORT_TEXT}
        for group, table in (([n for n in names if n not in long], shift_table), ([n for n in names if n in long], long_shift_table)):
            for start in range(0, len(group), self.options.chunk):
                part = group[start:start + self.options.chunk]
                rows = table(self.sides, self.fields, part, set(self.categorical), self.counted, self.options).collect()
                found |= {part[r["ord"]]: r.asDict() for r in rows}
        return found

    def _longest(self, name: str) -> int:
        return max(self.counted[side].of(f, "longest") or 0 for side, f in enumerate(self._pair(name)))

    @cached_property
    def shifts(self) -> dict[str, dict]:
        """Category shifts, and the distinct counts of categorical columns."""
        return self._shift(self.categorical)

    @cached_property
    def uniques(self) -> dict[str, dict]:
        """Distinct counts of the numeric columns, from their counted values if there are any."""
        if "numbers" not in self.__dict__:
            return self._shift(self.numeric)
        both = set(self.numeric)
        return {
            n: {name: sum(r[u] for r in sums[i]) for name, u in (("baseline_unique", "ub"), ("new_unique", "uc"))}
            for names, _, sums in self.numbers for i, n in enumerate(names) if n in both and i in sums
        }

    def _collect(self, numeric: bool, shifts: bool, uniques: bool) -> None:
        """Run the passes still missing; numbers and categories side by side."""
        self.counted
        jobs = [lambda: (numeric and self.bins, uniques and self.uniques)] if numeric or uniques else []
        jobs += [lambda: self.shifts] if shifts or uniques else []
        together(self.spark, *jobs)

    @cached_property
    def bins(self) -> dict[str, tuple[list[int], list[int]]]:
        """Rows of each side per PSI bin, read off the counted values."""
        facts, out = self.facts, {}
        for names, counts, _ in self.numbers:
            inner = {}
            for i, n in enumerate(names):
                if n not in self.shared or not all(f.numeric for f in self._pair(n)):
                    continue
                b, c = self._pair(n)
                fb, fc = facts[0].values[b.ord], facts[1].values[c.ord]
                if fb["present"] and fc["present"]:
                    inner[i] = psi_edges(fb, fc, [facts[0].quantiles[b.ord][p] for p in DECILES])
            out |= {names[i]: ([0] * (len(edges) + 1), [0] * (len(edges) + 1)) for i, edges in inner.items()}
            for row in counted_bins(counts, inner).collect() if inner else []:
                for side, s in enumerate(("nb", "nc")):
                    out[names[row["ord"]]][side][row["bin"]] = row[s]
        return out

    # tables: projections of one small relation ------------------------------------------------

    def pairs(self, numeric: bool = False, shifts: bool = False, uniques: bool = False) -> DataFrame:
        """One row per column of either table with the facts of both sides, as far as asked for."""
        if numeric or shifts or uniques:
            self._collect(numeric, shifts, uniques)
        sides = self.counted
        found = {**(self.shifts if shifts or uniques else {}), **(self.uniques if uniques else {})}
        out = []
        for i, n in enumerate(self.all_names):
            row: dict = {"col_ord": i, "column": n}
            row |= {k: v for k, v in found.get(n, {}).items() if k in SHIFT.names}
            for side, prefix in enumerate(("baseline", "new")):
                f = self.fields[side].get(n)
                if f is None:
                    continue
                facts = sides[side]
                v, q = facts.values[f.ord], facts.quantiles.get(f.ord, {})
                row |= {
                    f"{prefix}_dtype": logical_dtype(f, v["missing"], self.options), f"{prefix}_rows": facts.rows,
                    f"{prefix}_missing_count": v["missing"],
                }
                if uniques and f.kind != "opaque":
                    row.setdefault(f"{prefix}_unique", 0)
                if f.numeric:
                    row |= {f"{prefix}_{k}": x for k, x in (
                        ("mean", v["mean"]), ("std_pop", v["std"]), ("min", v["min"]), ("p25", q.get(0.25)),
                        ("median", q.get(0.5)), ("p75", q.get(0.75)), ("max", v["max"]))}
            row["family"] = "numeric" if n in self.numeric else "categorical" if n in self.categorical else None
            row["baseline_bins"], row["new_bins"] = self.bins.get(n, ([], [])) if numeric else ([], [])
            out.append(row)
        frame = self.spark.createDataFrame(pa.Table.from_pylist(out, schema=PAIRS))
        levels = {"{warning}": number(self.warning), "{critical}": number(self.critical)}
        for step in _DERIVED:
            for mark, value in levels.items():
                step = {k: sql.replace(mark, value) for k, sql in step.items()}
            kept = [c for c in frame.columns if c not in step]
            frame = frame.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in step.items()])
        return frame

    def _table(self, pairs: DataFrame, where: str, *columns: str) -> DataFrame:
        return pairs.filter(where).selectExpr("col_ord", "column", *columns)

    @cached_property
    def schema_changes(self) -> DataFrame:
        """Columns added, removed or changed in dtype."""
        return self._table(
            self.pairs(), "schema_drift IS NOT NULL", "baseline_dtype", "new_dtype", "schema_drift AS drift_type", f"{_SCHEMA_LEVEL} AS severity"
        )

    @cached_property
    def missing_table(self) -> DataFrame:
        return self._table(
            self.pairs(), "shared", "baseline_missing_count", "new_missing_count", "new_missing_count - baseline_missing_count AS missing_count_delta",
            "baseline_missing_rate", "new_missing_rate", "missing_change AS change", "missing_level AS severity",
        )

    @cached_property
    def numeric_table(self) -> DataFrame:
        stats = [F.col(f"{p}_{c}") for p in ("baseline", "new") for c in STATS]
        listed = self.pairs(numeric=True).filter("shared AND family = 'numeric'")
        return listed.select("col_ord", "column", "psi", F.col("psi_level").alias("severity"),
                             *[rounded(c).alias(name) for c, name in zip(stats, _STAT_NAMES)])

    @cached_property
    def categorical_table(self) -> DataFrame:
        shift = [n for n in SHIFT.names if n not in ("baseline_unique", "new_unique")]
        return self._table(self.pairs(shifts=True), "shared AND family = 'categorical'", *shift, "category_level AS severity")

    @cached_property
    def cardinality_table(self) -> DataFrame:
        return self._table(
            self.pairs(uniques=True), "shared AND baseline_unique IS NOT NULL AND new_unique IS NOT NULL", "baseline_unique", "new_unique",
            "baseline_unique_ratio", "new_unique_ratio", "unique_change AS change",
        )

    @cached_property
    def issues(self) -> DataFrame:
        rules = ", ".join(_issue(*rule) for rule in _RULES).replace("{warning}", number(self.warning))
        return self.pairs(numeric=True, shifts=True, uniques=True).selectExpr(f"inline(array_compact(array({rules})))").orderBy("check_ord", "col_ord")

    @cached_property
    def summary(self) -> DataFrame:
        base, new = self.counted
        return drift_score(self.issues).select(
            F.lit(base.rows).cast("bigint").alias("baseline_rows"), F.lit(len(base.fields)).alias("baseline_columns"),
            F.lit(new.rows).cast("bigint").alias("new_rows"), F.lit(len(new.fields)).alias("new_columns"),
            F.lit(len(self.shared)).alias("shared_columns"), "*",
        )


def _share(top: str, side: str) -> str:
    return f"{side}_{top} / greatest(1, {side}_rows)"


def _bin_shares(bins: str) -> str:
    total = f"greatest(1, aggregate({bins}, 0L, (a, x) -> a + x))"
    return f"transform({bins}, x -> greatest(x / {total}, {number(PSI_FLOOR)}))"


# What the tables and rules read, derived in order from a pair's facts. A side without values
# has no categories and no PSI.
_DERIVED: tuple[dict[str, str], ...] = (
    {
        "shared": "baseline_dtype IS NOT NULL AND new_dtype IS NOT NULL",
        "schema_drift": """CASE WHEN new_dtype IS NULL THEN 'schema_removed_column' WHEN baseline_dtype IS NULL THEN 'schema_added_column'
            WHEN baseline_dtype <> new_dtype THEN 'schema_dtype_change' END""",
        **{f"{side}_missing_rate": _share("missing_count", side) for side in ("baseline", "new")},
        **{f"{side}_unique_ratio": _share("unique", side) for side in ("baseline", "new")},
        "psi_raw": f"""aggregate(zip_with({_bin_shares("baseline_bins")}, {_bin_shares("new_bins")}, (b, c) -> (c - b) * ln(c / b)),
            0.0D, (a, x) -> a + x)""",
        **{c: f"coalesce({c}, 0L)" for c in ("new_category_count", "removed_category_count")},
        **{c: f"coalesce({c}, 0.0D)" for c in ("baseline_dominant_share", "new_dominant_share", "max_frequency_change")},
        "new_categories": "coalesce(new_categories, '')",
    },
    {
        "missing_change": "new_missing_rate - baseline_missing_rate",
        "unique_change": "new_unique_ratio - baseline_unique_ratio",
        "psi": "signum(psi_raw) * floor(abs(psi_raw) * 10000 + 0.5D) / 10000",
        **{c: f"floor({c} * 10000 + 0.5D) / 10000" for c in ("baseline_dominant_share", "new_dominant_share", "max_frequency_change")},
    },
    {
        "missing_level": """CASE WHEN missing_change >= {critical} THEN 'critical' WHEN missing_change >= {warning} THEN 'warning'
            WHEN missing_change = 0 THEN 'none' ELSE 'minor' END""",
        "psi_level": f"CASE WHEN psi > {PSI_CRITICAL}D THEN 'critical' WHEN psi >= {PSI_WARNING}D THEN 'warning' ELSE 'minor' END",
        "category_level": """CASE WHEN max_frequency_change > 0.30D OR new_category_count >= 10 THEN 'critical'
            WHEN max_frequency_change >= 0.10D OR new_category_count > 0 OR NOT baseline_dominant <=> new_dominant THEN 'warning'
            ELSE 'minor' END""",
    },
)
_SCHEMA_LEVEL = "CASE schema_drift WHEN 'schema_removed_column' THEN 'critical' WHEN 'schema_added_column' THEN 'minor' ELSE 'warning' END"
_STAT_NAMES = [f"{p}_{c}" for p in ("baseline", "new") for c in STATS]

# check number, drift type, condition, severity, value, metric text
_RULES = (
    ("CASE schema_drift WHEN 'schema_removed_column' THEN 2 WHEN 'schema_added_column' THEN 3 ELSE 1 END", "schema_drift",
     "schema_drift IS NOT NULL", _SCHEMA_LEVEL, "NULL",
     """CASE schema_drift WHEN 'schema_removed_column' THEN 'column removed' WHEN 'schema_added_column' THEN 'column added'
        ELSE concat_ws(' -> ', baseline_dtype, new_dtype) END"""),
    ("4", "'missing_value_drift'", "shared AND missing_change >= {warning}", "missing_level", "missing_change",
     "format_string('%.1f%% -> %.1f%% (%+.1f%%)', baseline_missing_rate * 100, new_missing_rate * 100, missing_change * 100)"),
    ("5", "'numeric_distribution_drift'", "shared AND family = 'numeric' AND psi_level <> 'minor'", "psi_level", "psi",
     "format_string('PSI=%.3f', psi)"),
    ("6", "'categorical_distribution_drift'", "shared AND family = 'categorical' AND category_level <> 'minor'", "category_level",
     "max_frequency_change",
     "format_string('max frequency shift=%.1f%%; new categories=%d', max_frequency_change * 100, new_category_count)"),
    ("7", "'cardinality_drift'", "shared AND unique_change >= 0.20D",
     "CASE WHEN unique_change > 0.40D THEN 'critical' ELSE 'warning' END", "unique_change",
     "format_string('unique ratio %.1f%% -> %.1f%%', baseline_unique_ratio * 100, new_unique_ratio * 100)"),
)


def _issue(check: str, kind: str, when: str, severity: str, value: str, metric: str) -> str:
    return (
        f"CASE WHEN {when} THEN struct({check} AS check_ord, col_ord, {kind} AS drift_type, column, {severity} AS severity, "
        f"CAST({value} AS double) AS metric_value, {metric} AS metric) END"
    )


SHIFT = pa.schema([
    ("baseline_unique", pa.int64()), ("new_unique", pa.int64()),
    ("new_category_count", pa.int64()), ("removed_category_count", pa.int64()),
    ("baseline_dominant", pa.string()), ("new_dominant", pa.string()),
    ("baseline_dominant_share", pa.float64()), ("new_dominant_share", pa.float64()),
    ("max_frequency_change", pa.float64()), ("new_categories", pa.string()),
])
PAIRS = pa.schema([
    ("col_ord", pa.int32()), ("column", pa.string()), ("family", pa.string()),
    *[(f"{p}_{c}", t) for p in ("baseline", "new") for c, t in (
        ("dtype", pa.string()), ("rows", pa.int64()), ("missing_count", pa.int64()),
        *[(c, pa.float64()) for c in STATS], ("bins", pa.list_(pa.int64())))],
    *SHIFT,
])


def shift_table(sides, fields, wanted, categorical: set[str], facts, options: ScanOptions) -> DataFrame:
    entries = tuple(
        [(i, "label", as_text(f, f.pos)) if n in categorical else (i, f.slot, f.pos) for i, n in enumerate(wanted) for f in [fields[side][n]]]
        for side in (0, 1))
    slots = slots_of({kind for side in entries for _, kind, _ in side})
    freq = tagged_counts(sides, entries, slots)
    uniques = {"baseline_unique": "count_if(nb > 0)", "new_unique": "count_if(nc > 0)"}
    if not categorical & set(wanted):
        return freq.groupBy("ord").agg(*[F.expr(e).alias(k) for k, e in uniques.items()])

    shared, totals = _shares(freq, fields, wanted, facts), uniques | _SHIFT_TOTALS
    per = shared.groupBy("ord").agg(*[F.expr(e).alias(k) for k, e in totals.items()])
    # Largest counts first, which hash aggregation finds, then the first label among the rows that reach them;
    # the looked-up side has one row per column.
    leading = shared.join(F.broadcast(per.select("ord", "top_b", "top_c")), "ord").filter("(nb > 0 AND nb = top_b) OR (nc > 0 AND nc = top_c)")
    dominant = leading.groupBy("ord").agg(
        F.expr("min(CASE WHEN nb > 0 AND nb = top_b THEN text END)").alias("baseline_dominant"),
        F.expr("min(CASE WHEN nc > 0 AND nc = top_c THEN text END)").alias("new_dominant"))
    # Only the first ten new labels are listed; the window's rank limit is applied map-side. The
    # filter reads both counts, so that this branch reuses the frequency shuffle above.
    listed = (
        shared.filter("nb = 0 AND nc > 0 AND text IS NOT NULL")
        .selectExpr("ord", "text", "row_number() OVER (PARTITION BY ord ORDER BY text) AS rank").filter("rank <= 10")
        .groupBy("ord").agg(F.expr("array_join(array_sort(collect_list(text)), ', ')").alias("new_categories"))
    )
    return per.drop("top_b", "top_c").join(dominant, "ord", "left").join(listed, "ord", "left")


_SHIFT_TOTALS = {
    "new_category_count": "count_if(nb = 0)", "removed_category_count": "count_if(nc = 0)",
    "top_b": "max(nb)", "top_c": "max(nc)",
    "baseline_dominant_share": "max(b)", "new_dominant_share": "max(c)", "max_frequency_change": "max(abs(c - b))",
}


def _shares(freq: DataFrame, fields, wanted: list[str], facts) -> DataFrame:
    """Add each category's share of its column's present rows on both sides."""
    def share(n: str, side: int) -> str:
        totals = ", ".join(f"{i}, {facts[side].of(fields[side][x], 'present')}L" for i, x in enumerate(wanted))
        return f"coalesce(try_divide({n}, map({totals})[ord]), 0.0D)"

    return freq.selectExpr("*", f"{share('nb', 0)} AS b", f"{share('nc', 1)} AS c")


def long_shift_table(sides, fields, wanted, categorical: set[str], facts, options: ScanOptions) -> DataFrame:
    """As shift_table, for categorical columns with long texts (plans/labels.py). The staged frequencies have a key and a head
    for each category; the dominant and the first ten new ones are found by head and then read."""
    values = None
    for side in (0, 1):
        entries = ", ".join(f"struct({i} AS ord, {as_text(f, f.pos)} AS value)" for i, f in enumerate(fields[side][n] for n in wanted))
        part = positional(sides[side]).selectExpr(f"inline(array({entries}))").selectExpr("*", f"{side} AS side")
        values = part if values is None else values.unionByName(part)
    values = values.where("value IS NOT NULL")
    freq = stage(values.selectExpr("ord", "side", *keyed("value")).groupBy("ord", "long", "key", "head").agg(
        F.expr("count_if(side = 0)").alias("nb"), F.expr("count_if(side = 1)").alias("nc")), "frequencies")
    uniques = {"baseline_unique": "count_if(nb > 0)", "new_unique": "count_if(nc > 0)"}
    totals = uniques | _SHIFT_TOTALS
    per = _shares(freq, fields, wanted, facts).groupBy("ord").agg(*[F.expr(e).alias(k) for k, e in totals.items()])
    leads = {"lead_b": "nb > 0 AND nb = top_b", "lead_c": "nc > 0 AND nc = top_c"}
    leading = freq.join(F.broadcast(per.select("ord", "top_b", "top_c")), "ord").where(" OR ".join(f"({x})" for x in leads.values()))
    heads = leading.groupBy("ord").agg(*[F.expr(f"min(CASE WHEN {x} THEN head END)").alias(f"{k}_head") for k, x in leads.items()])
    first = leading.join(F.broadcast(heads), "ord").selectExpr(
        "ord", "long", "key", *[f"{x} AND head = {k}_head AS {k}" for k, x in leads.items()], "false AS listed").where("lead_b OR lead_c")
    new = freq.where("nb = 0").selectExpr("ord", "long", "key", "rank() OVER (PARTITION BY ord ORDER BY head) AS rank").where("rank <= 10")
    new = new.selectExpr("ord", "long", "key", "false AS lead_b", "false AS lead_c", "true AS listed")
    named = stage(with_labels(first.unionByName(new), values.select("ord", "value")), "labels")
    dominant = named.groupBy("ord").agg(*[
        F.expr(f"min(CASE WHEN {k} THEN value END)").alias(alias) for k, alias in (("lead_b", "baseline_dominant"), ("lead_c", "new_dominant"))])
    listed = named.where("listed").selectExpr("ord", "value", "row_number() OVER (PARTITION BY ord ORDER BY value) AS rank").where("rank <= 10")
    listed = listed.groupBy("ord").agg(F.expr("array_join(array_sort(collect_list(value)), ', ')").alias("new_categories"))
    return per.drop("top_b", "top_c").join(dominant, "ord", "left").join(listed, "ord", "left")


def compare_datasets(baseline: DataFrame, current: DataFrame, options: ScanOptions | None = None, **thresholds) -> DriftReport:
    return DriftReport(baseline, current, options, **thresholds)


def drift_score(issues: DataFrame) -> DataFrame:
    """One row: drift_score, risk_label and the severity counts (no severity counts as minor)."""
    severity = F.coalesce("severity", F.lit("minor"))
    return issues.agg(
        clamped(F.sum(points(DRIFT_POINTS))).alias("drift_score"), F.count(F.lit(1)).alias("issue_count"),
        *[F.count_if(severity == s).alias(s) for s in SEVERITY_RANK],
    ).withColumn("risk_label", banded(F.col("drift_score"), DRIFT_LABELS))


def missing_alerts(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("drift_type") == "missing_value_drift")


def missing_display(table: DataFrame) -> DataFrame:
    """The missing-drift table as shown to people: percentages as text beside the raw counts."""

    def percent(c: str, sign: str = "") -> Column:
        return F.format_string(f"%{sign}.1f%%", F.col(c) * 100)

    return table.select(
        "column", percent("baseline_missing_rate").alias("baseline_missing_pct"),
        percent("new_missing_rate").alias("new_missing_pct"), percent("change", "+").alias("delta_pct"),
        "baseline_missing_count", "new_missing_count", F.col("missing_count_delta").alias("delta_count"), "severity",
    )


def compact_drift(report: DriftReport) -> dict[str, DataFrame]:
    """The report cut to what a reader looks at first: 20 issues, 30 missing rows, the 20
    highest PSI values and 20 categorical rows."""
    return {
        "issues": report.issues.orderBy("check_ord", "col_ord").limit(20),
        "missing_drift": report.missing_table.orderBy("col_ord").limit(30),
        "numeric_drift": report.numeric_table.orderBy(F.desc("psi"), "col_ord").limit(20),
        "categorical_drift": report.categorical_table.orderBy("col_ord").limit(20),
    }


def drift_families(issues: DataFrame) -> DataFrame:
    """One row of flags: which kinds of drift were found."""

    def any_of(*kinds: str) -> Column:
        return F.coalesce(F.bool_or(F.col("drift_type").isin(*kinds)), F.lit(False))

    return issues.agg(
        any_of("numeric_distribution_drift").alias("numeric_moved"),
        any_of("categorical_distribution_drift").alias("categories_moved"),
        any_of("missing_value_drift").alias("missingness_moved"),
        any_of("schema_removed_column", "schema_dtype_change").alias("schema_moved"),
        any_of("cardinality_drift").alias("cardinality_moved"),
    )


def category_changes(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Every category of one column with its share on each side and whether it is new, removed
    or kept; whole labels, one row per category."""
    sides = []
    for side, df in enumerate((baseline, current)):
        f = next(f for f in fields_of(df) if f.name == column)
        sides.append(df.selectExpr(f"{as_text(f, quoted(column))} AS value", f"{side} AS side"))
    freq = sides[0].unionByName(sides[1]).filter("value is not null").groupBy("value").agg(
        F.count_if(F.col("side") == 0).alias("baseline_n"), F.count_if(F.col("side") == 1).alias("new_n")
    )
    counts = baseline.agg(F.count(cell(column))), current.agg(F.count(cell(column)))
    base_share = F.coalesce(F.try_divide(F.col("baseline_n"), counts[0].scalar()), F.lit(0.0))
    new_share = F.coalesce(F.try_divide(F.col("new_n"), counts[1].scalar()), F.lit(0.0))
    status = F.when(F.col("baseline_n") == 0, "new").when(F.col("new_n") == 0, "removed").otherwise("kept")
    return freq.select(
        "value", "baseline_n", "new_n", base_share.alias("baseline_share"), new_share.alias("new_share"),
        status.alias("status"),
    )
