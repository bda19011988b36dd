"""Column facts: everything the checks, drift and profiles need to know about a table.

A scan is a few Spark jobs that each return one row per column, never user rows:

  1. one pass of map-side aggregates (counts, moments, text shapes), nothing shuffled but one
     partial row per task;
  2. exact distinct counts, top counts and text shapes from the long frequency table
     (plans/frequency.py);
  3. quantiles of numeric columns by narrowing (plans/quantiles.py);
  4. one pass that counts values outside the IQR fences.

The rows become a small local relation on which all rules run as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from datavitals.functions import names
from datavitals.functions.cells import (
    Field, fields_of, group_key, number_or_null, positional, stripped, timestamp_or_null,
)
from datavitals.functions.shape import read_shape, shape_of, shape_totals
from datavitals.functions.times import time_formats
from datavitals.plans.frequency import field_frequencies, per_column
from datavitals.plans.options import ScanOptions
from datavitals.plans.quantiles import SourceChanged, between, number, rank_values, ranks
from datavitals.plans.together import together
from datavitals.roles import Roles
from datavitals.session import stage

QUARTILES = (0.25, 0.5, 0.75)
_NO_TIMES = None      # stands for "no check looks at timestamps"
_PARSED = 1_000_000   # ord offset of a text column's parsed timestamps in the frequency table


@dataclass
class TableFacts:
    rows: int
    fields: list[Field]
    values: dict[int, dict]               # ord -> fact name -> value
    quantiles: dict[int, dict[float, float]]
    duplicate_rows: int | None = None
    key_rows: int | None = None           # rows whose entity key is complete
    key_duplicates: int | None = None

    def of(self, f: Field, name: str):
        return self.values[f.ord].get(name)

    def by_name(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


def _first_pass(f: Field) -> dict[str, str]:
    out = {"present": f"count({f.pos})"}
    if f.numeric:
        v = f"CAST({f.pos} AS double)"
        out |= {"mean": f"avg({v})", "std": f"stddev_pop({v})", "min": f"min({v})", "max": f"max({v})", "differs": f"min({f.pos}) < max({f.pos})"}
        if f.kind == "floating":
            out["all_integral"] = f"bool_and({v} % 1 = 0)"
    if f.kind == "string":
        out["longest"] = f"max(octet_length({f.pos}))"
    if f.kind == "boolean":
        out |= {"min": f"CAST(min(int({f.pos})) AS double)", "max": f"CAST(max(int({f.pos})) AS double)"}
    return out


def one_row(cells: DataFrame, wanted: dict[int, dict[str, str]], chunk: int) -> tuple[int, dict[int, dict]]:
    """Run per-column aggregates, `chunk` columns per job; returns the row count and the values."""
    ords = list(wanted)
    rows, values = 0, {}
    for start in range(0, max(1, len(ords)), chunk):
        part = ords[start:start + chunk]
        aggs = [f"{sql} AS `{o}:{name}`" for o in part for name, sql in wanted[o].items()]
        row = cells.selectExpr("count(1) AS rows", *aggs).first()
        rows = row["rows"]
        for o in part:
            values[o] = {name: row[f"{o}:{name}"] for name in wanted[o]}
    return rows, values


def looks_like_time(f: Field) -> bool:
    return names.name_has(f.name, names.TIME_FRAGMENTS)


def first_facts(df: DataFrame, options: ScanOptions) -> TableFacts:
    """Row count and the plain aggregates of every column: one pass, nothing shuffled."""
    fields = fields_of(df)
    rows, values = one_row(positional(df), {f.ord: _first_pass(f) for f in fields}, options.chunk)
    for v in values.values():
        v["missing"] = rows - v["present"]
    return TableFacts(rows, fields, values, {})


def add_counts(df: DataFrame, facts: TableFacts, counted: list[Field], roles: Roles, options: ScanOptions) -> None:
    """Add exact distinct and top counts and text shapes of the `counted` fields."""
    texts = parsed_time_fields(facts, roles)
    formats = time_formats(positional(df), [f.pos for f in texts])
    timed = {_PARSED + f.ord: timestamp_or_null(f.pos, options.timestamp_formats, formats[f.pos]) for f in texts}
    if not counted and not timed:
        return
    longest = {f.ord: facts.of(f, "longest") for f in counted}
    cells = positional(df)

    def count(fields: list[Field], times: dict[int, str]) -> dict[int, dict]:
        freq = field_frequencies(cells, fields, longest, times)
        return {row["ord"]: row.asDict() for row in per_column(*freq).collect()}

    # Text and numbers apart: rows of numbers stay narrow, and their keys have a fixed width.
    # Wide tables take several jobs, so that generated code keeps to a size the JVM compiles.
    jobs = []
    for group in ([f for f in counted if f.kind == "string"], [f for f in counted if f.kind != "string"]):
        jobs += [(group[i:i + options.chunk], {}) for i in range(0, len(group), options.chunk)]
    if timed:
        jobs = [*jobs[:-1], (jobs[-1][0], timed)] if jobs else [([], timed)]
    found = {}
    for part in together(df.sparkSession, *[lambda j=j: count(*j) for j in jobs]):
        found |= part
    for f in counted:
        row = found.get(f.ord, {})
        facts.values[f.ord] |= {"n_unique": row.get("n_unique") or 0, "top_n": row.get("top_n") or 0}
        facts.values[f.ord] |= read_shape(row)
    for f in parsed_time_fields(facts, roles):
        row = found.get(_PARSED + f.ord, {})
        facts.values[f.ord] |= {"parsed": row.get("known") or 0, "parsed_unique": row.get("n_unique") or 0}


def add_quantiles(df: DataFrame, facts: TableFacts, probs: tuple[float, ...], options: ScanOptions) -> None:
    """Add exact quantiles of all numeric fields."""
    numeric = [f for f in facts.fields if f.numeric and facts.of(f, "present")]
    if not numeric or not probs:
        return
    present = {f.pos: facts.of(f, "present") for f in numeric}
    asked = {f.pos: [r for p in probs for r in ranks(present[f.pos], p)[:2]] for f in numeric}
    ends = {f.pos: (facts.of(f, "min"), facts.of(f, "max")) for f in numeric}
    try:
        answers = rank_values(positional(df), asked, ends, present, options)
    except SourceChanged as error:
        name = next(f.name for f in numeric if f.pos == error.pos)
        raise ValueError(f"column {name}: the source changed while it was read; stage the table first") from error
    for f in numeric:
        facts.quantiles[f.ord] = _interpolate(answers[f.pos], present[f.pos], probs)


def table_facts(
    df: DataFrame,
    roles: Roles | None = None,
    options: ScanOptions | None = None,
    unique: str = "rules",
    probs: tuple[float, ...] = QUARTILES,
    fences: bool = True,
    keys: bool = False,
) -> TableFacts:
    """Collect facts. `unique` says which columns need exact distinct counts: "none", "rules" (all, and
    text columns' timestamps too) or "all". `keys` adds duplicate rows and key repeats.

    Counts and quantiles do not need each other, so their jobs run side by side; so do the
    duplicate checks (which the counts may spare) and the fences (which need the quantiles)."""
    roles, options = roles or Roles(), options or ScanOptions()
    facts = first_facts(df, options)
    if not facts.fields:
        facts.rows = 0
    counted = [f for f in facts.fields if _needs_unique(f, facts, unique)] if facts.rows else []

    def counts() -> None:
        add_counts(df, facts, counted, roles if unique == "rules" else _NO_TIMES, options)

    def repeats() -> None:
        count_duplicates(df, facts, options)
        count_key_duplicates(df, facts, roles)

    first = ([counts] if counted else []) + ([lambda: add_quantiles(df, facts, probs, options)] if probs else [])
    then = ([repeats] if keys else []) + ([lambda: _last_pass(positional(df), facts, roles, options)] if fences else [])
    for jobs in (first if facts.rows else [], then):
        together(df.sparkSession, *jobs)
    return facts


def refreshed_facts(
    df: DataFrame, before: TableFacts, changed: set[str], roles: Roles | None = None, options: ScanOptions | None = None, unique: str = "rules",
) -> TableFacts:
    """Facts of a table whose rows are those of `before` with other values in the `changed` columns alone; columns may have come or gone.

    Only changed and new columns are read again; the others' facts stay. Repeated rows depend on all columns and are
    counted again, unless a column that is all distinct spares it, as are repeats of a key that has a changed column."""
    roles, options = roles or Roles(), options or ScanOptions()
    fields, old = fields_of(df), {f.name: f for f in before.fields}
    if not before.rows or len({f.name for f in fields}) < len(fields) or len(old) < len(before.fields):
        return table_facts(df, roles, options, unique, keys=True)
    fresh = [f for f in fields if f.name in changed or f.name not in old or old[f.name].type != f.type]
    facts = TableFacts(before.rows, fields, {}, {})
    if fresh:
        part = df.toDF(*[f.pos for f in fields]).select(*[f.pos for f in fresh]).toDF(*[f.name for f in fresh])
        read = table_facts(part, roles, options, unique)
        for f, seen in zip(fresh, read.fields, strict=True):
            facts.values[f.ord] = read.values[seen.ord]
            facts.quantiles |= {f.ord: read.quantiles[seen.ord]} if seen.ord in read.quantiles else {}
    for f in fields:
        if f.ord not in facts.values:
            facts.values[f.ord] = dict(before.values[old[f.name].ord])
            facts.quantiles |= {f.ord: before.quantiles[old[f.name].ord]} if old[f.name].ord in before.quantiles else {}
    count_duplicates(df, facts, options)
    keys = {k for k in (roles.entity_id, roles.timestamp) if k}
    if keys & ({f.name for f in fresh} | (set(old) - {f.name for f in fields})):
        count_key_duplicates(df, facts, roles)
    else:
        facts.key_rows, facts.key_duplicates = before.key_rows, before.key_duplicates
    return facts


def _needs_unique(f: Field, facts: TableFacts, unique: str) -> bool:
    return f.kind != "opaque" and unique != "none" and bool(facts.of(f, "present"))


def parsed_time_fields(facts: TableFacts, roles: Roles | None) -> list[Field]:
    """Text columns whose values are tried as timestamps."""
    if facts.rows < 10 or roles is _NO_TIMES:
        return []
    return [f for f in facts.fields if f.kind == "string" and looks_like_time(f) and f.name != roles.timestamp]


def _interpolate(by_rank: dict[int, float], present: int, probs) -> dict[float, float]:
    out = {}
    for p in probs:
        low, high, weight = ranks(present, p)
        out[p] = between(by_rank[low], by_rank[high], weight)
    return out


def iqr_fences(facts: TableFacts, f: Field) -> tuple[float, float] | None:
    q = facts.quantiles.get(f.ord)
    if not q or q[0.75] - q[0.25] == 0:
        return None
    iqr = q[0.75] - q[0.25]
    return q[0.25] - 1.5 * iqr, q[0.75] + 1.5 * iqr


def _last_pass(cells: DataFrame, facts: TableFacts, roles: Roles, options: ScanOptions) -> None:
    """Counts that need the first passes: values outside the fences, and the text shape of the
    few numeric columns that are nearly unique without an identifier's name."""
    wanted: dict[int, dict[str, str]] = {}
    for f in facts.fields if facts.rows else []:
        v = facts.values[f.ord]
        aggs = {}
        if f.numeric and (limits := iqr_fences(facts, f)):
            low, high = (number(x) for x in limits)
            aggs["outside"] = f"count_if({f.pos} < {low} OR {f.pos} > {high})"
        nearly_unique = (v.get("n_unique") or 0) >= 0.95 * facts.rows
        shaped = f.numeric and nearly_unique and f.name not in roles.ml_excluded \
            and not names.name_has(f.name, names.IDENTIFIER_FRAGMENTS) \
            and (f.kind == "integral" or looks_like_time(f))
        if shaped:
            shape = shape_of(f"CAST({f.pos} AS string)")
            cells = cells.selectExpr("*", *[f"{e} AS {f.pos}_{k}" for k, e in shape.items()])
            aggs |= {f"shape:{k}": e for k, e in shape_totals("1", f"{f.pos}_").items()}
        if f.kind == "string" and nearly_unique and v["num_present"] >= 10:
            value = number_or_null(stripped(f.pos))
            aggs["num_between"] = f"count_if({value} > {number(v['num_min'])} AND {value} < {number(v['num_max'])})"
            # mergeable moments: no difference of large squares, and not a number where a value is infinite
            aggs |= {"num_mean": f"avg({value})", "num_std": f"stddev_pop({value})"}
        if aggs:
            wanted[f.ord] = aggs
    if wanted:
        _, found = one_row(cells, wanted, options.chunk)
        for o, extra in found.items():
            shape = {k[6:]: x for k, x in extra.items() if k.startswith("shape:")}
            facts.values[o] |= {k: x for k, x in extra.items() if not k.startswith("shape:")}
            facts.values[o] |= {k: x for k, x in read_shape(shape).items() if not k.startswith("num")}


def row_keys(fields: list[Field]) -> list[str]:
    return [f"{group_key(f)} AS {f.pos}" for f in fields]


def _repeats(keys: DataFrame) -> tuple[int, int]:
    """(rows, rows beyond the first of their key), NULL equal to NULL."""
    per_key = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n"))
    row = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys")).first()
    return row["rows"], row["rows"] - row["keys"]


def count_duplicates(df: DataFrame, facts: TableFacts, options: ScanOptions | None = None) -> None:
    """Duplicate rows. A column without nulls that is all distinct proves there are none, which
    spares keyed tables the only full-width shuffle of a scan."""
    proven = any(facts.of(f, "n_unique") == facts.rows for f in facts.fields)
    if proven or facts.rows == 0 or not facts.fields:
        facts.duplicate_rows = 0
        return
    keys = positional(df).selectExpr(*row_keys(facts.fields))
    repeated, some = repeated_hashes(keys, keys.columns)
    facts.duplicate_rows = 0
    if some:
        hashed = keys.selectExpr("*", *hashed_row(keys.columns))
        facts.duplicate_rows = _repeats(hashed.join(repeated, ["h1", "h2"], "left_semi").select(*keys.columns))[1]


BROADCAST_HASHES = 1_000_000   # 16 bytes each


def repeated_hashes(table: DataFrame, keys: list[str], most: int | None = None) -> tuple[DataFrame, bool]:
    """The row hashes that occur more than once, and whether there are any.

    Only 16 bytes a row are shuffled, once: the repeated hashes are staged, and broadcast if they have been counted
    to be few. Beyond that a shuffled semi join finds their rows; it may split a hash with many copies."""
    per_hash = table.selectExpr(*hashed_row(keys)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    repeated = stage(per_hash, "repeats")
    many = repeated.count()
    return (F.broadcast(repeated) if many <= (BROADCAST_HASHES if most is None else most) else repeated), many > 0


def without_repeats(df: DataFrame, most: int | None = None) -> DataFrame:
    """The table with one row of each set of equal rows, equal as `count_duplicates` counts them: NaN is missing, maps have no order.

    Rows whose hash occurs once stay where they are; only the others meet, after each task has dropped its own repeats."""
    fields = fields_of(df)
    cells = {f.pos: f"CASE WHEN NOT isnan({f.pos}) THEN {f.pos} END" if f.stored in ("float", "double") else f.pos for f in fields}
    keys = [f"k{f.ord}" for f in fields]
    table = df.toDF(*cells).selectExpr("*", *[
        f"{group_key(f) if f.kind in ('string', 'opaque') else cells[f.pos]} AS k{f.ord}" for f in fields])
    repeated, some = repeated_hashes(table, keys, most)
    if not some:
        return df
    table = table.selectExpr("*", *hashed_row(keys))
    once = table.join(repeated, ["h1", "h2"], "left_anti").select(*cells)
    more = table.join(repeated, ["h1", "h2"], "left_semi").dropDuplicates(keys).select(*cells)
    return once.unionByName(more).toDF(*df.columns)


def hashed_row(cols: list[str]) -> list[str]:
    """128 bits per row: two 64-bit hashes over opposite column orders, each led by a null mask
    (xxhash64 skips NULLs, so without it (NULL, x) and (x, NULL) would meet)."""
    mask = "concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in cols) + ")"
    return [f"xxhash64({mask}, {', '.join(cols)}) AS h1", f"xxhash64({', '.join(reversed(cols))}, {mask}, 1) AS h2"]


def count_key_duplicates(df: DataFrame, facts: TableFacts, roles: Roles) -> None:
    """Repeats of the configured entity (+ timestamp) key among rows where it is complete."""
    entity = facts.by_name(roles.entity_id) if roles.entity_id else None
    if entity is None or facts.rows < 2:
        return
    when = facts.by_name(roles.timestamp) if roles.timestamp else None
    key = [entity] + ([when] if when and when is not entity else [])
    if facts.of(entity, "n_unique") == facts.rows and len(key) == 1:
        facts.key_rows, facts.key_duplicates = facts.rows, 0
        return
    cells = positional(df).select(*[f.pos for f in key]).na.drop(subset=[f.pos for f in key])
    facts.key_rows, facts.key_duplicates = _repeats(cells.selectExpr(*row_keys(key)))


METRICS = pa.schema([
    ("col_ord", pa.int32()), ("column", pa.string()), ("dtype", pa.string()), ("kind", pa.string()),
    ("rows", pa.int64()), ("missing", pa.int64()), ("missing_rate", pa.float64()),
    ("n_unique", pa.int64()), ("unique_ratio", pa.float64()),
    ("mean", pa.float64()), ("std_pop", pa.float64()), ("min", pa.float64()), ("p25", pa.float64()),
    ("median", pa.float64()), ("p75", pa.float64()), ("max", pa.float64()), ("outlier_rate", pa.float64()),
    ("differs", pa.bool_()), ("top_n", pa.int64()), ("numeric_like_rate", pa.float64()),
    ("median_ge8", pa.bool_()), ("median_ge30", pa.bool_()),
    ("compact_rate", pa.float64()), ("mixed_rate", pa.float64()), ("sep_rate", pa.float64()),
    ("uuid_rate", pa.float64()), ("all_integral", pa.bool_()),
    ("num_present", pa.int64()), ("num_mean", pa.float64()), ("num_std", pa.float64()),
    ("num_distinct_gt2", pa.bool_()), ("parsed", pa.int64()), ("parsed_unique", pa.int64()),
    ("duplicate_rows", pa.int64()), ("key_rows", pa.int64()), ("key_duplicates", pa.int64()),
])


def _metrics_row(facts: TableFacts, f: Field, options: ScanOptions) -> dict:
    v, rows = facts.values[f.ord], facts.rows
    q = facts.quantiles.get(f.ord, {})
    present, n_unique = v["present"], v.get("n_unique")
    if not present and f.kind != "opaque":
        n_unique = 0
    row = {
        "col_ord": f.ord, "column": f.name, "kind": f.kind, "rows": rows,
        "dtype": logical_dtype(f, v["missing"], options),
        "missing": v["missing"], "missing_rate": v["missing"] / rows if rows else 0.0,
        "n_unique": n_unique, "unique_ratio": None if n_unique is None else n_unique / max(1, rows),
        "outlier_rate": v["outside"] / present if "outside" in v else None,
        "p25": q.get(0.25), "median": q.get(0.5), "p75": q.get(0.75),
        "all_integral": present > 0 if f.kind == "integral" else v.get("all_integral"),
        "duplicate_rows": None, "key_rows": facts.key_rows, "key_duplicates": facts.key_duplicates,
    }
    if f.numeric:
        row |= {"mean": v["mean"], "std_pop": v["std"], "min": v["min"], "max": v["max"]}
        row |= {"num_present": present, "num_mean": v["mean"], "num_std": v["std"],
                "num_distinct_gt2": None if n_unique is None else n_unique > 2}
    elif f.kind == "string":
        row |= {"num_distinct_gt2": (v.get("num_between") or 0) > 0}
    for name in METRICS.names:
        row.setdefault(name, v.get(name))
    return row


def logical_dtype(f: Field, missing: int, options: ScanOptions) -> str:
    if options.dtype_mode == "pandas" and f.kind == "integral" and missing:
        return "float64"
    return f.dtype


def metrics_frame(spark, facts: TableFacts, options: ScanOptions | None = None, with_dataset: bool = False) -> DataFrame:
    """Facts as a local relation of one row per column (plus one "dataset" row for the rules)."""
    options = options or ScanOptions()
    out = [_metrics_row(facts, f, options) for f in facts.fields]
    if with_dataset:
        blank = dict.fromkeys(METRICS.names)
        out.append(blank | {
            "col_ord": -1, "column": "dataset", "kind": "dataset", "rows": facts.rows,
            "duplicate_rows": facts.duplicate_rows,
        })
    return spark.createDataFrame(pa.Table.from_pylist(out, schema=METRICS))
