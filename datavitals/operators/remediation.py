"""One conservative fix per issue type, previews, and accumulated fixes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from datavitals.functions.cells import (
    Field, cell, fields_of, group_key, number_or_null, quoted, short_key, stripped, timestamp_or_null,
)
from datavitals.functions.times import time_formats
from datavitals.operators.checks import Scan
from datavitals.operators.cleaning import compare_scans, fill_with
from datavitals.operators.profile import top_values
from datavitals.plans.facts import iqr_fences, table_facts, without_repeats
from datavitals.plans.options import ScanOptions
from datavitals.session import stage

NO_FIX = "no safe fix for this issue"
OTHER, UNKNOWN, KEPT_CATEGORIES, RARE_SHARE = "OTHER", "UNKNOWN", 20, 0.01

Fixed = tuple[DataFrame, list[str]]


def _field(df: DataFrame, column: str) -> Field | None:
    return next((f for f in fields_of(df) if f.name == column), None)


def _replace(df: DataFrame, column: str, value) -> DataFrame:
    return df.select(*[(value if n == column else cell(n)).alias(n) for n in df.columns])


def _column_facts(df: DataFrame, column: str, options: ScanOptions, probs=(0.25, 0.5, 0.75)):
    one = df.select(cell(column).alias(column))
    return table_facts(one, options=options, unique="none", probs=probs, fences=False)


def drop_duplicate_rows(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    # Staged, because the re-scan that follows would otherwise repeat the shuffle in every pass.
    return stage(without_repeats(df), "deduplicated"), ["duplicate rows dropped"]


def fill_missing(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    f = _field(df, column)
    if f.numeric:
        facts = _column_facts(df, column, options, (0.5,))
        if facts.quantiles:
            filled = fill_with(df, {column: facts.quantiles[0][0.5]})
            return filled, [f"{column}: gaps filled with the median"]
    common = top_values(df, column, 1).select("value").first()
    if common is not None:
        value = F.coalesce(cell(column), F.lit(common["value"]))
    else:
        value = F.coalesce(cell(column).cast("string"), F.lit(UNKNOWN))
    return _replace(df, column, value), [f"{column}: gaps filled with the most frequent value"]


def drop_constant(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    return df.drop(cell(column)), [f"{column}: constant, dropped"]


def drop_feature(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    return df.drop(cell(column)), [f"{column}: dropped from the features"]


def _key(df: DataFrame, column: str) -> Column:
    """A cell as it is compared with a broadcast list: long texts by digest, so that the list is bounded in bytes too."""
    f = _field(df, column)
    return F.expr(short_key(quoted(column))) if f is not None and f.kind == "string" else cell(column)


def _keep_listed(df: DataFrame, column: str, kept: DataFrame, keep_null: bool) -> DataFrame:
    """Values whose key is not in the kept list become OTHER. The list is broadcast: both callers bound it
    (20 values, or at most 100 since each holds 1% of the rows)."""
    names = df.columns
    listed = F.broadcast(kept.select(F.col("key").alias("__kept")))
    joined = df.join(listed, _key(df, column) == F.col("__kept"), "left")
    known = F.col("__kept").isNotNull()
    if keep_null:
        known = known | cell(column).isNull()
    value = F.when(known, cell(column)).otherwise(F.lit(OTHER))
    return joined.select(*[(value if n == column else cell(n)).alias(n) for n in names])


def group_rare_categories(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    top = top_values(df, column, KEPT_CATEGORIES)
    kept = top.select(_key(top, "value").alias("key"))
    return _keep_listed(df, column, kept, keep_null=False), [f"{column}: all but the most frequent categories pooled"]


def group_minorities(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    bar = max(2.0, df.count() * RARE_SHARE)
    counts = df.select(_key(df, column).alias("key")).filter("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("n")
    )
    kept = counts.filter(F.col("n") >= bar)
    return _keep_listed(df, column, kept, keep_null=True), [f"{column}: rare categories pooled"]


def cap_outliers(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    f = _field(df, column)
    if not f.numeric:
        return df, []
    facts = _column_facts(df, column, options)
    limits = iqr_fences(facts, facts.fields[0])
    if facts.of(facts.fields[0], "present") < 4 or limits is None:
        return df, []
    v = cell(column).cast("double")
    capped = F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(limits[0])), F.lit(limits[1])))
    return _replace(df, column, capped), [f"{column}: capped at the IQR fences"]


def text_to_number(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    digits = f"replace({stripped(f'CAST({quoted(column)} AS string)')}, ',', '')"
    return _replace(df, column, F.expr(number_or_null(digits))), [
        f"{column}: read as numbers, what does not parse is missing"
    ]


def split_timestamp(df: DataFrame, column: str, options: ScanOptions) -> Fixed:
    f = _field(df, column)
    if f.kind == "string":
        written = time_formats(df.select(cell(column).alias("c0")), ["c0"])["c0"]
        when = F.expr(timestamp_or_null(quoted(column), options.timestamp_formats, written))
    elif f.numeric:   # numbers are read as nanoseconds since the epoch
        when = F.timestamp_micros((cell(column) / 1000).cast("bigint"))
    else:
        when = cell(column)
    out = df.withColumns({f"{column}_dayofweek": F.weekday(when), f"{column}_hour": F.hour(when)})
    return out.drop(cell(column)), [
        f"{column}: replaced by weekday and hour"
    ]


FIXES: dict[str, Callable[[DataFrame, str, ScanOptions], Fixed]] = {
    "duplicate_rows": drop_duplicate_rows,
    "missing_values": fill_missing,
    "constant_column": drop_constant,
    "high_cardinality_categorical": group_rare_categories,
    "numeric_outliers_iqr": cap_outliers,
    "likely_id_column": drop_feature,
    "too_many_unique_values": drop_feature,
    "potential_target_leakage": drop_feature,
    "possible_wrong_dtype": text_to_number,
    "imbalanced_categorical": group_minorities,
    "suspicious_timestamp_granularity": split_timestamp,
}


def apply_issue_fix(df: DataFrame, issue: Mapping, options: ScanOptions | None = None) -> Fixed:
    """The fixed table and what was done. Issues without a safe fix leave the table as it is.

    A table with names that differ only in case is fixed under numbered names."""
    issue = issue.asDict() if hasattr(issue, "asDict") else issue
    fix, column = FIXES.get(issue["issue_type"]), issue.get("column")
    if fix is None or (column != "dataset" and column not in df.columns):
        return df, [NO_FIX]
    options = options or ScanOptions()
    if len({n.lower() for n in df.columns}) == len(df.columns):
        fixed, actions = fix(df, column, options)
        return fixed, actions or [NO_FIX]
    given = {f"column_{i}_": n for i, n in enumerate(df.columns)}
    inside = column if column == "dataset" else f"column_{df.columns.index(column)}_"
    fixed, actions = fix(df.toDF(*given), inside, options)

    def outside(text: str) -> str:
        return reduce(lambda t, pair: t.replace(*pair), given.items(), text)

    return fixed.toDF(*[outside(n) for n in fixed.columns]), [outside(a) for a in actions] or [NO_FIX]


def preview_issue_fix(df: DataFrame, issue: Mapping, roles=None, options: ScanOptions | None = None) -> tuple[DataFrame, Fixed]:
    """One row of totals before and after a fix, and the fixed table with its actions. The second scan reads only what the fix touched."""
    before = Scan(df, roles, options)
    fixed, actions = apply_issue_fix(df, issue, options)
    if _issue_type(issue) == "duplicate_rows":
        actions = [f"duplicate rows dropped: {before.facts.duplicate_rows}"]
    return compare_scans(before, before.after(fixed, touched_columns(df, fixed, issue)), ("before", "after")), (fixed, actions)


def touched_columns(df: DataFrame, fixed: DataFrame, issue: Mapping) -> set[str] | None:
    """The columns whose values a fix may have changed or made; None if it dropped rows."""
    if fixed is df:
        return set()
    if _issue_type(issue) == "duplicate_rows" or issue["column"] == "dataset":
        return None
    return {issue["column"], *(set(fixed.columns) - set(df.columns))}


def _issue_type(issue: Mapping) -> str:
    return issue["issue_type"]


def apply_fixes(df: DataFrame, issues: Iterable[Mapping], options: ScanOptions | None = None, stage_every: int = 6) -> Fixed:
    """Apply fixes one after the other. The working table is staged every few fixes, so the plan
    stays short and a lost executor repeats a few fixes at most."""

    def step(state: tuple[DataFrame, list[str], int], issue: Mapping):
        table, log, applied = state
        table, actions = apply_issue_fix(table, issue, options)
        applied += actions != [NO_FIX]
        if applied and applied % stage_every == 0 and actions != [NO_FIX]:
            table = stage(table, "fixes")
        return table, log + actions, applied

    fixed, log, _ = reduce(step, issues, (df, [], 0))
    return fixed, log


# Fixes the guidance suggests but no scan applies by itself ------------------------------------


def flag_and_fill(df: DataFrame, column: str, options: ScanOptions | None = None) -> DataFrame:
    """Keep a "was missing" flag beside the filled column."""
    c = cell(column)
    f = _field(df, column)
    missing = c.isNull() | F.isnan(c) if f.kind == "floating" else c.isNull()
    flagged = df.withColumn(f"{column}_was_missing", missing)
    return fill_missing(flagged, column, options or ScanOptions())[0]


def labelled_rows(df: DataFrame, target: str) -> DataFrame:
    return df.filter(cell(target).isNotNull())


TASK_ROWS = 1_000_000   # rows of one key that a task may hold
HOT_KEYS = 100_000      # most keys looked up by broadcast


def repeated_key_rows(df: DataFrame, keys: list[str], hot_share: float | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every copy of the rows whose key occurs more than once (NULL keys equal each other).

    Keys are counted with map-side combining and staged. A key of more than `task_rows` rows (or, if it is given, of `hot_share` of all) is looked up by broadcast, so that its rows
    stay where they are; the bar rises with the table so that there can be no more than 100,000 such keys. All
    others meet in a shuffled semi join, where no key has more rows than the bar. Texts are compared by digest, nested
    cells in canonical form."""
    fields = fields_of(df)
    cells = [f.pos for f in fields]
    chosen = [next(f for f in fields if f.name == k) for k in keys]
    names = [f"k{i}" for i in range(len(chosen))]
    table = df.toDF(*cells).selectExpr("*", *[f"{group_key(f)} AS {n}" for f, n in zip(chosen, names)])
    counts = stage(table.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-keys")
    rows = df.count()
    bar = max(task_rows if hot_share is None else max(2, int(rows * hot_share)), rows // HOT_KEYS)

    def match(other: DataFrame):
        return reduce(lambda a, b: a & b, [table[n].eqNullSafe(other[f"{n}_"]) for n in names])

    def keyed(where: str) -> DataFrame:
        return counts.filter(where).select(*[F.col(n).alias(f"{n}_") for n in names])

    hot, rest = F.broadcast(keyed(f"n > {bar}")), keyed(f"n <= {bar}")
    found = table.join(rest, match(rest), "left_semi")
    if counts.filter(f"n > {bar}").isEmpty():
        return found.select(*cells).toDF(*df.columns)
    # rows of hot keys leave before the shuffle of the others
    others = table.join(hot, match(hot), "left_anti")
    found = table.join(hot, match(hot), "left_semi").unionByName(others.join(rest, match(rest), "left_semi"))
    return found.select(*cells).toDF(*df.columns)
