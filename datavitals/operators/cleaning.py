"""Conservative whole-table cleaning, with scores before and after."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, functions as F

from datavitals.functions.cells import Field, fields_of, positional
from datavitals.operators.checks import Scan
from datavitals.operators.scoring import clamped, points
from datavitals.plans.facts import TableFacts, count_duplicates, one_row, table_facts, without_repeats
from datavitals.plans.options import ScanOptions
from datavitals.session import stage


@dataclass
class Cleaned:
    df: DataFrame
    actions: list[str] = dc_field(default_factory=list)
    dropped_rows: int = 0
    filled: dict[str, float] = dc_field(default_factory=dict)
    removed_columns: list[str] = dc_field(default_factory=list)


def fill_with(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Fill NULL and NaN of numeric columns; whole-number columns become doubles, since a median
    may end in .5."""
    out = []
    for f in fields_of(df):
        c = F.col(f.pos)
        if f.name in fills:
            v = c.cast("double")
            c = F.coalesce(F.when(~F.isnan(v), v), F.lit(float(fills[f.name])))
        out.append(c.alias(f.pos))
    return df.toDF(*[f.pos for f in fields_of(df)]).select(*out).toDF(*df.columns)


def constant_fields(df: DataFrame, facts: TableFacts, filled: set[str], options: ScanOptions) -> list[Field]:
    """Columns holding one value and no NULL once the fills are in. Smallest = largest, compared in the
    column's own type, decides it in one pass without counting distinct values."""
    whole = [f for f in facts.fields if f.kind != "opaque" and (facts.of(f, "missing") == 0 or f.name in filled)]
    wanted = {f.ord: {"same": f"min({f.pos}) = max({f.pos})"} for f in whole}
    found = one_row(positional(df), wanted, options.chunk)[1] if wanted else {}
    return [f for f in whole if found[f.ord]["same"]]


def simulate_cleaning(
    df: DataFrame, drop_duplicates: bool = True, fill_numeric_median: bool = True,
    remove_constant_columns: bool = True, before: Scan | None = None, options: ScanOptions | None = None,
) -> Cleaned:
    """Drop duplicate rows, then fill numeric gaps with the medians of what is left, then drop
    columns that are constant after the fill.

    A scan of the same table, when given, already knows the number of duplicates. Only when there
    are some is the table shuffled, and then it is staged once: every later pass reads columns of
    the staged files instead of repeating the shuffle."""
    options = options or ScanOptions()
    done = Cleaned(df)
    if drop_duplicates:
        facts = before.facts if before else table_facts(df, options=options, unique="none", probs=(), fences=False)
        if facts.duplicate_rows is None:
            count_duplicates(df, facts, options)
        if facts.duplicate_rows:
            done.df = stage(without_repeats(done.df), "deduplicated")
            done.dropped_rows = facts.duplicate_rows
            done.actions.append(f"duplicate rows dropped: {done.dropped_rows}")
    facts = table_facts(
        done.df, options=options, unique="none", probs=(0.5,) if fill_numeric_median else (), fences=False
    )
    if facts.rows and fill_numeric_median:
        done.filled = {
            f.name: facts.quantiles[f.ord][0.5]
            for f in facts.fields if f.numeric and facts.of(f, "missing") and facts.of(f, "present")
        }
        if done.filled:
            done.df = fill_with(done.df, done.filled)
            done.actions.append(f"gaps filled with the median: {', '.join(done.filled)}")
    if facts.rows and remove_constant_columns:
        done.removed_columns = [f.name for f in constant_fields(done.df, facts, set(done.filled), options)]
        if done.removed_columns:
            keep = [f for f in fields_of(done.df) if f.name not in done.removed_columns]
            numbered = done.df.toDF(*[f.pos for f in fields_of(done.df)])
            done.df = numbered.select(*[f.pos for f in keep]).toDF(*[f.name for f in keep])
            done.actions.append(f"constant columns dropped: {', '.join(done.removed_columns)}")
    if not done.actions:
        done.actions.append("nothing to clean")
    return done


def rescan(before: Scan, done: Cleaned) -> Scan:
    """The scan of a cleaned table: unless rows were dropped, only filled columns are read again."""
    return before.after(done.df, None if done.dropped_rows else set(done.filled))


def scan_totals(scan: Scan, prefix: str) -> DataFrame:
    """One row: rows, columns, missing cells, score and issue count of a scan."""
    facts = scan.facts
    missing = sum(facts.of(f, "missing") for f in facts.fields)
    return scan.issues.agg(
        F.lit(facts.rows).cast("bigint").alias(f"{prefix}_rows"), F.lit(len(facts.fields)).alias(f"{prefix}_columns"),
        F.lit(missing).cast("bigint").alias(f"{prefix}_missing"),
        clamped(F.sum(points())).alias(f"{prefix}_score"), F.count(F.lit(1)).alias(f"{prefix}_issue_count"),
    )


def compare_scans(before: Scan, after: Scan, names=("original", "cleaned")) -> DataFrame:
    """One row with both scans' totals and the gain in score. Both inputs are one-row aggregates."""
    rows = [scan_totals(s, n).first().asDict() for s, n in zip((before, after), names)]
    row = rows[0] | rows[1]
    row["improvement"] = row[f"{names[1]}_score"] - row[f"{names[0]}_score"]
    spark = before.df.sparkSession
    schema = ", ".join(f"`{k}` {'int' if k.endswith(('score', 'columns')) or k == 'improvement' else 'bigint'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def compare_cleaning(original: DataFrame, cleaned: DataFrame, roles=None, options: ScanOptions | None = None) -> DataFrame:
    return compare_scans(Scan(original, roles, options), Scan(cleaned, roles, options))


def health_delta(baseline: DataFrame, batch: DataFrame, roles=None, options: ScanOptions | None = None) -> DataFrame:
    """Health of a baseline and of a new batch, and the difference."""
    return compare_scans(Scan(baseline, roles, options), Scan(batch, roles, options), ("baseline", "batch"))
