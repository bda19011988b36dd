"""Long frequency tables: one row per (column, value) with its count.

Every distinct count, top share, mode and category comparison comes from this one shape. The
columns are unpivoted into typed slots (whole number, float, decimal, text) so a single scan and a
single shuffle serve all of them, and Spark's map-side partial aggregation collapses a hot value
to one row per task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from datavitals.functions.cells import SHORT_TEXT, Field, fields_of, literal, positional, short_key, stripped
from datavitals.functions.shape import SHAPE, shape_of, shape_totals

SLOTS = {"whole": "bigint", "real": "double", "fixed": "string", "text": "string"}


def has_value(slots: list[str]) -> str:
    return "(" + " OR ".join(f"{s} IS NOT NULL" for s in slots) + ")"


def _slot_value(kind: str, c: str) -> tuple[str, str]:
    if kind in ("integral", "boolean"):
        return "whole", f"CAST({c} AS bigint)"
    if kind == "floating":
        return "real", f"CAST({c} AS double)"
    if kind == "decimal":   # as text, since a double holds only 53 bits of it
        return "fixed", f"CAST({c} AS string)"
    if kind == "date":
        return "whole", f"CAST(unix_date({c}) AS bigint)"
    if kind == "timestamp":
        return "whole", f"unix_micros({c})"
    if kind == "timestamp_ntz":
        # Wall-clock time has no instant; counting it in parts keeps the session's zone out.
        seconds = f"CAST(unix_date(CAST({c} AS date)) AS bigint) * 86400 + hour({c}) * 3600 + minute({c}) * 60"
        return "whole", f"({seconds}) * 1000000 + CAST(extract(SECOND FROM {c}) * 1000000 AS bigint)"
    return "text", f"CAST({c} AS string)"


def slots_of(kinds: Iterable[str]) -> list[str]:
    """The slots that columns of these kinds fill; the others are left out of the shuffle."""
    used = {_slot_value(k, "x")[0] for k in kinds}
    return [s for s in SLOTS if s in used]


def slot_struct(ord_: int, kind: str, c: str, slots: list[str], digest: bool = False, shape: dict[str, str] | None = None) -> str:
    """One (column, value) entry as SQL, with `digest` grouping a text by its short key."""
    slot, value = _slot_value(kind, short_key(c) if digest else c)
    cells = [f"CAST({value if s == slot else 'NULL'} AS {SLOTS[s]}) AS {s}" for s in slots]
    shapes = [f"CAST({shape[k]} AS {t}) AS {k}" for k, t in SHAPE.items()] if shape is not None else []
    return f"struct({', '.join([f'{ord_} AS ord', *cells, *shapes])})"


def field_frequencies(
    cells: DataFrame, fields: list[Field], longest: dict[int, int], timed: dict[int, str] | None = None
) -> tuple[DataFrame, list[str], bool]:
    """(ord, slots..., n) of the given fields over a positional table, the slots, and whether the
    rows carry shapes. `longest` gives each text column's longest value in bytes; `timed` adds
    timestamp expressions under their own ord.

    A column with long texts is grouped by digest, which loses their shape, so that travels along
    as three small columns. A short text's shape is read off its group later: once per distinct
    value instead of once per row."""
    timed = timed or {}
    long = {f.ord for f in fields if f.kind == "string" and (longest.get(f.ord) or 0) > SHORT_TEXT}
    slots = slots_of([f.slot for f in fields] + ["timestamp"] * bool(timed))
    if long:
        cells = cells.selectExpr("*", *[
            f"CASE WHEN octet_length(c{o}) > {SHORT_TEXT} THEN {stripped(f'c{o}')} END AS c{o}_long" for o in long
        ])
    blank = dict.fromkeys(SHAPE, "NULL") if long else None
    entries = [
        slot_struct(f.ord, f.slot, f.pos, slots, f.ord in long, shape_of(f"{f.pos}_long") if f.ord in long else blank)
        for f in fields
    ]
    entries += [slot_struct(o, "timestamp", sql, slots, shape=blank) for o, sql in timed.items()]
    freq = (
        cells.selectExpr(f"inline(array({', '.join(entries)}))")
        .groupBy("ord", *slots).agg(F.expr("count(1)").alias("n"), *[F.max(k).alias(k) for k in (SHAPE if long else ())])
    )
    return freq, slots, bool(long)


def per_column(freq: DataFrame, slots: list[str], shaped: bool) -> DataFrame:
    """Per column: distinct non-null values, the largest count, the non-null rows, the shape."""
    totals = {"n_unique": "count(known)", "top_n": "max(known)", "known": "coalesce(sum(known), 0)"}
    freq = freq.selectExpr("*", f"CASE WHEN {has_value(slots)} THEN n END AS known")
    if "text" in slots:
        shape = shape_of("clean")
        freq = freq.selectExpr("*", f"{stripped('text')} AS clean").selectExpr(
            "ord", "known", *[f"coalesce({k}, {shape[k]}) AS {k}" if shaped else f"{shape[k]} AS {k}" for k in SHAPE]
        )
        totals |= shape_totals("known")
    return freq.groupBy("ord").agg(*[F.expr(e).alias(k) for k, e in totals.items()])


def value_freq(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Public frequency table: (column, value, n), missing cells as a NULL value.

    Values are shown as text, in full; columns without a plain text form are left out."""
    fields = [f for f in fields_of(df) if f.kind != "opaque" and (columns is None or f.name in columns)]
    entries = [f"struct({literal(f.name)} AS column, {as_text(f, f.pos)} AS value)" for f in fields]
    long = positional(df).selectExpr(f"inline(array({', '.join(entries)}))")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def as_text(field: Field, c: str) -> str:
    # Adding 0.0 turns -0.0 into 0.0, so both print alike.
    return f"CAST({c} + 0.0D AS string)" if field.kind == "floating" and field.stored != "decimal" else f"CAST({c} AS string)"
