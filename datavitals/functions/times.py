"""How a text column writes its times: one way for the whole column, by vote.

Each value's mask (digits as 9, letters as a) is counted; the most frequent mask that belongs to a known way of writing decides the
shape. Where several ways share it, as month and day do, the one that reads more values wins, and the first listed one a tie, which
puts the month first: 03/04/2024 is the fourth of March unless a column has more values such as 13/04/2024."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datavitals.functions.cells import WRITTEN_TIMES, stripped, written_time

LONGEST = 32   # characters; longer texts are no dates in any listed way


_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = (("9999", "\x01"), ("999", "\x02"), ("99", "\x03"), ("9", "\x03"))


def mask(clean: str) -> str:
    """Digits as 9 and letters as a or A, runs of up to two digits alike: 3/14/2024 and 12/1/2024 have one mask. Runs of five digits
    and of six have one too, which no way of writing has. No regular expressions: every value of a column is masked."""
    out = f"translate({clean}, '{_DIGITS}{_SMALL}{_LARGE}\x01\x02\x03', '{'9' * 10}{'a' * 26}{'A' * 26}???')"
    for run, mark in _RUNS:
        out = f"replace({out}, '{run}', '{mark}')"
    for run, mark in _RUNS[:3]:
        out = f"replace({out}, '{mark}', '{run}')"
    return out


def _sample(written: str) -> str:
    """The mask of a way of writing."""
    text = written
    for mark, shown in (("yyyy", "9999"), ("MMM", "Aaa"), ("MM", "99"), ("dd", "99"), ("mm", "99"), ("ss", "99"), ("M", "99"), ("d", "99"), ("H", "99")):
        text = text.replace(mark, shown)
    return text


_BY_MASK: dict[str, list[str]] = {}
for _written in WRITTEN_TIMES:
    _BY_MASK.setdefault(_sample(_written), []).append(_written)


def time_formats(cells: DataFrame, columns: list[str]) -> dict[str, str]:
    """For each text column "ISO" or a key of WRITTEN_TIMES. Two small jobs for all columns: masks are counted, then, where the
    winning mask has several readings, the values that each of them reads."""
    if not columns:
        return {}
    entries = ", ".join(f"struct({i} AS ord, CASE WHEN length({c}) <= {LONGEST} THEN {mask(stripped(c))} END AS mask)" for i, c in enumerate(columns))
    known = [*_BY_MASK, "9999-99-99"]
    counts = cells.selectExpr(f"inline(array({entries}))").selectExpr(
        "ord", "CASE WHEN startswith(mask, '9999-99-99') THEN '9999-99-99' ELSE mask END AS mask").where(F.col("mask").isin(*known))
    best: dict[str, str] = {}
    for r in counts.groupBy("ord", "mask").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mask").collect():  # a few known masks a column
        best.setdefault(columns[r["ord"]], r["mask"])
    ways = {c: _BY_MASK.get(best.get(c, ""), ["ISO"]) for c in columns}
    open_ = {c: w for c, w in ways.items() if len(w) > 1}
    if open_:
        row = cells.selectExpr(*[f"count({written_time(stripped(c), w)}) AS `{c}:{i}`" for c, ws in open_.items() for i, w in enumerate(ws)]).first()
        for c, ws in open_.items():
            ways[c] = [max(ws, key=lambda w: row[f"{c}:{ws.index(w)}"])]
    return {c: w[0] for c, w in ways.items()}
