"""Exact linear-interpolated quantiles that never hold a whole column in one task.

Spark's percentile() keeps every distinct value of a column in one reducer's memory. Here a
column is narrowed around each wanted rank first:

* a histogram of equal-width buckets (map-side combined, a few rows per column) tells which
  bucket holds the rank and how many rows lie below it; this repeats inside the bucket;
* where equal widths stop helping (heavy tails), a mergeable rank sketch, merged in two levels,
  proposes the next interval and a map-side count places the rank in it;
* once few enough rows are left, they are grouped by value and walked in order.

Buckets and sketches only propose; ranks are always counted, so the answer is exact."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from datavitals.plans.options import ScanOptions

MERGE_GROUPS = 256   # first-level merge groups of the sketches
BUCKETS = 1024       # equal-width buckets per interval and round


def ranks(present: int, p: float) -> tuple[int, int, float]:
    """Zero-based ranks around quantile p of `present` values, and the weight of the upper."""
    at = (present - 1) * p
    low = math.floor(at)
    return low, min(low + 1, present - 1), at - low


def between(low: float, high: float, weight: float) -> float:
    """Linear interpolation, computed from the nearer end so both ends are hit exactly."""
    step = high - low
    return low + step * weight if weight < 0.5 else high - step * (1.0 - weight)


def number(x: float) -> str:
    """A double as an exact SQL literal."""
    return f"double('{x!r}')" if math.isinf(x) or math.isnan(x) else f"{x!r}D"


class SourceChanged(ValueError):
    """A pass found other rows than the one before, so that no rank can be settled."""

    def __init__(self, pos: str):
        super().__init__(f"{pos}: the source changed between two passes")
        self.pos = pos


@dataclass(eq=False)
class _Target:
    """One wanted rank and the open value interval (low, high) known to hold it."""

    pos: str
    rank: int
    inner: int                  # rows strictly inside the interval
    low: float | None = None
    high: float | None = None
    base: int = 0               # rows at or below `low`
    answer: float | None = None

    @property
    def value(self) -> str:
        return f"CAST({self.pos} AS double)"

    def inside(self) -> str:
        tests = [f"{self.pos} IS NOT NULL"]
        if self.low is not None:
            tests.append(f"{self.value} > {number(self.low)}")
        if self.high is not None:
            tests.append(f"{self.value} < {number(self.high)}")
        return "(" + " AND ".join(tests) + ")"

    def settle(self, previous: float | None, bucket, following: float | None, passed: int) -> None:
        """Move into a bucket: the open interval between its neighbours' nearest values."""
        if bucket["low"] == bucket["high"]:
            self.answer = bucket["low"]
            return
        self.low = self.low if previous is None else previous
        self.high = self.high if following is None else following
        self.base, self.inner = self.base + passed, bucket["n"]

    def narrow(self, a: float, b: float, below: int, at_a: int, mid: int, at_b: int) -> None:
        r = self.rank - self.base
        if r < below:
            self.high, self.inner = a, below
        elif r < below + at_a:
            self.answer = a
        elif r < below + at_a + mid:
            self.low, self.high, self.base, self.inner = a, b, self.base + below + at_a, mid
        elif r < below + at_a + mid + at_b:
            self.answer = b
        else:
            passed = below + at_a + mid + at_b
            self.low, self.base, self.inner = b, self.base + passed, self.inner - passed


def _propose(cells: DataFrame, targets: list[_Target], k: int) -> list[tuple[float, float]]:
    """Sketch the values inside each target's interval and read a bracket around its rank.

    Task-level sketches meet in MERGE_GROUPS reducers first, so the last merge reads that many
    sketches rather than one per input split."""
    keys = list(dict.fromkeys((t.pos, t.low, t.high) for t in targets))
    members = [[t for t in targets if (t.pos, t.low, t.high) == key] for key in keys]
    sketches = [
        F.expr(f"kll_sketch_agg_double(CASE WHEN {m[0].inside()} THEN {m[0].value} END, {k})").alias(f"s{i}")
        for i, m in enumerate(members)
    ]
    held = [F.expr(f"count_if({m[0].inside()})").alias(f"n{i}") for i, m in enumerate(members)]
    merged = (
        cells.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
        .groupBy("lane").agg(*sketches, *held)
        .agg(*[F.kll_merge_agg_double(F.col(f"s{i}")).alias(f"s{i}") for i in range(len(keys))], *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(keys))])
    )
    margin = 4.0 / k**0.9
    asks = []
    for i, m in enumerate(members):
        at = [(t.rank - t.base) / max(1, t.inner - 1) for t in m]
        points = [F.lit(min(1.0, max(0.0, p + d))) for p in at for d in (-margin, margin)]
        asks.append(F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.array(*points))).alias(f"q{i}"))
    row = merged.select(*asks, *[f"n{i}" for i in range(len(keys))]).first()
    for i, m in enumerate(members):
        if row[f"n{i}"] != m[0].inner:
            raise SourceChanged(m[0].pos)
    found = {id(t): (row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1]) for i, m in enumerate(members) for j, t in enumerate(m)}
    return [found[id(t)] for t in targets]


def _narrow(cells: DataFrame, targets: list[_Target], k: int) -> None:
    brackets = _propose(cells, targets, k)
    aggs = []
    for i, (t, (a, b)) in enumerate(zip(targets, brackets)):
        v, inside, low, high = t.value, t.inside(), number(a), number(b)
        aggs += [
            f"count_if({inside} AND {v} < {low}) AS below{i}",
            f"count_if({inside} AND {v} = {low}) AS a{i}",
            f"count_if({inside} AND {v} > {low} AND {v} < {high}) AS mid{i}",
            f"count_if({inside} AND {v} > {low} AND {v} = {high}) AS b{i}",
        ]
    row = cells.selectExpr(*aggs).first()
    for i, (t, (a, b)) in enumerate(zip(targets, brackets)):
        t.narrow(a, b, row[f"below{i}"], row[f"a{i}"], row[f"mid{i}"], row[f"b{i}"])


def _intervals(targets: list[_Target]) -> list[list[_Target]]:
    """Targets that share a column and an interval, and so one part of a job."""
    parts: dict[tuple, list[_Target]] = {}
    for t in targets:
        parts.setdefault((t.pos, t.low, t.high), []).append(t)
    return list(parts.values())


def _inside(cells: DataFrame, parts: list[list[_Target]], extra: dict[int, str] | None = None) -> DataFrame:
    """(part, v, extra) for the values inside the intervals.

    Intervals of one column that do not overlap share an entry, so a row gives about one entry
    per column, however many ranks are wanted."""
    lanes: dict[str, list[tuple[float, list[str]]]] = {}
    for i in sorted(range(len(parts)), key=lambda i: -math.inf if parts[i][0].low is None else parts[i][0].low):
        t = parts[i][0]
        more = f", {extra[i]}" if extra else ""
        case = f"WHEN {t.inside()} THEN struct({i} AS part, {t.value} AS v{more})"
        low, high = -math.inf if t.low is None else t.low, math.inf if t.high is None else t.high
        mine = lanes.setdefault(t.pos, [])
        free = next((j for j, (end, _) in enumerate(mine) if end <= low), None)
        if free is None:
            mine.append((high, [case]))
        else:
            mine[free] = (high, [*mine[free][1], case])
    entries = ", ".join(f"CASE {' '.join(cases)} END" for mine in lanes.values() for _, cases in mine)
    return cells.selectExpr(f"inline(array({entries}))").filter("part IS NOT NULL")


def _buckets(cells: DataFrame, targets: list[_Target], ends: dict[str, tuple[float, float]]) -> list[_Target]:
    """Narrow targets by one histogram round; returns those it could not narrow by much."""
    parts, buckets, stuck = [], {}, []
    for part in _intervals(targets):
        t = part[0]
        first, last = (ends[t.pos][0] if t.low is None else t.low), (ends[t.pos][1] if t.high is None else t.high)
        scale = BUCKETS / (last - first) if last > first else 0.0
        if not math.isfinite(scale) or scale <= 0.0:
            stuck += part
            continue
        place = f"floor(({t.value} - {number(first)}) * {number(scale)})"
        buckets[len(parts)] = f"CAST(greatest(0, least({BUCKETS - 1}, {place})) AS int) AS bucket"
        parts.append(part)
    if not parts:
        return stuck
    found = (
        _inside(cells, parts, buckets).groupBy("part", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .orderBy("part", "bucket").collect()   # at most BUCKETS rows per interval
    )
    for i, part in enumerate(parts):
        rows = [r for r in found if r["part"] == i]
        if sum(r["n"] for r in rows) != part[0].inner:
            raise SourceChanged(part[0].pos)
        for t in part:
            before, passed = t.inner, 0
            for j, r in enumerate(rows):
                if t.rank - t.base < passed + r["n"]:
                    t.settle(rows[j - 1]["high"] if j else None, r, rows[j + 1]["low"] if j + 1 < len(rows) else None, passed)
                    break
                passed += r["n"]
            if t.answer is None and t.inner * 4 > before:
                stuck.append(t)
    return stuck


def _walk(cells: DataFrame, parts: list[list[_Target]]) -> None:
    """Settle targets by walking their intervals' counted values in order, one task per interval."""
    width = max(len(part) for part in parts)
    goals = ", ".join(
        f"{i}, array({', '.join(f'{t.rank - t.base}L' for t in part + part[-1:] * (width - len(part)))})"
        for i, part in enumerate(parts)
    )
    counted = _inside(cells, parts).groupBy("part", "v").agg(F.count(F.lit(1)).alias("n"))
    steps = counted.selectExpr(
        "*", "sum(n) OVER (PARTITION BY part ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto",
        f"map({goals})[part] AS goals",
    )
    found = steps.groupBy("part").agg(F.max("upto").alias("n"), *[
        F.expr(f"min(CASE WHEN upto > goals[{j}] THEN v END)").alias(f"v{j}") for j in range(width)
    ])
    for row in found.collect():
        if row["n"] != parts[row["part"]][0].inner:
            raise SourceChanged(parts[row["part"]][0].pos)
        for j, t in enumerate(parts[row["part"]]):
            t.answer = row[f"v{j}"]


def _check_progress(targets: list[_Target], before: list[int]) -> None:
    """A sketched round leaves fewer rows, the wanted one among them: its bracket's ends are values of the interval. If not, rows have
    come or gone since, and further rounds need not end."""
    for t, inner in zip(targets, before, strict=True):
        if t.answer is None and not (t.inner < inner and 0 <= t.rank - t.base < t.inner):
            raise SourceChanged(t.pos)


def rank_values(
    cells: DataFrame, wanted: dict[str, list[int]], ends: dict[str, tuple[float, float]], present: dict[str, int],
    options: ScanOptions,
) -> dict[str, dict[int, float]]:
    """Values at the wanted ranks as {position: {rank: value}}; `ends` gives each column's
    smallest and largest value, `present` its non-null rows."""
    targets = [_Target(pos, r, present[pos]) for pos, rs in wanted.items() for r in sorted(set(rs))]
    for t in targets:
        low, high = ends[t.pos]
        if t.rank == 0 or low == high:
            t.answer = low
        elif t.rank == t.inner - 1:
            t.answer = high
    by_sketch: list[_Target] = []
    while open_ := [t for t in targets if t.answer is None and t.inner > options.walk_limit]:
        for start in range(0, len(open_), options.chunk):
            part = open_[start:start + options.chunk]
            sketched = [t for t in part if any(t is s for s in by_sketch)]
            plain = [t for t in part if not any(t is s for s in sketched)]
            if plain:
                by_sketch += _buckets(cells, plain, ends)
            if sketched:
                before = [t.inner for t in sketched]
                _narrow(cells, sketched, options.sketch_k)
                _check_progress(sketched, before)
    rest = _intervals([t for t in targets if t.answer is None])
    for start in range(0, len(rest), options.chunk):
        _walk(cells, rest[start:start + options.chunk])
    answers: dict[str, dict[int, float]] = {pos: {} for pos in wanted}
    for t in targets:
        if t.answer is None:
            raise SourceChanged(t.pos)
        answers[t.pos][t.rank] = t.answer
    return answers
