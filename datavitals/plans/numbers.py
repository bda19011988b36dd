"""Numeric columns of two sides as one table of counted values, laid out in the order of the values.

Quantiles, PSI bins and distinct counts of both sides are read off this table, so that the rows themselves are gone
through once, however many ranks and bins are wanted. It is grouped by value before it is dealt by range: no value
weighs more than one row, and the ranges are even. Their sums (a few rows a range) tell which range holds a rank;
only there running sums are taken."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from datavitals.functions.cells import positional
from datavitals.plans.frequency import has_value, slot_struct, slots_of
from datavitals.session import stage

_AS_DOUBLE = {"whole": "CAST(whole AS double)", "real": "real", "fixed": "CAST(fixed AS double)"}


def tagged_counts(sides, entries: tuple[list, list], slots: list[str]) -> DataFrame:
    """(ord, slots..., nb, nc): rows of each side per value. `entries` has each side's (ord, kind, value) as they are counted."""
    tagged = None
    for side in (0, 1):
        if not entries[side]:
            continue
        cells = ", ".join(slot_struct(*entry, slots) for entry in entries[side])
        part = positional(sides[side]).selectExpr(f"inline(array({cells}))").selectExpr("*", f"{side} AS side")
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.filter(has_value(slots)).groupBy("ord", *slots).agg(
        F.expr("count_if(side = 0)").alias("nb"), F.expr("count_if(side = 1)").alias("nc"))


def number_counts(sides, fields, wanted: list[str]) -> DataFrame:
    """Staged rows (ord, v, nb, nc, part), a row for each value of a column. Parts are ranges of (ord, v). A column that is
    a number on one side alone is counted there."""
    entries = tuple(
        [(i, f.slot, f.pos) for i, n in enumerate(wanted) if (f := fields[side].get(n)) is not None and f.numeric] for side in (0, 1))
    slots = slots_of({kind for side in entries for _, kind, _ in side})
    value = f"coalesce({', '.join(_AS_DOUBLE[s] for s in slots)})"
    counted = tagged_counts(sides, entries, slots).selectExpr("ord", f"{value} AS v", "nb", "nc")
    return stage(counted.repartitionByRange("ord", "v").withColumn("part", F.spark_partition_id()), "numbers")


def range_sums(counts: DataFrame) -> dict[int, list[Row]]:
    """The ranges of each column, in order: rows (part, nb, nc, ub, uc) with both sides' rows and distinct values."""
    sums = counts.groupBy("ord", "part").agg(
        F.sum("nb").alias("nb"), F.sum("nc").alias("nc"), F.expr("count_if(nb > 0)").alias("ub"), F.expr("count_if(nc > 0)").alias("uc"),
        F.min("v").alias("low"))
    out: dict[int, list[Row]] = {}
    for row in sums.orderBy("ord", "low").collect():
        out.setdefault(row["ord"], []).append(row)
    return out


GOALS = pa.schema([("ord", pa.int32()), ("part", pa.int32()), ("goals_b", pa.list_(pa.int64())), ("goals_c", pa.list_(pa.int64()))])


def values_at(counts: DataFrame, sums: dict[int, list[Row]], wanted: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], dict[int, float]]:
    """Values at the wanted zero-based ranks of (ord, side), as {(ord, side): {rank: value}}."""
    goals: dict[tuple[int, int], tuple[dict, dict]] = {}   # (ord, part) -> for each side {rank in the part: rank}
    for (ord_, side), ranks in wanted.items():
        left, passed = sorted(set(ranks)), 0
        for row in sums.get(ord_, []):
            n = row["nc" if side else "nb"]
            while left and left[0] < passed + n:
                rank = left.pop(0)
                goals.setdefault((ord_, row["part"]), ({}, {}))[side][rank - passed] = rank
            passed += n
    found: dict[tuple[int, int], dict[int, float]] = {key: {} for key in wanted}
    if not goals:
        return found
    rows = [{"ord": o, "part": p, "goals_b": list(b), "goals_c": list(c)} for (o, p), (b, c) in goals.items()]
    asked = F.broadcast(counts.sparkSession.createDataFrame(pa.Table.from_pylist(rows, schema=GOALS)))
    upto = "OVER (PARTITION BY ord, part ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    walked = counts.join(asked, ["ord", "part"]).selectExpr("*", f"sum(nb) {upto} AS b", f"sum(nc) {upto} AS c")
    hit = " OR ".join(f"exists(goals_{s}, g -> g >= {s} - n{s} AND g < {s})" for s in "bc")
    for row in walked.where(hit).collect():     # at most a row for each rank
        for side, s in enumerate("bc"):
            for at, rank in goals[row["ord"], row["part"]][side].items():
                if row[s] - row[f"n{s}"] <= at < row[s]:
                    found[row["ord"], side][rank] = row["v"]
    return found


EDGES = pa.schema([("ord", pa.int32()), ("edges", pa.list_(pa.float64()))])


def counted_bins(counts: DataFrame, edges: dict[int, list[float]]) -> DataFrame:
    """Rows (ord, bin, nb, nc): both sides' rows between a column's sorted edges, bins closed on the right."""
    listed = pa.Table.from_pylist([{"ord": o, "edges": e} for o, e in edges.items()], schema=EDGES)
    asked = F.broadcast(counts.sparkSession.createDataFrame(listed))
    return counts.join(asked, "ord").selectExpr("ord", "size(filter(edges, e -> e < v)) AS bin", "nb", "nc").groupBy("ord", "bin").agg(
        F.sum("nb").alias("nb"), F.sum("nc").alias("nc"))
