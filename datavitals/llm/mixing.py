"""Mixing sources to target weights by systematic sampling.

Sources, in code-point order with null last, weigh 1, 2, 3, repeating (or as given), and share the corpus size by weight. A
target stops at `most_copies` times its source's size; the excess is shared again by weight until no target
is above its limit. Sorted by limit over weight, the limited sources are a prefix, so one pass of window
sums finds the level. Each document is expected target / size times. Expected copies are summed along the source's
documents, one offset is added, and a document is emitted once for each whole number its
interval crosses.

The order within a source is: part, then by size and id. Parts are dealt by a digest of the id, about `rows_per_part` documents each, so
the running number is a count of earlier parts plus a count within one, and no task holds a
source. Inside a part sizes go up and then down again, so that long and short documents are taken evenly. The offset derives from the source's name,
so reruns agree.

A null text has size 0. A null source is a source of its own. Null ids share a part. A source without words has target 0 and
is not emitted. Repeated rows are documents of their own. An empty table gives an empty result; extra columns go
along (`mix`) or are ignored (`shares`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import numbered, numbered_name, pick, staged

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(value: Column) -> Column:
    """A number below 2^32 from a text, null as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(rows: DataFrame, cycle: tuple[int, ...], most_copies: int, rows_per_part: int) -> DataFrame:
    """One row per source from rows (source, size): its size, target, expected copies, parts and offset."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in cycle]), place + 1).cast("long"))
    sources = sources.withColumn("limit", most_copies * F.col("source_size"))
    # the level at which weight times level, stopped at the limits, adds up to the whole: in the order of limit over
    # weight it is the first that its own source can bear, and those after it are lower
    upto = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    held, weight = F.coalesce(F.sum("limit").over(earlier), F.lit(0)), F.coalesce(F.sum("w").over(earlier), F.lit(0))
    level = (F.sum("source_size").over(whole) - held).cast("double") / (F.sum("w").over(whole) - weight).cast("double")
    sources = sources.withColumn("level", level)
    free = F.col("w") * F.col("level") <= F.col("limit")
    sources = sources.withColumn("level", F.coalesce(F.max(F.when(free, F.col("level"))).over(whole), F.lit(0.0)))
    target = F.least(F.col("w") * F.col("level"), F.col("limit").cast("double"))
    sources = sources.withColumn("target", target)
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size").cast("double"), F.lit(float(most_copies)))).otherwise(0.0)
    offset = digest(F.col("source")).cast("double") / float(2**32)
    return sources.select("source", "source_size", "target", copies.alias("copies"), F.ceil(F.col("n") / rows_per_part).alias("parts"), offset.alias("offset"))


def counted(rows: DataFrame, source: str, id: str, size: Column, table: DataFrame, most_copies: int) -> DataFrame:
    """Add source_size, target and emitted (how often the mix takes the row) to rows."""
    names = rows.columns
    table = table.select(*[F.col(c).alias(f"__{c}") for c in table.columns])
    with_source = rows.join(table, F.col(source).eqNullSafe(F.col("__source")))
    with_source = with_source.withColumn("__part", digest(F.col(id).cast("string")) % F.col("__parts"))
    cells = with_source.groupBy(F.col(source).alias("__s"), F.col("__part").alias("__p")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    cells = staged(cells.select("__s", "__p", F.col("n").alias("__n"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")), "cells")
    within = Window.partitionBy(source, "__part").orderBy("__size", F.col(id).asc_nulls_first())
    ranked = with_source.withColumn("__size", size).withColumn("__row", F.row_number().over(within) - 1)
    ranked = ranked.join(cells, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    # up by size over the even places and down again over the odd ones: what the offset takes too little of on
    # the way up, it takes too much of on the way down
    row = F.when(F.col("__row") % 2 == 0, F.expr("__row div 2")).otherwise(F.col("__n") - 1 - F.expr("__row div 2"))
    rank, step, start = F.col("__before") + row, F.col("__copies"), F.col("__offset")
    crossed = F.floor(step * (rank + 1) + start) - F.floor(step * rank + start)
    return ranked.select(*names, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                         F.least(crossed, F.lit(most_copies)).cast("int").alias("emitted"))


def shares(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[int, ...] = (1, 2, 3), most_copies: int = 3,
           rows_per_part: int = 1000) -> DataFrame:
    """One row per document: id, source, size in words, source_size, target, and how often the mix emits it."""
    rows = pick(df, id=id, text=text, source=source)
    rows = staged(rows.select("id", "source", size_of(F.col("text")).alias("size0")), "sizes")
    table = staged(targets(rows.withColumnRenamed("size0", "size"), cycle, most_copies, rows_per_part), "sources")
    return counted(rows, "source", "id", F.col("size0"), table, most_copies).drop("size0")


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[int, ...] = (1, 2, 3), most_copies: int = 3,
        rows_per_part: int = 1000) -> DataFrame:
    """The mixed corpus: every row of the table, with all its columns, as often as the mix emits it."""
    rows = numbered(df)
    id, text, source = (numbered_name(df, c) for c in (id, text, source))
    sized = rows.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    table = staged(targets(sized, cycle, most_copies, rows_per_part), "sources")
    taken = counted(rows, source, id, size_of(F.col(text)), table, most_copies).where("emitted > 0")
    repeated = taken.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("emitted"))).alias("copy"))
    return repeated.drop("copy").toDF(*df.columns)
