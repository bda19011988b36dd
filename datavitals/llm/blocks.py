"""Searches of a query set against all vectors: both dealt into blocks of bounded size, met cell by cell."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import pick


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows (id, v) with a vector of finite numbers as doubles; the others take no part.

    A shorter vector counts as filled up with zeros; an empty one is null."""
    rows = pick(df, id=id, v=vector).where("id is not null and size(v) > 0")
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def search(vectors: DataFrame, is_query: Column, k: int, kind: str, local: Callable, block_rows: int = 8192, block_queries: int = 4096) -> DataFrame:
    """The k best rows of each query, by a local search in each cell of row block and query block.

    `local(ids, rows, query_ids, queries)` gets padded matrices and returns arrays (query index, id, score) with
    the k best of the cell for each query, its own id left out. `kind` is the type of the score. A query
    id that occurs more than once is one query, with the smallest of its vectors; every row is a
    candidate. Blocks are dealt by a seeded draw, so a repeated id spreads like any other row."""
    sizes = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    row_blocks, query_blocks = max(1, -(-sizes["n"] // block_rows)), max(1, -(-sizes["q"] // block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select((F.rand(11) * row_blocks).cast("int").alias("i"), every(query_blocks).alias("j"), "id", "v")
    asked = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.select(every(row_blocks).alias("i"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("j"), "id", "v")

    def matrix(values: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(values), width))
        for at, v in enumerate(values):
            out[at, : len(v)] = v
        return out

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        width = max(max(map(len, left["v"])), max(map(len, right["v"])))
        query_ids = right["id"].to_numpy(np.int64)
        at, ids, scores = local(left["id"].to_numpy(np.int64), matrix(left["v"], width), query_ids, matrix(right["v"], width))
        return pd.DataFrame({"query_id": query_ids[at], "vec_id": ids, "score": scores})

    found = rows.groupBy("i", "j").cogroup(queries.groupBy("i", "j")).applyInPandas(meet, f"query_id long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
