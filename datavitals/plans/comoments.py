"""Second moments of every pair of numeric columns, over the rows where both have a finite value.

One scan: each task keeps a matrix of counts, means and co-moments and merges batch after batch into it
(Chan, Golub and LeVeque's pairwise update), so that neither large means nor many rows cost digits. What
leaves a task is one row per pair, and those are merged in the same way by a window over the pair.
Built-in aggregates would need a few for each of the k(k+1)/2 pairs; a matrix product does all at once.

Values are centred on the first one in a batch: a column that never changes has a spread of exactly zero."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

BLOCK = 512   # columns on either side of one task's matrix: 512 x 512 x 6 doubles are 12 MB
SCHEMA = "i int, j int, n double, mean_i double, mean_j double, c_ii double, c_ij double, c_jj double"


def _merge_batches(left: list[int], right: list[int]):
    """A function over Arrow batches whose columns are those of `left`, then those of `right` that are not in it."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    columns = sorted({*left, *right})
    rows, cols = [columns.index(i) for i in left], [columns.index(j) for j in right]
    wanted = [(a, b) for a in range(len(left)) for b in range(len(right)) if left[a] <= right[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            there = np.isfinite(x)
            first = x[there.argmax(axis=0), np.arange(x.shape[1])]
            first = np.where(there.any(axis=0), first, 0.0)
            x = np.where(there, x, first) - first
            there = there.astype(np.float64)
            a, b, in_a, in_b = x[:, rows], x[:, cols], there[:, rows], there[:, cols]
            n = in_a.T @ in_b
            some = np.maximum(n, 1)
            mean_a, mean_b = a.T @ in_b / some, in_a.T @ b / some
            now = [n, mean_a + first[rows][:, None] * (n > 0), mean_b + first[cols][None, :] * (n > 0),
                   np.maximum((a * a).T @ in_b - n * mean_a**2, 0), a.T @ b - n * mean_a * mean_b, np.maximum(in_a.T @ (b * b) - n * mean_b**2, 0)]
            if held is None:
                held = now
                continue
            both = held[0] + n
            share = n / np.maximum(both, 1)
            d_a, d_b = np.where(held[0] > 0, now[1] - held[1], 0), np.where(held[0] > 0, now[2] - held[2], 0)
            weight = held[0] * share
            empty = held[0] == 0
            held = [both, np.where(empty, now[1], held[1] + d_a * share), np.where(empty, now[2], held[2] + d_b * share),
                    held[3] + now[3] + weight * d_a**2, held[4] + now[4] + weight * d_a * d_b, held[5] + now[5] + weight * d_b**2]
        if held is not None and wanted:
            at_a, at_b = np.array(wanted).T
            parts = [np.array(left, np.int32)[at_a], np.array(right, np.int32)[at_b], *[m[at_a, at_b] for m in held]]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=names)

    return run


def comoments(cells: DataFrame) -> DataFrame:
    """Rows (i, j, n, mean_i, mean_j, c_ii, c_ij, c_jj) for positions i <= j of a table of double columns: number of rows where
    both are finite, and there the means, and the sums of products of the differences from them."""
    width = len(cells.columns)
    blocks = [list(range(s, min(width, s + BLOCK))) for s in range(0, width, BLOCK)]
    parts = None
    for left, right in combinations_with_replacement(blocks, 2):
        columns = sorted({*left, *right})
        part = cells.select(*[cells.columns[c] for c in columns]).mapInArrow(_merge_batches(left, right), SCHEMA)
        parts = part if parts is None else parts.unionByName(part)
    pair = Window.partitionBy("i", "j")
    # means relative to the least of them: equal ones stay equal
    parts = parts.where("n > 0").withColumns({"all": F.sum("n").over(pair), "low_i": F.min("mean_i").over(pair), "low_j": F.min("mean_j").over(pair)})
    parts = parts.withColumns({
        "m_i": F.expr("low_i + sum(n * (mean_i - low_i)) OVER (PARTITION BY i, j) / all"),
        "m_j": F.expr("low_j + sum(n * (mean_j - low_j)) OVER (PARTITION BY i, j) / all")})
    return parts.groupBy("i", "j").agg(
        F.sum("n").cast("bigint").alias("n"), F.first("m_i").alias("mean_i"), F.first("m_j").alias("mean_j"),
        F.expr("sum(c_ii + n * (mean_i - m_i) * (mean_i - m_i))").alias("c_ii"),
        F.expr("sum(c_ij + n * (mean_i - m_i) * (mean_j - m_j))").alias("c_ij"),
        F.expr("sum(c_jj + n * (mean_j - m_j) * (mean_j - m_j))").alias("c_jj"))
