"""Exact top-k search by inner product of whole numbers, with MaxScore pruning.

Each component of a vector is a term, and a query's terms contribute whole numbers to the score. For
every term the lowest contribution over a block is taken off and added to a constant, so that
what is left is a non-negative impact with a known bound. Terms are ordered by bound. The largest set of small
terms whose bounds together cannot lift a document over the threshold is non-essential: no document
can enter the answer by these alone. The postings of the essential terms are traversed first; the
others are probed in falling order of their bounds, and only for documents that are still competitive,
that is, whose score so far plus the remaining bounds reaches the threshold. The threshold is the k-th best lower
bound known. Ties are competitive, since they go to the smaller id.

Rows are dealt into blocks (shards); each shard gives its k best and the shards are merged. Components are
floor(scale * x); a vector that is null, empty, or holds null or non-finite components takes no part, nor do rows
without an id. Products are exact: in floating point where no sum can pass 2^53, in whole Python numbers otherwise;
a score beyond a 64-bit number is given as the nearest one. An empty table gives an empty result; a repeated row is a
candidate each time; extra columns are ignored."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame

from .blocks import search, usable


def top(columns: np.ndarray, low: np.ndarray, high: np.ndarray, query: np.ndarray, k: int, probes: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of all documents that reach the k-th best score. `columns`: a row for each term."""
    least, most = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    bounds = most - least
    order = np.argsort(-bounds, kind="stable")
    rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the terms from here on can still add
    constant = least.sum()
    alive = np.arange(columns.shape[1])
    so_far = np.zeros(len(alive), columns.dtype)
    threshold, at = -1, 0

    def step():
        nonlocal so_far, threshold, at
        terms = order[at : at + probes]
        part = columns[terms] if len(alive) == columns.shape[1] else columns[terms][:, alive]
        so_far = so_far + query[terms] @ part - least[terms].sum()
        at += len(terms)
        if len(alive) >= k:
            threshold = max(threshold, np.partition(so_far, len(so_far) - k)[len(so_far) - k])

    while at < len(order) and rest[at] >= threshold:  # essential: what follows could still lift any document over the threshold
        step()
    if at < len(order):
        met = so_far > 0
        alive, so_far = alive[met], so_far[met]
    while at < len(order):  # non-essential: probed for competitive documents alone
        competitive = so_far + rest[at] >= threshold
        alive, so_far = alive[competitive], so_far[competitive]
        step()
    return alive, so_far + constant


def top_scores(df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256,
               block_rows: int = 8192, block_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest scores. `is_query` is a condition on the column `id`."""

    def local(ids, rows, query_ids, queries):
        most = [max(1.0, scale * np.abs(part).max() + 1) for part in (rows, queries)]
        if rows.shape[1] * most[0] * most[1] < 2.0**53:
            rows, queries = np.floor(scale * rows), np.floor(scale * queries)
        else:
            whole = np.frompyfunc(lambda x: math.floor(Fraction(x) * scale), 1, 1)
            rows, queries = whole(rows), whole(queries)
        columns = np.ascontiguousarray(rows.T)
        low, high = columns.min(axis=1), columns.max(axis=1)
        out = []
        for q in range(len(queries)):
            at, scores = top(columns, low, high, queries[q], k + 1)  # one more: the query may be among them
            own = ids[at]
            other = own != query_ids[q]
            own = own[other]
            # a query whose id is repeated loses more than one row, so its rows are looked at without pruning
            if (~other).sum() > 1:
                own, scores = ids[ids != query_ids[q]], (queries[q] @ columns)[ids != query_ids[q]]
            else:
                scores = scores[other]
            scores = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], np.int64)
            best = np.lexsort((own, -scores))[:k] if len(own) else np.zeros(0, int)
            out.append((np.full(len(best), q), own[best], scores[best]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    return search(usable(df, id, vector), is_query, k, "long", local, block_rows, block_queries)
