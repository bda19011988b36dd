"""Approximate nearest neighbours through a low-dimensional stable projection and a kd-tree.

Vectors are projected by Gaussian (2-stable) directions onto `dimensions` numbers, so the squared distance of two
projections, divided by the squared distance of the vectors, follows a chi-square law. A kd-tree
over the projections gives neighbours in the order of projected distance, a leaf at a time; each is
verified on the original vectors. The search of a query stops when the next leaf's projected distance r and the
k-th best true distance d satisfy chi2(r^2 / d^2) >= `confidence`: a better neighbour would then have
appeared before with that probability.

Nearness is the largest inner product. One more component, sqrt(M^2 - |x|^2) with M the largest norm of
the table, gives all vectors norm M, so that the largest inner product is the smallest distance for any
norms. Scores are sums over the original components in double precision.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
an id. A query never finds its own id. Equal vectors in a block are one point of the tree with their k + 1
smallest ids, which is all that any answer can use, since ties go to the smaller id. An empty table gives an empty
result; extra columns are ignored."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import search, usable


def chi_square(x: float, m: int) -> float:
    """The cumulative chi-square law for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1.0 - math.exp(-x / 2) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < p else (low, middle)
    return high


def leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """The leaves of a kd-tree: each cell is halved at the median of its widest side."""
    todo, out = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        part = points[own]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, side], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest(df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20, dimensions: int = 8,
            confidence: float = 0.95, leaf: int = 32, seed: int = 5, block_rows: int = 8192, block_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found. `is_query` is a condition on the column `id`."""
    if dimensions % 2:
        raise ValueError("an even number of dimensions is needed")
    vectors = usable(df, id, vector).where(F.exists("v", lambda x: x != 0))
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    largest = vectors.agg(F.max(norm).alias("m")).first()["m"] or 0.0
    stop = quantile(confidence, dimensions)

    def local(ids, rows, query_ids, queries):
        order = np.lexsort((ids, *rows.T[::-1]))
        ids, rows = ids[order], rows[order]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
        ends = np.append(first[1:], len(ids))
        points = rows[first]
        squares = (points * points).sum(axis=1)
        lift = np.sqrt(np.maximum(largest - squares, 0.0))
        directions = np.random.default_rng(seed).standard_normal((rows.shape[1] + 1, dimensions))
        placed = np.column_stack([points, lift]) @ directions
        tree = leaves(placed, leaf)
        low = np.array([placed[c].min(axis=0) for c in tree])
        high = np.array([placed[c].max(axis=0) for c in tree])
        starts = queries @ directions[:-1]
        out = []
        for q in range(len(queries)):
            query, here = queries[q], starts[q]
            far = (np.maximum(np.maximum(low - here, here - high), 0.0) ** 2).sum(axis=1)
            sequence = np.argsort(far, kind="stable")
            base = query @ query + largest
            seen, products, at, step, kth = [], [], 0, max(1, 4 * k // leaf), math.inf
            while at < len(sequence) and far[sequence[at]] < stop * kth:
                some = np.concatenate([tree[c] for c in sequence[at : at + step] if far[c] < stop * kth])
                seen.append(some)
                products.append(points[some] @ query)
                at, step = at + step, 2 * step
                held = np.concatenate(products)
                if len(held) > k + 1:  # the query itself may be among them
                    kth = max(base - 2 * np.partition(held, -(k + 1))[-(k + 1)], 0.0)
            some, held = np.concatenate(seen), np.concatenate(products)
            if len(held) > k + 1:
                edge = np.partition(held, -(k + 1))[-(k + 1)]
                some = some[held >= edge - 1e-9 * max(1.0, abs(edge))]
            exact = (points[some] * query).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            own = np.concatenate([ids[first[p] : min(ends[p], first[p] + k + 1)] for p in some])
            scores = np.concatenate([np.full(min(ends[p] - first[p], k + 1), s) for p, s in zip(some, exact, strict=True)])
            other = own != query_ids[q]
            own, scores = own[other], scores[other]
            top = best_of(own, scores, k)
            out.append((np.full(len(top), q), own[top], scores[top]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    return search(vectors, is_query, k, "double", local, block_rows, block_queries)
