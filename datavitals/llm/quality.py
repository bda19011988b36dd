"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded, filters of `width` bytes slide over the whole text byte by byte, and the largest response of
each filter is kept for every chunk of `chunk` bytes; chunks overlap by half and cover the text to
its end. A document is described by the mean and the largest of its chunks' maxima, and a
logistic unit gives the probability of label 1. Training is by back-propagation with Adam.

A null or empty text is scored as one chunk of padding. Repeated rows get the same score; an empty table
gives an empty result; extra columns are ignored. Without a label of either kind the score is
the share of label 1 (0.5 without any label)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import map_text, pick

STRIDE = 1  # bytes from one place of the filters to the next
AT_ONCE = 1 << 15


@dataclass
class Network:
    embedding: np.ndarray  # 256 x E
    filters: np.ndarray  # (width * E) x F
    bias: np.ndarray  # F
    head: np.ndarray  # 2F
    offset: float
    width: int = 8
    chunk: int = 512


def responses(net: Network) -> list[np.ndarray]:
    """For each offset of the filters, what each byte there adds to their responses."""
    filters = net.filters.reshape(net.width, -1, net.filters.shape[1])
    return [net.embedding @ part for part in filters]


def padded(net: Network, raw: bytes) -> np.ndarray:
    """The bytes, filled up with zeros to whole half-chunks, and a filter's width more."""
    half = net.chunk // 2
    size = max(1, -(-len(raw) // half)) * half + net.width - STRIDE
    return np.frombuffer(raw.ljust(size, b"\0"), np.uint8)


def halves(net: Network, tables: list[np.ndarray], data: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest response of each filter in each half-chunk, and the position it has."""
    each = net.chunk // 2 // STRIDE
    n = (len(data) - net.width) // STRIDE + 1
    best, at = [], []
    for start in range(0, n, AT_ONCE // each * each):
        end = min(n, start + AT_ONCE // each * each)
        values = tables[0][data[start * STRIDE : (end - 1) * STRIDE + 1 : STRIDE]]
        for k in range(1, net.width):
            values += tables[k][data[start * STRIDE + k : (end - 1) * STRIDE + k + 1 : STRIDE]]
        values = values.reshape(-1, each, net.filters.shape[1])
        best.append(values.max(axis=1))
        if places:
            at.append(values.argmax(axis=1) + (start + each * np.arange(len(values)))[:, None])
    return np.concatenate(best) + net.bias, np.concatenate(at) if places else None


def pooled(net: Network, best: np.ndarray) -> np.ndarray:
    """Chunks of two half-chunks each, overlapping by one; mean and largest over the chunks."""
    active = np.maximum(best, 0)
    chunks = np.maximum(active[:-1], active[1:]) if len(active) > 1 else active
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])


def score(net: Network, tables: list[np.ndarray], text: str | None) -> float:
    best, _ = halves(net, tables, padded(net, (text or "").encode("utf-8", "replace")))
    z = float(pooled(net, best) @ net.head + net.offset)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str], labels: list[int], filters: int, rounds: int, rate: float, seed: int, width: int, chunk: int) -> Network:
    rng = np.random.default_rng(seed)
    size = 4
    y = np.array(labels, float)
    share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
    net = Network(
        rng.normal(0, 0.5, (256, size)).astype(np.float32), rng.normal(0, 1 / np.sqrt(width), (width * size, filters)).astype(np.float32),
        np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters), float(np.log(share / (1 - share))), width, chunk)
    if len(set(labels)) < 2:
        net.head[:] = 0
        return net
    names = ("embedding", "filters", "bias", "head", "offset")
    first = {n: np.zeros_like(np.asarray(getattr(net, n), float)) for n in names}
    second = {n: np.zeros_like(first[n]) for n in names}
    data = [padded(net, t.encode("utf-8", "replace")) for t in texts]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    steps, batch = 0, 16
    for turn in range(rounds):
        order = rng.permutation(len(data))
        for start in range(0, len(order), batch):
            grads = {n: np.zeros_like(first[n]) for n in names}
            tables = responses(net)
            for i in order[start : start + batch]:
                best, at = halves(net, tables, data[i], True)
                x = pooled(net, best)
                p = 1 / (1 + np.exp(-np.clip(x @ net.head + net.offset, -30, 30)))
                err = weight[i] * (p - y[i])
                grads["head"] += err * x
                grads["offset"] += err
                back = err * net.head
                # from the document to chunks, to half-chunks, to the winning positions
                active = np.maximum(best, 0)
                g = np.zeros_like(active)
                columns = np.arange(filters)
                if len(active) > 1:
                    second_wins = active[1:] > active[:-1]
                    rows = np.arange(len(active) - 1)[:, None] + second_wins
                    np.add.at(g, (rows, columns), np.broadcast_to(back[:filters] / len(rows), rows.shape))
                else:
                    g += back[:filters]
                g[active.argmax(axis=0), columns] += back[filters:]
                g *= best > 0
                r, c = np.nonzero(g)
                flow, place = g[r, c], at[r, c]
                grads["bias"] += np.bincount(c, weights=flow, minlength=filters)
                seen = data[i][place[:, None] * STRIDE + np.arange(width)]
                values = net.embedding[seen].reshape(len(place), -1) * flow[:, None]
                for f in np.unique(c):
                    grads["filters"][:, f] += values[c == f].sum(axis=0)
                np.add.at(grads["embedding"], seen.ravel(), (net.filters[:, c].T * flow[:, None]).reshape(-1, size))
            steps += 1
            pace = rate * (1 - 0.9 * steps * batch / (rounds * len(order)))
            for n in names:
                g = grads[n] / batch
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                move = pace * (first[n] / (1 - 0.9**steps)) / (np.sqrt(second[n] / (1 - 0.999**steps)) + 1e-8)
                value = getattr(net, n) - move
                setattr(net, n, float(value) if n == "offset" else value.astype(getattr(net, n).dtype))
    return net


def train(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", usable: Column | None = None,
          rows: int = 1600, longest_text: int = 20_000, filters: int = 16, rounds: int = 5, rate: float = 0.01, seed: int = 7,
          width: int = 8, chunk: int = 512) -> Network:
    """Fit the network on a bounded sample of labelled rows, in one task.

    The sample has at most `rows` labelled documents of up to `longest_text` characters, half of each label
    where there are enough, chosen by hash. `usable` is a condition on `id` for the rows that may be learned from.
    Labels other than 0 and 1, and ids whose labels disagree, are left out."""
    marks = pick(labels, id=id, label=label).where("id is not null and label in (0, 1)")
    if usable is not None:
        marks = marks.where(usable)
    marks = marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")
    # a threshold on the hash leaves a little more than the wanted rows of each label, which a window then cuts exactly
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003))
    rates = F.lit(1.0)
    for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect():
        rates = F.when(F.col("label") == r["label"], min(1.0, (1.2 * rows + 20) / r["n"])).otherwise(rates)
    marks = marks.where(place / 1_000_003.0 <= rates)
    order = Window.partitionBy("label").orderBy(place, F.xxhash64("id", F.lit(seed)), "id")
    marks = marks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows).drop("place")  # at most 2 x rows
    texts = pick(documents, id=id, text=text).where(F.length("text") <= longest_text)
    found = texts.join(F.broadcast(marks), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = found.withColumn("place", F.row_number().over(order))
    counts = found.groupBy("label").agg(F.count("*").alias("n"))
    held = {r["label"]: r["n"] for r in counts.collect()}
    low, high = held.get(0, 0), held.get(1, 0)
    take = {0: min(low, max(rows // 2, rows - high)), 1: min(high, max(rows // 2, rows - low))}
    chosen = found.where(F.when(F.col("label") == 0, F.col("place") <= take[0]).otherwise(F.col("place") <= take[1])).select(F.lit(0).alias("fit"), "id", "label", "text")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        net = fit(list(group["text"]), [int(v) for v in group["label"]], filters, rounds, rate, seed, width, chunk)
        parts = [net.embedding, net.filters, net.bias, net.head, np.array([net.offset])]
        return pd.DataFrame({"p": [np.concatenate([np.asarray(a, float).ravel() for a in parts]).tolist()]})

    fitted = chosen.groupBy("fit").applyInPandas(learn, "p array<double>").collect()
    if not fitted:
        return fit([], [], filters, 0, rate, seed, width, chunk)
    p = np.array(fitted[0]["p"])
    sizes = [256 * 4, width * 4 * filters, filters, 2 * filters, 1]
    a, b, c, d, e = np.split(p, np.cumsum(sizes)[:-1])
    return Network(a.reshape(256, 4).astype(np.float32), b.reshape(-1, filters).astype(np.float32), c.astype(np.float32), d, float(e[0]), width, chunk)


def rate(df: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row, in place of any column of that name."""

    def begin():
        tables = responses(net)
        return lambda texts: [[score(net, tables, t) for t in texts]]

    return map_text(df, text, [T.StructField(name, T.DoubleType())], begin, [c for c in df.columns if c not in (text, name)] if keep is None else keep)
