"""Runs: stretches of consecutive words that repeat with a period, found by internal pattern matching.

Let a run have smallest period q and at least `repeats` (four or more) periods. Take blocks of 2^k words, q <= 2^k < 2q, starting
at every multiple of 2^(k-1): one such block and the words up to its next occurrence lie inside the run. As the block is no
shorter than q, its occurrences in the run form a progression with difference q, so the first occurrence in the window
of 2^k words after the block's start gives the period. Hence:

 1. Doubling sorts the suffixes; after k steps every position has the rank of the block of 2^k words there, and equal
    blocks hold an interval of the suffix array. Positions whose rank is settled take no further part.
 2. For every block that occurs more than once, a wavelet tree over the suffix array answers the range successor: the
    first position after the block's start within the block's interval.
 3. A successor inside the window is a candidate period. The ranks of all levels give the longest common extension
    to both sides, hence the run; runs found from several blocks are one.

Texts are worked through in batches, one after another with a word of its own after each text; words of different
texts are different, so that nothing is found across texts. Every text stays in one task, and nothing is shuffled; memory grows with the
longest text. Words are the runs of characters other than space and x09 to x0D. A null, empty or blank text has no words and
no runs. Repeated rows are judged alike, null ids are carried along, an empty table gives an empty result, and extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick

BATCH_WORDS = 1 << 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def ranks_by_doubling(word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Suffix array, and for every level k the rank (start of its interval) and interval size of the block of 2^k words at each
    position. The last level is the first in which no two blocks are equal; a block that passes the end is unlike any other."""
    n = len(word)
    order = np.argsort(word, kind="stable").astype(np.int32)
    new = np.concatenate([[True], np.diff(word[order]) != 0])
    heads = np.flatnonzero(new).astype(np.int32)
    sizes = np.diff(np.append(heads, n)).astype(np.int32)
    rank, size = np.empty(n, np.int32), np.empty(n, np.int32)
    rank[order], size[order] = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    ranks, counts, step = [rank], [size], 1
    open_ = np.flatnonzero(size > 1).astype(np.int32)
    while len(open_):
        after = open_.astype(np.int64) + step
        inside = after < n
        follow = np.where(inside, rank[np.minimum(after, n - 1)], -1 - open_.astype(np.int64))  # past the end: different for every position
        key = rank[open_].astype(np.int64) * (2 * n + 1) + follow + n
        by = np.argsort(key, kind="stable")
        key, sorted_ = key[by], open_[by]
        first = np.concatenate([[True], np.diff(rank[sorted_]) != 0])
        new = np.concatenate([[True], np.diff(key) != 0])
        at = np.arange(len(key))
        start = np.maximum.accumulate(np.where(first, at, 0))       # of the old interval, among the open ones
        head = np.maximum.accumulate(np.where(new, at, 0))
        block = np.flatnonzero(new)
        lengths = np.diff(np.append(block, len(key)))
        rank, size = rank.copy(), size.copy()
        old = rank[sorted_]
        order[old + at - start] = sorted_
        rank[sorted_], size[sorted_] = old + (head - start), np.repeat(lengths, lengths)
        ranks.append(rank)
        counts.append(size)
        open_, step = sorted_[size[sorted_] > 1], step * 2
    return order, ranks, counts


class WaveletTree:
    """A sequence of numbers, stored by bits from the highest down; answers counts and order statistics of ranges."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.starts = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            ahead = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=ahead[1:])
            self.zeros.append(ahead)
            self.starts.append(int(ahead[-1]))
            values = np.concatenate([values[~one], values[one]])

    def smaller(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values in places low..high-1 are smaller, for each query."""
        count = np.where(than >> self.bits > 0, high - low, 0)
        for level, (ahead, start) in enumerate(zip(self.zeros, self.starts, strict=True)):
            a, b = ahead[low], ahead[high]
            one = (than >> (self.bits - 1 - level) & 1).astype(bool)
            count += np.where(one & (than >> self.bits == 0), b - a, 0)
            low, high = np.where(one, start + low - a, a), np.where(one, start + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) in places low..high-1, for each query."""
        value = np.zeros(len(low), np.int64)
        for level, (ahead, start) in enumerate(zip(self.zeros, self.starts, strict=True)):
            a, b = ahead[low], ahead[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            low, high = np.where(one, start + low - a, a), np.where(one, start + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, after: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The smallest value above `after` and not above `most` in places low..high-1; -1 where there is none."""
        out = np.full(len(low), -1, np.int64)
        before = self.smaller(low, high, after + 1)
        some = np.flatnonzero(before < high - low)
        if len(some):
            found = self.smallest(low[some], high[some], before[some])
            out[some] = np.where(found <= most[some], found, -1)
        return out


def extension(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from places a and b on (or, going back, before them), for a < b."""
    n, length = len(ranks[0]), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        size = 1 << k
        x, y = (a - length - size, b - length - size) if back else (a + length, b + length)
        fits = x >= 0 if back else y + size <= n
        same = fits & (ranks[k][np.where(fits, x, 0)] == ranks[k][np.where(fits, y, 0)])
        length += same * size
    return length


def find_runs(word: np.ndarray, repeats: int = 4, shortest: int = 6) -> np.ndarray:
    """All runs of a sequence of word numbers that has at least `repeats` periods and `shortest` words: rows (start, length, period), sorted."""
    n, found = len(word), []
    if n:
        suffixes, ranks, counts = ranks_by_doubling(word)
        tree = WaveletTree(suffixes)
        for k in range(len(ranks)):
            size, stride = 1 << k, max(1, 1 << k >> 1)
            if (size // 2 + 1) * repeats > n:
                break
            at = np.arange(0, n - size + 1, stride)
            at = at[counts[k][at] > 1]
            low = ranks[k][at].astype(np.int64)
            next_ = tree.successor(low, low + counts[k][at], at, at + size)
            hit = next_ >= 0
            at, period = at[hit], next_[hit] - at[hit]
            start = at - extension(ranks, at, at + period, back=True)
            end = at + period + extension(ranks, at, at + period)
            long = end - start >= np.maximum(repeats * period, shortest)
            found.append(np.stack([start, end - start, period], axis=1)[long])
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[np.concatenate([[True], (np.diff(runs, axis=0) != 0).any(axis=1)])] if len(runs) else runs


def numbered_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, each text with numbers of its own and one more after it; where each text starts."""
    numbers, starts, first = [], [0], 0
    for words in texts:
        own = dict.fromkeys(words)
        for i, w in enumerate(own):
            own[w] = first + i
        numbers.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
        first += len(own)
        numbers.append(np.array([first]))
        first += 1
        starts.append(starts[-1] + len(words) + 1)
    return np.concatenate(numbers), np.array(starts)


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stay, joined by one space: of each run the first period, and whatever no run holds."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
    return b" ".join(words)


def runs_of_texts(texts: list[bytes], repeats: int, shortest: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """(runs, collapsed text) of each text, in order."""
    split = [t.split() for t in texts]
    made: list = [None] * len(texts)
    by_length = sorted(range(len(split)), key=lambda i: len(split[i]))  # texts of like length share a batch: its tree is as deep as it must be
    batch, held = [], 0
    for i in [*by_length, None]:
        if i is None or held and held + len(split[i]) > BATCH_WORDS:
            if batch:
                words, starts = numbered_words([split[j] for j in batch])
                runs = find_runs(words, repeats, shortest)
                ends = np.searchsorted(runs[:, 0], starts)
                for k, j in enumerate(batch):
                    own = runs[ends[k]:ends[k + 1]] - np.array([starts[k], 0, 0])
                    made[j] = own, collapse(split[j], own)
            batch, held = [], 0
        if i is not None:
            batch.append(i)
            held += len(split[i]) + 1
    yield from made


def periodic_runs(df: DataFrame, id: str = "doc_id", text: str = "text", repeats: int = 4, shortest: int = 6) -> DataFrame:
    """One row for each row: id, runs (start, length, period in words; by start, then period) and collapsed, the text
    with only the first period of each run kept, words joined by one space."""
    if repeats < 4:
        raise ValueError("blocks meet every run of four periods or more")
    made = pick(df, id=id, text=text).select("id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    id_type = df.schema[id].dataType.simpleString()
    item = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(sizes, np.arange(1, sizes[-1] // (16 << 20) + 1) * (16 << 20)), [len(sizes)]])) if len(sizes) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                found = list(runs_of_texts(part.column(1).to_pylist(), repeats, shortest))
                ends = np.concatenate([[0], np.cumsum([len(r) for r, _ in found])]).astype(np.int32)
                flat = np.concatenate([r for r, _ in found])
                items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(item))
                lists = pa.ListArray.from_arrays(pa.array(ends), items)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([t.decode("utf-8", "replace") for _, t in found])], names=["id", "runs", "collapsed"])

    return made.mapInArrow(run, f"id {id_type}, runs {RUNS}, collapsed string")
