"""Vector best-fit packing of tokenised documents into fixed-size training sequences.

A sequence has three capacities: tokens, number of documents, and attention cost (the sum of the
squared lengths of its pieces). Pieces are placed longest first; among the sequences that can take
a piece under every capacity the one left fullest is chosen, by the weighted norm of what would
remain (`norm`) or by the weighted dot-product of demand and residual (`dot`).

Pieces of one length are interchangeable, so the packing is computed on the number of pieces of
each length: at most `max_tokens` rows, whatever the corpus. Sequences that hold the same lengths
form one group with a multiplicity; placing one length splits at most two groups, so there are at
most four groups for each length, and at most 45 different lengths in a sequence of 1,024. The plan
is therefore bounded by the capacity alone. Documents then find their place by their rank among the
pieces of their length, which is counted in parts: no task holds all pieces of a length. A piece that fills a
sequence by itself takes no part in any of this and is never shuffled.

A null text is an empty document: it has the end token alone. Repeated rows are packed as often as
they occur. An empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import byte_encoding, pick, slices, staged

LONG_GAP = re.compile(r"\s{10000}")


class Encoder:
    """Token ids equal to what the tokenizer file gives.

    `ranks` names the same byte vocabulary in tiktoken's format, which is several times faster; texts
    that hold a special token of the tokenizer, or white space so long that tiktoken's pattern runs out
    of stack, still go to the tokenizer itself."""

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = byte_encoding(ranks) if ranks else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= 10_000 and LONG_GAP.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def tokenised_pieces(df: DataFrame, tokenizer: str, ranks: str | None, id: str = "doc_id", text: str = "text",
                     max_tokens: int = 1024, end_token: int = 2, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `max_tokens` ids; only the first piece of a longer one may be shorter."""
    rows = pick(df, id=id, text=text)
    schema = T.StructType([
        rows.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])
    tail = np.array([end_token], "<u4")

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = Encoder(tokenizer, ranks)
        for batch in batches:
            for part in slices(batch, 1):
                at, pieces, raws = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encoder.encode(text or ""), tail)
                    n = len(ids)
                    first = (n - 1) % max_tokens + 1
                    for p, start in enumerate([0, *range(first, n, max_tokens)]):
                        end = first if p == 0 else start + max_tokens
                        raw = ids[start:end].tobytes()
                        at.append(i)
                        pieces.append((p, start, end - start, zlib.crc32(raw)))
                        if with_ids:
                            raws.append(raw)
                columns = [part.column(0).take(pa.array(at, pa.int64()))]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns += [pa.array([p[j] for p in pieces], kind) for j, kind in enumerate(kinds)]
                columns += [pa.array(raws, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, rule: str = "norm",
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> list[tuple[int, int, int, int, int, int, int]]:
    """Place counted lengths into groups of equal sequences.

    Returns slots (length, first rank, end rank, first sequence, sequences, offset, repeat): the pieces of
    that length with rank r from first to end fill `repeat` places in a row, from `offset` on, of
    each of `sequences` sequences numbered from `first sequence`."""
    groups: list[list] = []  # [multiplicity, tokens left, documents left, cost left, [(length, first rank, repeat)]]
    full: list[list] = []
    scale = (max_tokens, max_docs, max_cost)
    smallest = min(counts, default=0)

    def fits(g, length):
        return min(g[1] // length, g[2], g[3] // (length * length))

    def badness(g, length):
        left, need = (g[1], g[2], g[3]), (length, 1, length * length)
        if rule == "dot":
            return sum(w * (r / s) * (d / s) for w, r, d, s in zip(weights, left, need, scale, strict=True))
        return sum(w * ((r - d) / s) ** 2 for w, r, d, s in zip(weights, left, need, scale, strict=True))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        if length > max_tokens or length * length > max_cost:
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")

        def put(group, many, each):
            nonlocal todo, rank
            slot = (length, rank, each)
            made = [many, group[1] - each * length, group[2] - each, group[3] - each * length * length, [*group[4], slot]]
            todo -= many * each
            rank += many * each
            (groups if fits(made, smallest) > 0 else full).append(made)

        while todo:
            able = [g for g in groups if fits(g, length)]
            if able:
                best = min(able, key=lambda g: badness(g, length))
                groups.remove(best)
            else:
                room = min(max_tokens // length, max_docs, max_cost // (length * length))
                best = [-(-todo // room), max_tokens, max_docs, max_cost, []]
            each = fits(best, length)
            whole = min(best[0], todo // each)
            spare = todo - whole * each if whole < best[0] else 0  # pieces for one further sequence, not filled up
            parts = [(whole, each), (1, spare) if spare else (0, 0), (best[0] - whole - bool(spare), 0)]
            done = 0
            for many, repeat in parts:
                if not many:
                    continue
                part = [many, *best[1:4], [(l, r + done * k, k) if k else (l, r, k) for l, r, k in best[4]]]
                if repeat:
                    put(part, many, repeat)
                else:
                    groups.append(part)
                done += many
    slots, sequence = [], 0
    for many, _, _, _, own in [*full, *groups]:
        offset = 0
        for length, first, repeat in own:
            slots.append((length, first, first + many * repeat, sequence, many, offset, repeat))
            offset += length * repeat
        sequence += many
    return sorted(slots)


def pack(pieces: DataFrame, max_tokens: int = 1024, max_docs: int = 1024, max_cost: int = 1024 * 1024, rule: str = "norm",
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rows_per_part: int = 500) -> DataFrame:
    """Add sequence_id and offset to a written table (see `staged`) with a `length` column of 1 to max_tokens.

    A piece of max_tokens fills its sequence and needs no partner: it is numbered, from -1 downwards,
    where it is read. The others are ranked within their length in parts of about `rows_per_part`."""
    spark = pieces.sparkSession
    names = pieces.columns
    alone = pieces.where(F.col("length") == max_tokens)
    alone = alone.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < max_tokens)
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # under max_tokens rows
    slots = np.array(plan(counts, max_tokens, max_docs, max_cost, rule, weights), np.int64).reshape(-1, 7)
    shared = spark.sparkContext.broadcast(slots)  # bounded by the capacities: see above
    parts = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // rows_per_part))) for n in range(1, max_tokens + 1)])
    mixed = F.pmod(F.xxhash64(*names), F.element_at(parts, F.col("length").cast("int"))).cast("int")
    own = rest.withColumn("__part", mixed)
    cells = own.groupBy("length", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("length").alias("__l"), F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__part").orderBy(*names)
    ranked = own.withColumn("__row", F.row_number().over(within) - 1)
    ranked = ranked.join(cells, (F.col("length") == F.col("__l")) & (F.col("__part") == F.col("__p")))
    ranked = ranked.select(*names, (F.col("__before") + F.col("__row")).cast("long").alias("__rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = names.index("length")

    def place(batches):
        table = shared.value
        lengths, starts = np.unique(table[:, 0], return_index=True)
        ends = np.append(starts[1:], len(table))
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            slot = np.zeros(len(length), np.int64)
            for value in np.unique(length):
                here = length == value
                k = np.searchsorted(lengths, value)
                slot[here] = starts[k] + np.searchsorted(table[starts[k] : ends[k], 1], rank[here], side="right") - 1
            first, sequence, offset, repeat = (table[slot, j] for j in (1, 3, 5, 6))
            columns = [*batch.columns[: len(names)], pa.array(sequence + (rank - first) // repeat, pa.int64()),
                       pa.array(offset + (rank - first) % repeat * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return alone.unionByName(ranked.mapInArrow(place, schema))


def pack_documents(df: DataFrame, tokenizer: str, ranks: str | None, id: str = "doc_id", text: str = "text", max_tokens: int = 1024,
                   end_token: int = 2, with_ids: bool = False, **capacities) -> DataFrame:
    """Tokenise, cut and pack a table of documents: one row per piece with its sequence and place."""
    pieces = tokenised_pieces(df, tokenizer, ranks, id, text, max_tokens, end_token, with_ids)
    return pack(staged(pieces, "pieces"), max_tokens, **capacities)
