"""Removal of every byte covered by a string of `length` bytes (400) that also starts elsewhere in the corpus.

Suffixes are sampled, sorted in shards, and merged by refining the interleave of the shards' Burrows-Wheeler
transforms; a suffix between two sampled ones is never sorted: its place follows from the symbols before a sampled one.

 1. *Sampling.* A window of `length` bytes belongs to its anchor, the place of the least hash among the pieces of eight bytes
    that start in its first `reach` (200) places. The choice looks at the window alone, so equal windows have equal anchors, at the
    same distance o from the start. The windows of an anchor have distances low..high, and share its core, the
    `length` - `reach` + 1 bytes from the anchor on. An anchor's context is all its windows: `high` bytes before it and
    `length` - `low` after. Only anchors are sorted; there is about one in `reach` / 2 bytes.
 2. *Shards.* A task samples its texts, a few megabytes at a time, and hands on one row for each context, with the places where the
    shard has it: copies meet before the shuffle. Contexts then meet by core: one that occurs twice is covered as a whole, one whose core nothing else
    has is settled. What is left are different contexts with a common core, at the edges of what repeats.
 3. *Merging.* Their bytes are fetched, each shard's in order of the bytes after the core (its sampled suffixes) with the bytes before
    (its Burrows-Wheeler symbols), and the shards' rows of equal cores are interleaved: eight more bytes
    at a time split the blocks not yet settled, and the place of a split is the common prefix of neighbours. Then each step takes one more symbol before the anchors:
    a stable split by symbol gives the order of the suffixes one byte earlier. After o steps, neighbours in a block whose common
    prefix reaches `length` - o bytes are an interval of equal windows, and those that hold two rows or more are repeated.
 4. *Cutting.* Covered stretches are gathered by text and joined to the texts.

Texts are told apart by 128 bits of hash (places of copies need not be told apart), contexts by 128 bits with their core. Contexts of one core are merged in one
task, in bounded buckets of cores; a core with more contexts than `most_contexts` is dealt by whole windows instead, which combine before
the shuffle. Shuffled joins carry texts; a text with many copies, of which there are no more than a set number, is dealt over as many tasks
as its count asks for, and what it is joined to goes to each.

Passages that are repeated but shorter than `length` bytes stay in their texts. `words` asks for them to be counted (`shared_runs`): a window of so many
words belongs to an anchor in its first half, as above, and the run of words from the anchor on that lies in all its windows is looked up among
the other rows. Every passage of `words` words that two rows have shows in both; only hashes are shuffled.

Matches never cross texts. Strings are judged on the input, overlaps count. Null is an empty text; texts shorter than `length` stay whole.
Repeated rows are copies of each other, null ids are carried along, an empty table gives an empty result, extra columns are ignored. What
is left of a text need not be valid UTF-8, as bytes are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import pick, slices, staged

CHUNK = 1 << 20        # window starts looked at together
BUCKET_ROWS = 40_000   # contexts merged in one task at a time
COPIES = 2_000         # copies of a text that one task joins
MOST_HOT = 10_000      # texts, at most, that have more; the bound rises with the table to keep to it
NONE = np.iinfo(np.uint64).max


def piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of 32 bits, in the upper half, of the `size` bytes (up to eight) from each place on."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    x = np.zeros(len(data), np.uint64)
    for k in range(size):
        x |= padded[k:k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(32) << np.uint64(32)


def least_places(keys: np.ndarray, reach: int) -> np.ndarray:
    """For each start the least of the next `reach` keys."""
    n = len(keys)
    rows = -(-n // reach) + 1
    cells = np.full(rows * reach, NONE)
    cells[:n] = keys
    cells = cells.reshape(rows, reach)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[reach - 1:reach - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, reach: int, piece: int) -> np.ndarray:
    """The anchors of all windows in the texts data[start:end]: rows (text, place, low, high), distances from the
    first and to the last window's start. A window belongs to the first of equal hashes."""
    whole = ends - starts >= length
    texts = np.flatnonzero(whole)
    begin, stop = starts[whole], ends[whole] - length + 1  # window starts of each text
    parts = []
    for text, b, e in zip(texts.tolist(), begin.tolist(), stop.tolist(), strict=True):
        place = []
        for at in range(b, e, CHUNK):
            to = min(e, at + CHUNK)
            keys = piece_hashes(data[at:to + reach + piece], piece)[:to - at + reach - 1]
            keys |= np.arange(len(keys), dtype=np.uint64)
            place.append((least_places(keys, reach)[:to - at] & np.uint64(0xFFFFFFFF)).astype(np.int64) + at)
        place = np.concatenate(place)
        new = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0]))
        last = np.append(new[1:], len(place)) - 1
        at = place[new]
        parts.append(np.stack([np.full(len(new), text), at, at - last - b, at - new - b], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)


def contexts(docs: DataFrame, length: int, reach: int, piece: int) -> DataFrame:
    """Rows (core, context, low, high, n, places): what each shard has of each context. Copies of a text have one place, counted in `n`."""
    import xxhash

    place = pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("at", pa.int32())])
    names = ["core", "context", "low", "high", "n", "places"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 2):
                column = part.column(2)
                texts = column.to_pylist()
                ends = np.cumsum([len(t) for t in texts])
                starts = ends - [len(t) for t in texts]
                whole = b"".join(texts)
                found = anchors(np.frombuffer(whole, np.uint8), starts, ends, length, reach, piece)
                if not len(found):
                    continue
                text, at, low, high = found.T
                size, signed = length - reach + 1, lambda h: np.array(h, np.uint64).view(np.int64)
                core = signed([xxhash.xxh64_intdigest(whole[a:a + size]) for a in at.tolist()])
                spans = zip((at - high).tolist(), (at - low + length).tolist(), (low * reach + high).tolist(), strict=True)
                context = signed([xxhash.xxh64_intdigest(whole[s:e], seed) for s, e, seed in spans])
                local = at - starts[text]
                d1, d2 = (part.column(i).to_numpy()[text] for i in (0, 1))
                order = np.lexsort((local, d2, d1, context, core))
                changed = lambda *keys: np.concatenate([[True], np.any([np.diff(k[order]) != 0 for k in keys], axis=0)])
                first = np.flatnonzero(changed(core, context))
                kept = np.flatnonzero(changed(core, context, d1, d2, local))
                chosen, once = order[first], order[kept]
                places = pa.StructArray.from_arrays([pa.array(d1[once]), pa.array(d2[once]), pa.array(local[once].astype(np.int32))], fields=list(place))
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(kept, first), len(kept)).astype(np.int32)), places)
                counts = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core[chosen]), pa.array(context[chosen]), pa.array(low[chosen].astype(np.int32)), pa.array(high[chosen].astype(np.int32)),
                     pa.array(counts), lists], names=names)

    return docs.select("d1", "d2", "text").mapInArrow(run, "core long, context long, low int, high int, n long, places array<struct<d1: bigint, d2: bigint, at: int>>")


def met(rows: DataFrame) -> DataFrame:
    """Contexts that occur twice (n > 1) or share their core with others (differ), one row a shard; `kinds` counts the core's rows,
    `first` marks one row of each context."""
    core, context = Window.partitionBy("core"), Window.partitionBy("core", "context")
    rows = rows.withColumns({
        "differ": F.min("context").over(core) < F.max("context").over(core), "kinds": F.count("*").over(core),
        "n": F.sum("n").over(context), "first": F.row_number().over(context.orderBy(F.col("places")[0])) == 1})
    return rows.where("n > 1 or differ")


def dealt(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with a `part`, 0 but for texts with many copies, and those texts with their number of parts, to be broadcast."""
    counts = staged(docs.groupBy("d1", "d2").agg(F.count("*").alias("n")).where(F.col("n") > COPIES), "copies")
    bar = max(COPIES, docs.count() // MOST_HOT)
    hot = F.broadcast(counts.where(F.col("n") > bar).select("d1", "d2", F.ceil(F.col("n") / bar).cast("int").alias("parts")))
    return docs.withColumn("row", F.monotonically_increasing_id()).join(hot, ["d1", "d2"], "left").withColumn(
        "part", F.coalesce(F.pmod("row", "parts").cast("int"), F.lit(0))).drop("row", "parts"), hot


def to_parts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of texts, once for each part of their text."""
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    return rows.join(hot, ["d1", "d2"], "left").select(*rows.columns, parts)


def fetched(docs: DataFrame, hot: DataFrame, asked: DataFrame, make, schema: str) -> DataFrame:
    """Meet the asked places with their texts: make(text, d1, d2, list of asks) yields result rows. Of copies of a text
    that a task meets, one is enough. Texts are not sorted: the asks, one row a text, are the hashed side."""
    asks = asked.groupBy("d1", "d2").agg(F.collect_list(F.struct("at", "low", "high", "core", "single")).alias("asks"))
    joined = docs.select("d1", "d2", "part", "text").join(to_parts(asks, hot).hint("shuffle_hash"), ["d1", "d2", "part"]).select("d1", "d2", "text", "asks")
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]):
        seen = set()
        for batch in batches:
            for part in slices(batch, 2):
                d1, d2 = part.column(0).to_pylist(), part.column(1).to_pylist()
                made = []
                for i, own in enumerate(zip(d1, d2, strict=True)):
                    if own not in seen:
                        made += make(part.column(2)[i].as_py(), *own, part.column(3)[i].as_py())
                        seen.add(own)
                made.sort()
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(k).type) for k, c in zip(names, zip(*made, strict=True) if made else [[]] * len(names), strict=True)], schema=arrow)

    return joined.mapInArrow(run, schema)


def byte_rows(column: pa.Array, width: int, back: bool = False) -> np.ndarray:
    """Byte strings as the rows of a matrix, filled up with zeros; from their ends backwards, if `back`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), np.uint8)
    for i, t in enumerate(column.to_pylist()):
        out[i, :len(t)] = np.frombuffer(t[::-1] if back else t, np.uint8)
    return out


def interleave(core: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shards: an order of all rows by core and bytes after it, the common prefix of each row with the one
    before (-1 at another core), and the number of each row's core. Only blocks not yet settled are split further, stably."""
    order = np.argsort(core, kind="stable")
    new = np.concatenate([[True], np.diff(core[order]) != 0])
    block, common = np.cumsum(new) - 1, np.where(new, -1, after.shape[1])
    of_core = block.copy()
    symbols = after.view(">u8").astype(np.uint64)
    alone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~alone)
    for k in range(symbols.shape[1]):
        if not len(open_):
            break
        symbol = symbols[order[open_], k]
        by = np.lexsort((symbol, block[open_]))
        order[open_], symbol = order[open_][by], symbol[by]
        same_block = np.concatenate([[False], np.diff(block[open_]) == 0])
        differ = np.concatenate([[np.uint64(0)], symbol[1:] ^ symbol[:-1]])
        split = same_block & (differ != 0)
        high = np.frexp(differ[split].astype(np.float64))[1]            # bit length, or one more where rounding carried
        high = np.where((high > 0) & (differ[split] >> (np.maximum(high, 1) - 1).astype(np.uint64).clip(0, 63) == 0), high - 1, high)
        common[open_[split]] = 8 * k + (64 - np.minimum(high, 64)) // 8
        heads = common < 8 * (k + 1)                                     # places where a block starts
        heads[0] = True
        block = np.cumsum(heads) - 1
        open_ = open_[~(heads & np.append(heads[1:], True))[open_]]
    return order, common, of_core


def repeated(core: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray, after: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and farthest distance of a repeated window for each row (farthest -1 if it has none). `before` holds bytes before the anchor, nearest
    first; a window at distance o is repeated if another row with the same core has the same o bytes before and `needed` - o after the core."""
    order, common, block = interleave(core, after)
    nearest, farthest = np.full(len(core), 2**31 - 1, np.int64), np.full(len(core), -1, np.int64)
    place = np.arange(len(core))  # of the rows still in play, in the merged order
    for o in range(int(high.max(initial=-1)) + 1):
        rows = order[place]
        if o:
            keep = high[rows] >= o
            place, rows, block = place[keep], rows[keep], block[keep]
            by = np.argsort(block * 256 + before[rows, o - 1], kind="stable")  # the order one byte earlier
            key = (block * 256 + before[rows, o - 1])[by]
            place, rows = place[by], rows[by]
            block = np.cumsum(np.concatenate([[True], np.diff(key) != 0])) - 1 if len(key) else block
            size = np.bincount(block, minlength=1)
            keep = size[block] > 1
            place, rows, block = place[keep], rows[keep], block[keep]
        if not len(place):
            break
        interval = np.cumsum(common < needed - o)  # rows whose bytes after the core agree as far as needed
        here = low[rows] <= o
        mine, at, number = rows[here], interval[place[here]], block[here]
        same = (np.diff(at) == 0) & (np.diff(number) == 0)
        hit = mine[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(mine) else mine
        nearest[hit] = np.minimum(nearest[hit], o)
        farthest[hit] = o
    return nearest, farthest


def merged(rows: DataFrame, length: int, reach: int, buckets: int) -> DataFrame:
    """Covered stretches (d1, d2, start, end) of contexts that occur once, by merging the rows of each core."""
    width = -(-reach // 8) * 8

    def run(table: pa.Table) -> pa.Table:
        values = {k: table.column(k).to_numpy() for k in ("core", "single", "d1", "d2", "at", "low", "high")}
        near, far = repeated(values["core"], values["low"], values["high"], byte_rows(table.column("before"), width, True), byte_rows(table.column("after"), width), reach - 1)
        hit = (far >= 0) & values["single"].astype(bool)
        start, end = values["at"][hit] - far[hit], values["at"][hit] - near[hit] + length
        return pa.table({"d1": values["d1"][hit], "d2": values["d2"][hit], "start": start.astype(np.int64), "end": end.astype(np.int64)})

    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(run, "d1 long, d2 long, start long, end long")


def covered(docs: DataFrame, hot: DataFrame, length: int, reach: int, piece: int, most_contexts: int) -> DataFrame:
    """Covered stretches (d1, d2, start, end), overlapping as they come."""
    import xxhash

    found = staged(met(contexts(docs, length, reach, piece)), "contexts")
    twice = found.where("n > 1").select(F.explode("places").alias("p"), "low", "high")
    out = twice.select("p.d1", "p.d2", (F.col("p.at") - F.col("high")).cast("long").alias("start"), (F.col("p.at") - F.col("low") + length).cast("long").alias("end"))
    asked = found.where("differ and first").select("core", "kinds", "low", "high", (F.col("n") == 1).alias("single"), F.inline(F.slice("places", 1, 1)))
    sizes = asked.agg(F.count_if(F.col("kinds") <= most_contexts).alias("few"), F.count_if(F.col("kinds") > most_contexts).alias("many")).first()

    def sides(text, d1, d2, asks):
        for a in asks:
            at, core_end = a["at"], a["at"] + length - reach + 1
            yield a["core"], text[core_end:at - a["low"] + length], d1, d2, at, a["low"], a["high"], a["single"], text[at - a["high"]:at]

    def windows(text, d1, d2, asks):
        for a in asks:
            for start in range(a["at"] - a["high"], a["at"] - a["low"] + 1):
                h = xxhash.xxh3_128_intdigest(text[start:start + length])
                yield (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, d1, d2, start, a["single"]

    if sizes["few"]:
        rows = fetched(docs, hot, asked.where(F.col("kinds") <= most_contexts), sides, "core long, after binary, d1 long, d2 long, at int, low int, high int, single boolean, before binary")
        out = out.unionByName(merged(rows, length, reach, -(-sizes["few"] // BUCKET_ROWS)))
    if sizes["many"]:
        rows = staged(fetched(docs, hot, asked.where(F.col("kinds") > most_contexts), windows, "h1 long, h2 long, d1 long, d2 long, start int, single boolean"), "windows")
        twice = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
        hit = rows.where("single").join(twice, ["h1", "h2"])
        out = out.unionByName(hit.select("d1", "d2", F.col("start").cast("long").alias("start"), (F.col("start") + length).cast("long").alias("end")))
    return out


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of each word [^\\x20\\x09-\\x0D]+ and its hash."""
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    size = ends - starts
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size.max() - 1, 0x9E3779B97F4A7C15, np.uint64)]))
        letters = (data[~blank[1:-1]].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = np.add.reduceat((letters ^ letters >> np.uint64(31)) * power[inside], np.cumsum(size) - size)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return starts, x ^ x >> np.uint64(31)


def sampled_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the sampled runs of words in the texts data[start:end], each once a text. Texts are not to touch."""
    reach = words // 2
    size = words - reach + 1
    at, word = word_hashes(data)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    with np.errstate(over="ignore"):
        run = np.zeros(len(word), np.uint64)
        for k in range(min(size, len(word))):
            run = run * np.uint64(0x9E3779B97F4A7C15) + np.append(word[k:], np.zeros(k, np.uint64))
    texts, found = [], []
    for text in np.flatnonzero(last - first >= words).tolist():
        b, e = first[text], last[text] - words + 1      # window starts
        keys = word[b:e + reach - 1] >> np.uint64(32) << np.uint64(32) | np.arange(e + reach - 1 - b, dtype=np.uint64)
        place = np.unique(least_places(keys, reach)[:e - b] & np.uint64(0xFFFFFFFF)).astype(np.int64) + b
        mine = np.unique(run[place])
        texts.append(np.full(len(mine), text))
        found.append(mine)
    return (np.concatenate(texts), np.concatenate(found)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shared_runs(docs: DataFrame, words: int) -> DataFrame:
    """Rows (d1, d2, shared): how many sampled runs of a text another row has too. Copies of a text meet before the shuffle."""
    if words < 2:
        raise ValueError("passages of two words at least")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 2):
                texts = part.column(2).to_pylist()
                size = np.array([len(t) for t in texts])
                ends = np.cumsum(size + 1) - 1
                text, found = sampled_runs(np.frombuffer(b" ".join(texts), np.uint8), ends - size, ends, words)
                keys = np.stack([found.view(np.int64), *(part.column(i).to_numpy()[text] for i in (0, 1))])
                kept, n = np.unique(keys, axis=1, return_counts=True) if len(found) else (keys, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([*[pa.array(k) for k in kept], pa.array(n.astype(np.int64))], names=["run", "d1", "d2", "n"])

    rows = docs.select("d1", "d2", "text").mapInArrow(run, "run long, d1 long, d2 long, n long")
    rows = rows.withColumn("all", F.sum("n").over(Window.partitionBy("run"))).where("all > 1")
    return rows.groupBy("d1", "d2").agg(F.count_distinct("run").alias("shared"))


def islands(stretches: DataFrame) -> DataFrame:
    """Overlapping and touching stretches of a text made one."""
    text = Window.partitionBy("d1", "d2")
    ordered = text.orderBy("start", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = stretches.withColumn("new", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("d1", "d2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 400, reach: int | None = None, most_contexts: int = 100_000,
                    words: int | None = None) -> DataFrame:
    """One row for each row: id, n_bytes, n_removed, n_spans (longest removed stretches) and kept, the bytes that remain. With
    `words` also n_shared: sampled runs of more than half as many words that other rows have too, removed or not; one at least in
    every passage of that many words."""
    if length < 2:
        raise ValueError("strings of two bytes at least")
    reach = length // 2 if reach is None else reach
    piece = min(8, length - reach + 1)
    docs = pick(df, id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    docs = docs.select("id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), "text")
    docs, hot = dealt(docs)
    stretches = covered(docs, hot, length, reach, piece, most_contexts)
    cuts = islands(stretches).groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    more = []
    if words is not None:
        cuts = cuts.join(shared_runs(docs, words), ["d1", "d2"], "full")
        more = [F.coalesce("shared", F.lit(0)).cast("long").alias("n_shared")]
    joined = docs.join(to_parts(cuts, hot).hint("shuffle_hash"), ["d1", "d2", "part"], "left").select("id", "text", "cuts", *more)
    id_type = df.schema[id].dataType.simpleString()
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared"][:5 + len(more)]

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 1):
                made = []
                for t, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    kept, at, spans = [], 0, 0
                    for c in sorted((c["start"], c["end"]) for c in cuts or []):
                        spans += c[0] > at or not spans
                        kept.append(t[at:c[0]])
                        at = max(at, c[1])
                    kept = b"".join([*kept, t[at:]])
                    made.append((len(t), len(t) - len(kept), spans, kept))
                columns = zip(*made, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[3:]], names=names)

    return joined.mapInArrow(cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary" + ", n_shared long" * len(more))
