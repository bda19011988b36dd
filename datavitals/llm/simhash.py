"""Near-duplicate documents by 64-bit fingerprints that differ in a few bits.

The index is by byte position. Two fingerprints that differ in at most four bits differ in at most
four of their eight bytes, so at least four positional bytes are equal: that is the guaranteed
minimum of matches. Posting lists of one byte would each hold 1/256 of the corpus, so the lists are those of
three positional bytes together, that is, intersections of three single lists. Twenty such lists
suffice for any pair: with the positions dealt over three boxes in a ring, the triples inside a box and
those with two positions in a box and one in the next hit every set of four positions.

In a posting, pairs are not written out. First every member meets the posting's smallest and
largest fingerprint and two by hash, which are minima that combine before the shuffle; the
links found this way join nearly all members of a dense group. Then only postings whose members
are still in different components are compared further, in blocks of bounded size, and only across components: a
pair's shared positional bytes are tallied, pairs with fewer than the guaranteed minimum are dropped, and the rest
are verified by their differing bits. No link between different components can be missed.

Exact copies share a fingerprint and are one node throughout. A document without words (null,
empty or white space) has fingerprint zero and is linked like any other. Repeated rows are copies; rows
with a null id are documents without a name, so a component of them alone has a null id. An empty table gives an
empty result; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import pick, slices, staged

BITS = 64
BYTES = 8
AT_ONCE = 1 << 16


def triples() -> list[tuple[int, int, int]]:
    """Twenty triples of positions such that any four positions hold one of them."""
    boxes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [b for b in boxes if len(b) == 3]
    for k, box in enumerate(boxes):
        after = boxes[(k + 1) % 3]
        out += [tuple(sorted((a, b, c))) for i, a in enumerate(box) for b in box[i + 1 :] for c in after]
    return sorted(out)


TRIPLES = triples()


def fingerprint(text: str | None, size: int = 4) -> int:
    """Bits set in over half the XXH64 hashes (seed 42) of all runs of `size` words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones, n = np.zeros(BITS, np.int64), len(words) - size + 1
    for at in range(0, n, AT_ONCE):
        to = min(n, at + AT_ONCE)
        spans = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(line[s:e], 42) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = 4) -> DataFrame:
    """Add a column `fp`, the fingerprint as a signed 64-bit number."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("fp", T.LongType())])
    at, kept = df.columns.index(text), [df.columns.index(k) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, at):
                values = np.array([fingerprint(t, size) for t in part.column(at).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(values)], names=schema.names)

    return df.mapInArrow(run, schema)


def postings(fps: DataFrame) -> DataFrame:
    """Each fingerprint under its twenty lists: `list` packs the number of the triple and its three bytes."""
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    keys = [F.lit(k << 24) + byte[a] * 65536 + byte[b] * 256 + byte[c] for k, (a, b, c) in enumerate(TRIPLES)]
    return fps.withColumn("list", F.explode(F.array(*[k.cast("long") for k in keys])))


def apart(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, most_bits: int = 4, block: int = 1024) -> DataFrame:
    """Components of different fingerprints (column `fp`) linked at `most_bits` differing bits: (fp, root)."""
    if not 0 <= most_bits <= 4:
        raise ValueError("the lists guarantee matches up to four differing bits")
    lists = postings(fps)
    salted = [F.xxhash64("fp", F.lit(k)) for k in (1, 2)]
    heads = lists.groupBy("list").agg(
        F.min("fp").alias("h0"), F.max("fp").alias("h1"), F.min_by("fp", salted[0]).alias("h2"),
        F.min_by("fp", salted[1]).alias("h3"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = lists.join(heads, "list")
    near = F.filter(F.array("h0", "h1", "h2", "h3"), lambda h: (h != F.col("fp")) & (apart(h, F.col("fp")) <= most_bits))
    first = met.select(F.col("fp").alias("a"), F.explode(F.array_distinct(near)).alias("b"))
    first = staged(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = staged(components(first), "roots")
    # what is left: lists whose members are not all in one component
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    lists = staged(postings(named), "lists")
    mixed = lists.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = mixed.select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    left = lists.join(mixed, "list").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # block i meets block j in cell (i, j), for i <= j; a list of one block meets itself
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    left = left.withColumn("cell", F.explode(other)).select("list", "cell.i", "cell.j", "own", "fp", "root")
    one, two = left.where("own = i").alias("x"), left.where("own = j").alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    tally = sum((F.shiftrightunsigned(differ, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(BYTES))
    same_cell = (F.col("x.list") == F.col("y.list")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.fp") < F.col("y.fp"))
    met = one.join(two, same_cell & once & (F.col("x.root") != F.col("y.root")) & (tally >= BYTES - most_bits) & (F.bit_count(differ) <= most_bits))
    more = met.select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    joined = staged(components(more), "joins")
    final = named.join(joined, named["root"] == joined["node"], "left")
    return final.select("fp", F.coalesce(joined["root"], named["root"]).alias("root"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", most_bits: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the smallest id in its component."""
    made = staged(fingerprints(pick(df, id=id, text=text)), "fingerprinted")
    classes = staged(made.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = staged(links(classes.select("fp"), most_bits), "components")
    named = classes.join(roots, "fp")
    least = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # staged, so that a join may split a hot root
    by_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return made.join(by_fp, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
