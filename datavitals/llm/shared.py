"""Helpers the operators share: columns by exact name, staged tables, texts by Arrow batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavitals.session import shared_folder

SLICE_BYTES = 4 << 20


def numbered(df: DataFrame) -> DataFrame:
    """The table with columns c0, c1, ...: names that clash with others, or differ only in case, do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def numbered_name(df: DataFrame, name: str) -> str:
    """The name that `numbered(df)` gives to the column of exactly this name."""
    return f"c{df.columns.index(name)}"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns by exact name, renamed: pick(df, id="doc_id") has one column, id."""
    return numbered(df).select(*[F.col(numbered_name(df, name)).alias(alias) for alias, name in names.items()])


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write the table to the folder named in spark.checkpoint.dir and read it back.

    This cuts lineage: a lost executor re-reads files that all executors share."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about SLICE_BYTES of text each, one row at least."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_text(df: DataFrame, text: str, fields: list[T.StructField], begin: Callable, keep: list[str]) -> DataFrame:
    """Run a function over whole texts, one result row per row.

    begin() is called once per task and returns a function from a list of texts (None for null) to
    one list for each of `fields`. The columns in `keep` go along untouched."""
    schema = T.StructType([*[df.schema[k] for k in keep], *fields])
    at, kept = df.columns.index(text), [df.columns.index(k) for k in keep]
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32() if isinstance(f.dataType, T.IntegerType)
             else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.bool_() if isinstance(f.dataType, T.BooleanType)
             else pa.string() for f in fields]

    def run(batches):
        work = begin()
        for batch in batches:
            for part in slices(batch, at):
                made = work(part.column(at).to_pylist())
                arrays = [part.column(k) for k in kept] + [pa.array(m, k) for m, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def byte_encoding(ranks: str):
    """A byte vocabulary in tiktoken's format, without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens={})
