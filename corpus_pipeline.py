"""A training corpus from raw documents: language, near duplicates, personal data, mixture, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datavitals.llm import language_id, mixing, packing, pii, simhash
from datavitals.llm.queries import vocabulary
from datavitals.llm.shared import numbered, numbered_name, staged
from datavitals.session import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages: not `und`, with a posterior of one half or more, and likelier in that language than
    in a background of equally likely pieces, which texts in other scripts and keyboard noise are not.

    Null, empty and letterless texts are `und` and go. Repeated rows and rows with null ids are judged like any other, long texts whole;
    columns with clashing names come back as they were. Of an empty table nothing is left."""
    rows, text = numbered(docs), numbered_name(docs, "text")
    model = language_id.train(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))
    judged = language_id.identify(rows, model, text, rows.columns, ("lang_pred", "score", "gain"))
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= 0.5) & (F.col("gain") > 0)).select(*rows.columns).toDF(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, nulls last.

    Groups follow op4's rule over whole texts, null ones as empty ones. Of repeated rows one stays, as of any other copies (ties go to the
    first row of the written table). Columns with clashing names come back as they were; an empty table stays empty."""
    rows, id, text = numbered(docs), numbered_name(docs, "doc_id"), numbered_name(docs, "text")
    made = simhash.fingerprints(rows, text, rows.columns).withColumn("row", F.monotonically_increasing_id())
    made = staged(made, "fingerprinted")  # the row numbers are now stored and stay as they are
    order = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), "row")
    first = staged(made.groupBy("fp").agg(F.min(order).alias("first")), "fingerprints")
    roots = simhash.links(first.select("fp"))
    kept = first.join(roots, "fp").groupBy("root").agg(F.min("first")["row"].alias("row"))
    return made.join(kept, "row", "left_semi").select(*rows.columns).toDF(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind, and n_chars following; null and empty texts stay as they are.

    Repeated rows are redacted alike, whole texts whatever their length, and other columns stay untouched."""
    return pii.redact(docs, n_chars="n_chars")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, from not at all to three times.

    A text without words, null or empty, is as likely taken as others of its source. A null source is a source of its own, and null ids and repeated rows are documents of their own. An empty table stays empty."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. A null text is an empty one, which has the end token alone; texts of more than
    1,024 tokens are cut, and repeated rows are packed each. An empty table has no pieces."""
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]
ORACLE_SQL = None  # the model stages have no SQL; tests hold the pipeline against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over the written output of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
