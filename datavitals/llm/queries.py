"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    language_id, maxscore, mixing, neighbours, packing, periodic_runs, pii, quality, secret_scan, simhash, suffix_dedup, url_reputation,
    whitening,
)
from .sql import MIXING, URL_RULES_SQL

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(id: str, of: int):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % of, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnable = docs.where(bucket("doc_id", 5) != 0)
    model = language_id.train(learnable, vocabulary("byte_bpe_multi_50k.tiktoken"))
    made = language_id.identify(docs.select("doc_id", "text"), model)
    return made.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return packed.withColumnRenamed("id", "doc_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.BASE], "base_sha256", "spans")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_scores(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, table(spark, sf_dir, "labels"), usable=bucket("id", 3) != 1)
    scored = quality.rate(docs, net)
    return scored.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.shares(table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("emitted") * F.col("size")).cast("long").alias("taken"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in a tenth of the texts, told by a checksum of the id, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        first = F.pmod(g, n)
        period = 1 + F.floor((n - first) / (3 + g % 8))
        at = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (at(i) + 1).cast("int"))), " ")

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    # length / period exactly: compare by cross products, which stay within a long for words of any text
    best = F.reduce("runs", F.element_at("runs", 1), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.array_join(F.array(r["start"], r["length"], r["period"]), ","), F.lit("\n"))), "")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return made.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # strings of 400 bytes are removed; passages of 50 words that repeat across documents are often shorter and are counted
    made = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), words=50)
    # the text that is left, with replacement characters where a cut parted a character's bytes; the digest is of the bytes themselves
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return made.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text, "n_shared")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_best_fit_packing, op3_secret_scan, op4_simhash_dedup, op5_nearest_neighbours,
    op6_personal_data, op7_exact_topk, op8_quality, op9_url_reputation, op10_source_mixing, op11_periodic_runs, op12_embedding_whitening,
    op13_suffix_dedup)}
ORACLES = {"op9_url_reputation": URL_RULES_SQL, "op10_source_mixing": MIXING}
