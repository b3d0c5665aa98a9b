"""The registered queries of the training-data operators, with their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import alignment, decontamination, embedding_dedup, hard_negatives, html_extract, jaccard_join, packing, secrets, sharding, suffix_dedup, token_counts, token_output, toxicity
from tidewell.llm.common import table
from tidewell.llm.sql import SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = toxicity.held_out().alias("held_out")
    return toxicity.score(docs, grammar).select("doc_id", held, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes: doc_id, slot, shard."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document holds: doc_id, contaminated, n_items, item_ids (comma-joined, ascending)."""
    marked = decontamination.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n = F.size("item_ids").cast("long")
    return marked.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.concat_ws(",", F.col("item_ids").cast("array<string>")).alias("item_ids"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    count = lambda rank: F.size(F.filter(found, lambda x: x["rank"] == rank)).cast("long")
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.rendered(found, base=True), 256).alias("base_sha256"),
        secrets.rendered(found).alias("spans"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of each document: doc_id, n_words, n_tokens."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near(table(spark, sf_dir, "embeddings"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), 100, label)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_packing, op4_html_extraction, op5_jaccard_join, op6_token_output, op7_decontamination, op8_secret_scans, op9_token_counts, op10_embedding_dedup, op11_alignment, op12_hard_negatives, op13_suffix_dedup)}
