"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared folder and reads it
back as the next stage's docs, so each stage works on all that its predecessor kept and a lost executor repeats no earlier stage.
All stages but the last return the columns of documents. Empty tables give empty results; null texts pass as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, jaccard_join, packing, secrets, toxicity
from tidewell.llm.common import discard, materialize, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores at its threshold or above go."""
    return toxicity.rejects(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links of similarity 0.8 connect one stays: that with the smallest id (nulls last), then the smallest hash of its text."""
    return jaccard_join.one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = unused(docs, "item_ids")
    marked = decontamination.mark(docs, table(spark, sf_dir, "benchmark"), into=items)
    return marked.where(F.size(items) == 0).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in it becomes a mark, and n_chars follows."""
    spans = unused(docs, "found")
    found = secrets.scan(docs, into=spans)
    text = secrets.redacted(F.col("text"), F.col(spans))
    n_chars = F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return found.select(*[text.alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: SQL expresses neither the learnt grammar nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return docs
