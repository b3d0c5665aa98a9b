"""Keep an index's chunks current from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewell.operators.index import chunked


def chunk_stream(docs: DataFrame) -> DataFrame:
    """Chunks of a streaming documents table (doc_id, source, text, ts); late versions of a document within the hour are dropped."""
    fresh = docs.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["doc_id", "source"])
    return chunked(fresh)


def upsert_into(spark: SparkSession, updates: DataFrame, at: str, key: list[str], order: str) -> DataStreamWriter:
    """A writer that appends each batch to the log at a folder; `latest` reads the current rows. A batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([*key, order]).write.mode("overwrite").parquet(f"{at}/batch={number}")

    return updates.writeStream.foreachBatch(write)


def latest(spark: SparkSession, at: str, key: list[str], order: str) -> DataFrame:
    """The last row of each key over all batches."""
    log = spark.read.parquet(at)
    rest = [c for c in log.columns if c not in key and c != order]
    top = log.groupBy(*key).agg(F.max(F.struct(order, "batch", *[c for c in rest if c != "batch"])).alias("t"))
    return top.select(*key, *[F.col(f"t.{c}") for c in [order, *rest] if c != "batch"])
