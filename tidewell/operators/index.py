"""Chunks, postings and term weights of a collection.

A chunk is known by (source key, chunk_order). Weights: tf times ln((N - df + 0.5) / (df + 0.5) + 1), never normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions.segment import Segmenter

ID = ["doc_id", "chunk_order"]


#: Bytes of input a core beyond which a scan has splits enough; below it, rows are spread before they are expanded.
SPLIT = 128 << 20


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores where the scan may have fewer splits: a small file, or one row group, is one task, and expanding is work. Larger inputs stay as they are."""
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * SPLIT else docs


def chunked(docs: DataFrame, size: int = X.CHUNK, overlap: int = X.OVERLAP, least: int = X.LEAST, title: str | None = None) -> DataFrame:
    """doc_id, source, chunk_order, text. title: a column whose value is put before each chunk."""
    each = spread(docs.select("doc_id", "source", "text", *([title] if title and title not in ("source", "text") else [])))
    each = each.select("doc_id", "source", *([title] if title and title != "source" else []), F.posexplode_outer(X.chunks(F.col("text"), size, overlap, least)).alias("chunk_order", "text")).where("chunk_order IS NOT NULL")
    own = X.prefixed(F.col(title), F.col("text")) if title else F.col("text")
    return each.select("doc_id", "source", "chunk_order", own.alias("text"))


def counted(tokens: Column) -> Column:
    """array of (term, n) of an array of tokens that is sorted: equal ones stand together."""
    at = F.sequence(F.lit(0), F.size(tokens) - 1)
    first = F.filter(at, lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))
    runs = F.zip_with(first, F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(tokens))), lambda a, b: F.struct(F.get(tokens, a).alias("term"), (b - a).cast("long").alias("n")))
    return F.when(F.size(tokens) > 0, runs)


def vectors(chunks: DataFrame, terms: DataFrame | None = None, segmenter: Segmenter | None = None) -> DataFrame:
    """doc_id, chunk_order, term, n, tf (the term's share of the chunk's tokens). terms: only these, which leaves their weights as they are.

    A chunk is tokenised once and its terms are counted where it lies, so nothing is shuffled. Outer explosions keep the optimizer from
    testing an array's size in a filter of its own, which would compute it twice.
    """
    each = chunks.select(*ID, F.sort_array(X.tokens(F.col("text"), segmenter)).alias("tokens"))
    each = each.select(*ID, F.size("tokens").alias("total"), F.explode_outer(counted(F.col("tokens"))).alias("t"))
    each = each.where("t IS NOT NULL").select(*ID, "total", "t.term", "t.n")
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    return each.select(*ID, "term", "n", (F.col("n") / F.col("total")).alias("tf"))


def idf(vectors_: DataFrame, chunks: DataFrame) -> DataFrame:
    """term, df, idf. vectors_ has a row for each (chunk, term), so df is a count."""
    total = chunks.agg(F.count(F.lit(1)).alias("chunks"))  # one row
    counted = vectors_.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return counted.crossJoin(F.broadcast(total)).select("term", "df", weight.alias("idf"))


def weighted(vectors_: DataFrame, idf_: DataFrame) -> DataFrame:
    return vectors_.join(idf_.select("term", "idf"), "term").withColumn("weight", F.col("tf") * F.col("idf"))
