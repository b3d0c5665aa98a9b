"""Search by dense vectors: exact cosine of a batch of query vectors against all vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.vectors import unit
from tidewell.operators.search import PLACES, best
from tidewell.session import settled


def normalized(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", unit(F.col("embedding")))


#: Bytes of query vectors that go to every task at once, and scores that a task makes at once.
BLOCK_BYTES, CELLS = 16 << 20, 4_000_000


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows of length one (zero stays zero), and which rows they are; null ones are left out."""
    column = column.cast(pa.list_(pa.float64()))
    good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    own = column.take(pa.array(good))
    x = own.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, 0))
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n), good


def blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """qids and unit vectors of the queries, in blocks of bounded size."""
    own = settled(queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding")))
    size = own.agg(F.sum(8 * F.size("embedding"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for i in range(n):
        some = own.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i).toArrow()
        if some.num_rows:
            x, good = units(pa.concat_arrays(some["embedding"].chunks))
            qids = some["qid"].to_pylist()
            yield [qids[g] for g in good], x


def products(queries: DataFrame, vectors: DataFrame, keep: int | None = None) -> DataFrame:
    """qid, vec_id, score of a batch of queries against all vectors: a matrix product for each block of queries and Arrow batch of vectors.

    Vectors stay where they are. keep: a task keeps what can be among so many best of each query, so what leaves it follows the queries, not the vectors.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    for qids, q in blocks(queries):
        shared = spark.sparkContext.broadcast((pa.array(qids), q))

        def found(batches, shared=shared):
            names, q = shared.value
            held = []  # what may be among the best so far
            least, step = np.full(len(q), -np.inf), max(1, CELLS // max(1, len(q)))
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    batch = whole.slice(lo, step)
                    x, good = units(batch.column("v"))
                    if not (len(x) and len(q)):
                        continue
                    score = q @ x.T
                    if keep is not None and len(x) >= keep:  # so many here are at least as good; ties after rounding stay
                        least = np.maximum(least, np.partition(score, len(x) - keep, axis=1)[:, len(x) - keep] - 10.0**-PLACES)
                    i, j = np.nonzero(score >= least[:, None])
                    part = pa.RecordBatch.from_arrays([names.take(pa.array(i)), batch.column("vec_id").take(pa.array(good[j])), pa.array(score[i, j])], ["qid", "vec_id", "score"])
                    if keep is None:
                        yield part
                    else:
                        held.append((i, score[i, j], part))
            for i, score, part in held:
                yield part.filter(pa.array(score >= least[i]))

        out = out.union(vectors.select("vec_id", F.col("embedding").alias("v")).mapInArrow(found, schema))
    return out.withColumn("score", F.round("score", PLACES))


def cosines(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """qid, vec_id, score of all pairs. queries: qid, embedding; a stated batch against all rows. Vectors of other lengths fail."""
    return products(queries, vectors)


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    return best(products(queries, vectors, k), k, "vec_id")


def hashed_embedding(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """A stand-in for a model: a normalised bag of hashed words, the same everywhere."""
    from zlib import crc32

    out = []
    for t in texts:
        v = np.zeros(dimensions)
        for w in (t or "").lower().split():
            h = crc32(w.encode())
            v[h % dimensions] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def encoded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = 100, column: str = "text") -> DataFrame:
    """texts with embedding, the model called on batches in the tasks. model: picklable; it loads what it needs once a worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = s.tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in model(rows[i : i + batch])])

    return texts.withColumn("embedding", encode(F.col(column)))
