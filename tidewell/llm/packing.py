"""Pack documents into fixed-length token sequences: best-fit decreasing over open windows.

A document longer than a window is first cut into full windows; what remains, at most one piece a
document, is packed by best-fit decreasing: the longest pieces first, each into the open window whose
remaining room is the tightest that holds it. A segment tree over remaining capacities finds it.

Pieces of one length are interchangeable, so the packing of any corpus is decided from its histogram
of piece lengths (at most ``max_len`` rows, whatever the corpus holds): one step of the plan places a
run of equal pieces into a run of equal windows. Pieces then find their place by their rank among the
pieces of their length, which is counted in parallel by (length, bucket of the key), so that neither a
frequent length nor a group of copies meets in one task.

Null or empty text is a document of the end id alone. Repeated rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import materialize, tidied
from tidewell.llm.tokens import encoder, tokenizer_path

MAX_LEN = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"


class Capacities:
    """A segment tree over capacities 0..n that finds the smallest one with an open window."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, windows: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += windows
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least length that has a window."""
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of histogram[length] pieces of each length.

    Rows (length, rank_from, rank_to, window_from, per_window, offset): the pieces of that length with
    ranks in [rank_from, rank_to) go, per_window of them to each, into windows from window_from on.
    """
    rows, windows, tree = [], 0, Capacities(max_len)
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity: runs (first window, number)

    def keep(capacity: int, first: int, number: int) -> None:
        if capacity and number:
            open_at[capacity].append((first, number))
            tree.add(capacity, number)

    for length in sorted(histogram, reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, number = max_len, windows, max(1, (end - rank) // (max_len // length))
                windows += number
            else:
                first, number = open_at[capacity].pop()
                tree.add(capacity, -number)
            per = min(capacity // length, end - rank)
            used = min(number, (end - rank) // per)
            rows.append((length, rank, rank + used * per, first, per, max_len - capacity))
            rank += used * per
            keep(capacity, first + used, number - used)
            keep(capacity - per * length, first, used)
    return rows


def piece_schema(docs: DataFrame, key: str, with_ids: bool) -> T.StructType:
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())]
    return T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)


def cut(docs: DataFrame, path: str, max_len: int, end_id: int, key: str, with_ids: bool = False) -> DataFrame:
    """A row for each piece: full windows of a document, then what remains. ids: little-endian uint32."""

    def pieces(batches):
        coder = encoder(path)
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, ids, at in coder.encode(batch.column(1)):
                rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for i in range(hi - lo):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    raw = memoryview(own).cast("B")
                    for start in range(0, len(own), max_len):
                        piece = raw[4 * start : 4 * (start + max_len)]
                        for k, v in (("row", lo + i), ("start", start), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", len(own))):
                            rows[k].append(v)
                        if with_ids:
                            rows["ids"].append(bytes(piece))
                columns = {key: keys.take(pa.array(rows["row"], pa.int64()))} | {k: pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens")}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(rows["ids"], pa.binary())} if with_ids else {}))
        coder.forget()

    return docs.select(key, "text").mapInArrow(tidied(pieces), piece_schema(docs, key, with_ids))


def place(pieces: DataFrame, max_len: int = MAX_LEN, key: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset. pieces should be materialized: they are read three times."""
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_len rows
    schema = "length long, rank_from long, rank_to long, window_from long, per_window long, at long"
    steps = spark.createDataFrame(plan(histogram, max_len), schema)  # bounded by max_len, not by the corpus
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(key, "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("nth") + F.col("before"))
    s = steps.withColumnRenamed("length", "step_length")
    found = ranked.join(F.broadcast(s), (F.col("length") == F.col("step_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return found.select(
        *pieces.columns,
        (F.col("window_from") + F.floor(nth / F.col("per_window"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per_window") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    pieces = materialize(cut(docs, path or tokenizer_path(VOCABULARY), max_len, end_id, key, with_ids), "pieces")
    return place(pieces, max_len, key)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (binary, little-endian uint32) and the spans of its documents. packed: with_ids."""
    each = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", key, "start", "ids"))).alias("pieces"))  # at most max_len pieces
    return each.select(
        "sequence_id",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.aggregate("pieces", F.lit(b""), lambda raw, p: F.concat(raw, p["ids"])).alias("ids"),
        F.transform("pieces", lambda p: F.struct(p["offset"], p["length"], p[key], p["start"])).alias("spans"),
    )
