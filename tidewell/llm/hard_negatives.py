"""Mine hard negatives of anchor vectors: rows of another label whose score lies in a band below each positive's.

Components become integers, so a score (the inner product) is exact. Products are Kronecker-packed: the components of several
candidates, made non-negative by a bias, stand in separate fields of one wide integer, which is multiplied once by each
component of an anchor; the fields of the sum are wide enough for its largest value, so they never run into each other, and the
scores are unpacked from them and freed of the biases. Words of up to 53 bits are kept as doubles, in which such integers are exact, and go
through one matrix product; vectors with larger components take words of Python integers, of any width.

Anchors are a stated share of the rows and go out in blocks of at most about ``BLOCK_BYTES``; each block meets all rows, which stay where
they are. A task keeps the k best of each anchor that it has seen, so what is shuffled follows anchors and tasks, never pairs, and
a label that holds a third of the rows is no group anywhere.

Rows whose label or vector is null, or that hold a null or non-finite component (or one that no longer is finite when scaled), take no part.
Vectors of different lengths are never compared. Rows that repeat an id are rows of their own (an anchor's copy can be its positive). A null id is
no anchor; ties go to the smaller id, nulls last. A score that a long cannot hold counts as the nearest long. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import discard, materialize, new_path, tidied

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Shares of the positive's score, in hundredths, between which a negative's lies.
LOW, HIGH = 30, 90
#: Bounds of a block of anchors.
BLOCK_BYTES, BLOCK_ANCHORS = 8 << 20, 2_048
CANDIDATES = 1_024
#: Bits of an integer that a double holds; fields of a word of Python integers.
WORD, FIELDS = 53, 16
#: Components up to here are multiplied apart from larger ones, which would widen every field.
PLAIN = float(1 << 20)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, anchors x candidates, of two matrices of doubles that are integers; exact, as longs (clipped)."""
    n, d = candidates.shape
    if not (len(anchors) and n and d):
        return np.zeros((len(anchors), n), np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    width = max(1, (d * (int(anchors.max()) - low_a) * (int(candidates.max()) - low_c)).bit_length())
    plain = width <= WORD and max(abs(low_a), abs(low_c)) <= PLAIN
    if plain:
        a, c, fields = anchors - low_a, candidates - low_c, WORD // width
    else:
        whole = np.frompyfunc(int, 1, 1)
        a, c, fields = whole(anchors) - low_a, whole(candidates) - low_c, FIELDS
    words = -(-n // fields)
    padded = np.concatenate([c, np.zeros((words * fields - n, d), c.dtype)]).reshape(words, fields, d)
    shifts = [1 << (width * f) for f in range(fields)]
    packed = sum(padded[:, f] * (float(s) if plain else s) for f, s in enumerate(shifts))
    product = a @ packed.T
    if plain:
        product = product.astype(np.int64)
    out = np.stack([(product >> (width * f)) & ((1 << width) - 1) for f in range(fields)], axis=2).reshape(len(anchors), -1)[:, :n]
    out = out + low_c * a.sum(axis=1)[:, None].astype(out.dtype) + low_a * c.sum(axis=1)[None, :].astype(out.dtype) + d * low_a * low_c
    return out if plain else np.clip(out, LEAST, MOST).astype(np.int64)


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """As `packed_products`; rows with large components are multiplied apart, so that they widen no other's fields."""
    out = np.empty((len(anchors), len(candidates)), np.int64)
    sides = [np.abs(x).max(axis=1, initial=0) <= PLAIN for x in (anchors, candidates)]
    for p in (True, False):
        for q in (True, False):
            i, j = np.flatnonzero(sides[0] == p), np.flatnonzero(sides[1] == q)
            if len(i) and len(j):
                out[np.ix_(i, j)] = packed_products(anchors[i], candidates[j])
    return out


class Best:
    """The k best candidates of each group: the highest score, then the smallest id (nulls last), then the row's number."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, LEAST, np.int64)
        self.held = [np.zeros(0, np.int64) for _ in range(5)]  # group, score, null, id, row

    def add(self, score: np.ndarray, ok: np.ndarray, groups: np.ndarray, ids: np.ndarray, null: np.ndarray, rows: np.ndarray) -> None:
        """score, ok: a row for each of groups, a column for each candidate."""
        ok = ok & (score >= self.least[groups][:, None])
        if score.shape[1] > self.k and np.count_nonzero(ok) > 4 * self.k * len(groups):
            masked = np.where(ok, score, LEAST)
            at = score.shape[1] - self.k
            ok &= masked >= np.partition(masked, at, axis=1)[:, at : at + 1]
        i, j = np.nonzero(ok)
        if not len(i):
            return
        both = [np.concatenate([old, new]) for old, new in zip(self.held, (groups[i], score[i, j], null[j], ids[j], rows[j]), strict=True)]
        order = np.lexsort((both[4], both[3], both[2], np.invert(both[1]), both[0]))  # ~x is -x - 1: no overflow
        group = both[0][order]
        start = np.concatenate(([True], group[1:] != group[:-1]))
        n = np.arange(len(group))
        nth = n - np.maximum.accumulate(np.where(start, n, 0))
        self.held = [x[order][nth < self.k] for x in both]
        last = nth == self.k - 1
        self.least[group[last]] = both[1][order][last]


def integers(vectors: DataFrame, key: str, column: str, label: Column, scale: int = SCALE) -> DataFrame:
    """row (its number), id, label, size and vector (doubles that are integers) of the rows that take part."""
    schema = "row long, id long, label long, size int, vector binary"
    numbers = isinstance(vectors.select(label.alias("l")).schema["l"].dataType, T.IntegralType)
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), (label.cast("long") if numbers else F.when(label.isNotNull(), F.xxhash64(label))).alias("label"), F.col(column).alias("v"))

    def rows(batches):
        for batch in batches:
            size, raw = [], []
            for v in batch.column("v"):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    x = None if x is None else np.floor(scale * x) + 0.0
                good = x is not None and np.isfinite(x).all()
                size.append(len(x) if good else None)
                raw.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "id": batch.column("id"), "label": batch.column("label"), "size": pa.array(size, pa.int32()), "vector": pa.array(raw, pa.binary())})

    return own.where("label IS NOT NULL AND v IS NOT NULL").mapInArrow(tidied(rows), schema).where("vector IS NOT NULL")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float64).reshape(len(column), size)


class Anchors:
    """The anchors of a block that have one length, and their positives once these are known."""

    def __init__(self, table: pa.Table, size: int):
        self.size, self.rows, self.labels = size, table["row"].to_numpy(), table["label"].to_numpy()
        self.vectors = matrix(table["vector"], size)
        self.bands: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # of each place: which anchors, positive's row, least and most score

    def place(self, found: list[tuple[int, int, int]]) -> None:
        """found: (anchor's row, positive's row, score), in any order."""
        at, each = {r: i for i, r in enumerate(self.rows.tolist())}, {}
        for row, positive, score in found:
            if row in at:
                each.setdefault(at[row], []).append((positive, score))
        for place in range(max(map(len, each.values()), default=0)):
            own = [(i, x[place]) for i, x in sorted(each.items()) if len(x) > place]
            self.bands.append(tuple(np.array(c, np.int64) for c in ([i for i, _ in own], [p for _, (p, _) in own], [-(-LOW * s // 100) for _, (_, s) in own], [HIGH * s // 100 for _, (_, s) in own])))


def search(rows: DataFrame, anchors: dict[int, Anchors], k: int, positives: bool) -> DataFrame:
    """The k best of every anchor (positives) or of every anchor and positive, task by task: anchor, positive (null), id, row, score."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def found(batches):
        kept: dict[tuple[int, int], Best] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                own = shared.value.get(size)
                part = batch.filter(pa.array(sizes == size)) if own else None
                for lo in range(0, part.num_rows if own else 0, CANDIDATES):
                    some = part.slice(lo, CANDIDATES)
                    null = some.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                    ids, row, label = some.column("id").fill_null(0).to_numpy(), some.column("row").to_numpy(), some.column("label").to_numpy()
                    score = products(own.vectors, matrix(some.column("vector"), size))
                    same = own.labels[:, None] == label[None, :]
                    if positives:
                        best = kept.setdefault((size, 0), Best(len(own.rows), k))
                        best.add(score, same & (own.rows[:, None] != row[None, :]), np.arange(len(own.rows)), ids, null, row)
                    for place, (which, _, least, most) in enumerate([] if positives else own.bands):
                        best = kept.setdefault((size, place), Best(len(own.rows), k))
                        s = score[which]
                        best.add(s, ~same[which] & (s >= least[:, None]) & (s <= most[:, None]), which, ids, null, row)
        for (size, place), best in kept.items():
            own, (group, score, null, ids, row) = shared.value[size], best.held
            if not positives:
                which, positive = own.bands[place][:2]
                positive = positive[np.searchsorted(which, group)]
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(own.rows[group], pa.int64()),
                "positive": pa.nulls(len(group), pa.int64()) if positives else pa.array(positive, pa.int64()),
                "id": pa.array(ids, pa.int64(), mask=null.astype(bool)),
                "row": pa.array(row, pa.int64()),
                "score": pa.array(score, pa.int64()),
            })

    return rows.select("row", "id", "label", "size", "vector").mapInArrow(tidied(found), "anchor long, positive long, id long, row long, score long")


def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of all tasks' best. A filter on the rank follows at once, so Spark keeps k of each group before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int, label: Column, key: str = "vec_id", column: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows whose id is divisible by every."""
    spark = vectors.sparkSession
    rows = materialize(integers(vectors, key, column, label), "integers")
    asked = materialize(rows.where(F.col("id") % every == 0), "anchors")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("vector")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ANCHORS), math.ceil(size / BLOCK_BYTES))
    to = new_path(spark, "negatives")
    for block in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()
        sizes = table["size"].to_numpy()
        anchors = {s: Anchors(table.filter(pa.array(sizes == s)), s) for s in np.unique(sizes).tolist()}
        near = ranked(search(rows, anchors, positives, True), positives, "anchor").select("anchor", "id", "row", "score").collect()  # at most so many an anchor of the block
        for own in anchors.values():
            own.place([(r["anchor"], r["row"], r["score"]) for r in near])
        ids = dict(zip(table["row"].to_pylist(), table["id"].to_pylist(), strict=True))
        known = spark.createDataFrame([(r["anchor"], r["row"], ids[r["anchor"]], r["id"], r["score"]) for r in near], "anchor long, positive long, anchor_id long, positive_id long, positive_score long")
        far = ranked(search(rows, anchors, negatives, False), negatives, "anchor", "positive")
        out = far.join(F.broadcast(known), ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(to)
    discard(rows, asked)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(to)
