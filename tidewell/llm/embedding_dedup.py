"""Find near-duplicate vectors: codes by iterative quantisation, retrieval by multi-index Hamming tables, exact rerank.

Rotations are learnt by iterative quantisation on a sample of at most ``SAMPLE`` distinct vectors (the lowest by hash): signs are taken, then
the rotation that brings the vectors closest to their signs, and so on. A rotation gives a bit a dimension; several from
different starts, with fewer and fewer rounds so that they differ, make a long code. The vectors are centred at the sample's mean, so that bits are
balanced, unless that tears neighbours so far apart (in one tight cluster, say) that the index would cost more than one without.

The code is cut into disjoint blocks, each a Hamming table. Every vector is filed in each table under its block, and asks there for all
values within ``PROBED`` bits of its own. So every pair of which some block differs in no more bits than that is a candidate: all
pairs whose codes are within blocks * (PROBED + 1) - 1 bits are, and others as it happens. The width of a block follows the number of
vectors, so that tables stay sparse; the number of blocks is what the sample needs, with neighbours made at the threshold itself, to miss
no more than ``MISSED`` of them. Blocks go in rounds, so that the asks that are shuffled at a time stay in proportion to the vectors however many blocks it takes. Candidates are reranked by the cosine of the original vectors in double precision, so no link is below
the threshold. Most candidates are strangers, and a vector's doubles are long: each vector is first rounded to a byte a component, and a candidate goes on to the
rerank only if the bound of its cosine that follows from the rounded ones and from what rounding took off reaches the threshold, so that no link is lost there.

Vectors of different lengths are never compared; each length has an index of its own, for which a sample of its own is
taken, so the driver holds SAMPLE vectors for each length.

Equal vectors are one node with a count. Vectors that are null, zero, or hold null or non-finite components link with nothing.
Rows that repeat an id are vectors of their own; a null id never names a component unless all its ids are null.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import discard, materialize, mix, tidied
from tidewell.llm.components import components

COSINE = 0.9
SAMPLE = 4_000
MISSED = 0.01
ROUNDS, LEAST_WIDTH, PROBED = 30, 12, 1
#: Bytes of asks of a round of blocks, times the vectors' bytes.
ASKED = 1
#: Blocks beyond which centring is given up.
MOST = 128
#: What double precision may take from a bound, and more.
SLACK = 1e-9
SEED = 20240229


def rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation of unit vectors with the least quantisation error, from a random start."""
    r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


class Index:
    """The centre and rotations of a code, and the width and number of its blocks."""

    def __init__(self, sample: np.ndarray, vectors: int, cosine: float = COSINE, missed: float = MISSED, centred: bool = True):
        rng, d = np.random.default_rng(SEED), sample.shape[1]
        self.centre = sample.mean(axis=0) if centred else np.zeros(d)
        self.width = max(LEAST_WIDTH, math.ceil(math.log2(max(2, vectors))))
        # neighbours at the threshold: which of their bits differ, vector by vector
        other = rng.normal(size=sample.shape)
        other -= (other * sample).sum(1, keepdims=True) * sample
        other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
        other = cosine * sample + math.sqrt(1 - cosine * cosine) * other - self.centre
        own = sample - self.centre
        rotations, lost, differ = [], np.ones(len(sample)), np.zeros((len(sample), 0), bool)
        self.blocks = 0
        while self.blocks == 0 or (lost.mean() > missed and d > 1 and not (centred and self.blocks >= MOST)):
            while differ.shape[1] < self.width:
                r = rotation(own, rng, ROUNDS // (1 + len(rotations)))
                rotations.append(r)
                differ = np.hstack([differ, (own @ r >= 0) != (other @ r >= 0)])
            lost = lost * (differ[:, : self.width].sum(axis=1) > PROBED)
            differ, self.blocks = differ[:, self.width :], self.blocks + 1
        self.rotations = np.hstack(rotations)
        self.weights = mix(np.arange(1, self.width + 1, dtype=np.uint64)) | np.uint64(1)
        # how often strangers meet, block by block: what the index costs
        bits = self.bits(sample[:400])
        met = sum(((bits[:, None, i] != bits[None, :, i]).sum(axis=2) <= PROBED).mean() for i in range(self.blocks))
        self.cost = float("inf") if lost.mean() > missed and d > 1 else met

    @staticmethod
    def best(sample: np.ndarray, vectors: int, cosine: float = COSINE, missed: float = MISSED) -> "Index":
        return min((Index(sample, vectors, cosine, missed, centred) for centred in (True, False)), key=lambda x: x.cost)

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Vectors, blocks, bits of a block."""
        own = (x - self.centre) @ self.rotations[:, : self.blocks * self.width] >= 0
        return own.reshape(len(x), self.blocks, self.width)

    def rounds(self) -> int:
        """In how many rounds the blocks go, so that what a round asks for is no larger than ASKED times the vectors."""
        return min(self.blocks, max(1, math.ceil(self.blocks * (self.width + 1) * 16 / (ASKED * 8 * len(self.centre)))))

    def files(self, x: np.ndarray, part: int = 0, of: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the values that each vector has in each block, and of those that it asks for: its own and all within PROBED bits. part, of: every of-th block."""
        bits = self.bits(x)[:, part::of]
        block = mix(np.arange(1000, 1000 + self.blocks) + (x.shape[1] << 20))[part::of]
        value = (bits * self.weights).sum(axis=2, dtype=np.uint64)
        change = np.where(bits, np.uint64(0) - self.weights, self.weights)  # what a flipped bit adds to the value
        asked = [value[:, :, None]]
        for n in range(1, PROBED + 1):
            for flipped in combinations(range(self.width), n):
                asked.append(value[:, :, None] + change[:, :, list(flipped)].sum(axis=2, keepdims=True, dtype=np.uint64))
        asked = np.concatenate(asked, axis=2)
        return mix(value + block).view(np.int64), mix(asked + block[:, None]).reshape(len(x), -1).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key, node (a hash of the vector, null for one that links with nothing) and vector (float64 bytes)."""
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("vector", T.BinaryType())])

    def rows(batches):
        for batch in batches:
            node, size, raw = [], [], []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                own = (x + 0.0).tobytes() if good else None
                node.append(xxhash.xxh3_64_intdigest(own) - (1 << 63) if good else None)
                size.append(len(x) if good else None)
                raw.append(own)
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "node": pa.array(node, pa.int64()), "size": pa.array(size, pa.int32()), "vector": pa.array(raw, pa.binary())})

    return vectors.select(key, column).mapInArrow(tidied(rows), schema)


def matrix(column, kind: type = np.float64) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.zeros((0, 1), kind)


def rounded(x: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes: the step and the length of what rounding took off (float32 both), then a byte of so many steps for each component."""
    step = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    steps = np.rint(x / step[:, None]).astype(np.int8)
    off = np.linalg.norm(x - steps * step[:, None].astype(np.float64), axis=1).astype(np.float32)
    return np.hstack([np.stack([step, np.nextafter(off, np.float32(np.inf))], axis=1).view(np.uint8), steps.view(np.uint8)])


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the cosines of vectors, given as `rounded` has them, are not above: xy = x'y' + (x - x')y + x'(y - y'), and x' is no longer than 1 + |x - x'|."""
    (step, off), (other, lost) = (z[:, :8].copy().view(np.float32).astype(np.float64).T for z in (x, y))
    product = (x[:, 8:].view(np.int8).astype(np.int16) * y[:, 8:].view(np.int8)).sum(axis=1, dtype=np.int64)
    return product * step * other + off + (1 + off) * lost + SLACK


def near(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE, missed: float = MISSED) -> DataFrame:
    """key, n_links, component_id, kept of each row."""
    spark = vectors.sparkSession
    own = materialize(nodes(vectors, key, column), "vectors")
    each = materialize(own.where("node IS NOT NULL").groupBy("node").agg(F.min(key).alias("label"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "nodes")
    indexes = {}
    for r in each.groupBy("size").count().where("count > 1").collect():  # lengths of vectors: few
        sample = each.where(F.col("size") == r["size"]).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow()
        indexes[r["size"]] = Index.best(unit(matrix(sample.column(0))), r["count"], cosine, missed)
    shared_indexes = spark.sparkContext.broadcast(indexes)

    def filed(ask: bool, part: int, of: int):
        def rows(batches):
            for batch in batches:
                sizes = batch.column("size").to_numpy()
                for size in np.unique(sizes).tolist():
                    if size in shared_indexes.value:
                        own = batch.filter(pa.array(sizes == size))
                        for lo in range(0, own.num_rows, 256):
                            some = own.slice(lo, 256)
                            found = shared_indexes.value[size].files(unit(matrix(some.column("vector"))), part, of)[ask]
                            yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(some.column("node").to_numpy(), found.shape[1])), "bucket": pa.array(found.reshape(-1))})

        return each.select("node", "size", "vector").mapInArrow(tidied(rows), "node long, bucket long")

    def brief(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                if size in shared_indexes.value:
                    part = batch.filter(pa.array(sizes == size))
                    yield pa.RecordBatch.from_pydict({"node": part.column("node"), "size": part.column("size"), "brief": pa.array([x.tobytes() for x in rounded(unit(matrix(part.column("vector"))))], pa.binary())})

    def possible(batches):
        for batch in batches:
            sizes = batch.column("m").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                keep = bound(matrix(part.column("x"), np.uint8), matrix(part.column("y"), np.uint8)) >= cosine
                yield part.select(["a", "b"]).filter(pa.array(keep))

    def similar(batches):
        for batch in batches:
            sizes = batch.column("m").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                keep = (unit(matrix(part.column("x"))) * unit(matrix(part.column("y")))).sum(axis=1) >= cosine
                yield part.select(["a", "b"]).filter(pa.array(keep))

    # blocks go in rounds, each of which leaves nothing but the pairs that it found
    of, some = max((index.rounds() for index in indexes.values()), default=1), []
    for part in range(of):
        tables = materialize(filed(False, part, of), "tables")
        met = filed(True, part, of).select(F.col("node").alias("a"), "bucket").join(tables.select(F.col("node").alias("b"), "bucket"), "bucket").where("a < b").select("a", "b").distinct()
        some.append(materialize(met, "pairs"))
        discard(tables)
    pairs = some[0] if of == 1 else materialize(reduce(DataFrame.union, some).distinct(), "pairs")
    size = each.select("node", "size", "vector")
    briefs = materialize(size.mapInArrow(tidied(brief), "node long, size int, brief binary"), "briefs")

    def narrowed(found: DataFrame, sides: DataFrame, what: str, keep, label: str) -> DataFrame:
        """Those of the pairs found that keep leaves; it gets the column what of both nodes."""
        x, y = (sides.select(F.col("node").alias(end), F.col("size").alias(long), F.col(what).alias(own)) for end, long, own in (("a", "m", "x"), ("b", "n", "y")))
        return materialize(found.join(x, "a").join(y, "b").where("m = n").select("a", "b", "m", "x", "y").mapInArrow(tidied(keep), "a long, b long"), label)

    close = narrowed(pairs, briefs, "brief", possible, "close")
    discard(pairs, *some, briefs)
    links = narrowed(close, size, "vector", similar, "links")
    discard(close)
    copies = each.select("node", "label", "copies")
    ways = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = ways.join(copies.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    named = copies.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("label").alias("name"))
    named = named.join(names, "component").join(counted.withColumnRenamed("a", "node"), "node", "left")
    named = named.select("node", "name", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = own.select(key, "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("name"))
    return out.select(key, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
