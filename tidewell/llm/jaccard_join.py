"""Link documents whose sets of word shingles have a Jaccard similarity of at least a threshold, all such links included.

Equal sets are one node. Nodes are joined by prefix filtering under several global token orders: under any order,
two sets that are similar enough share a token among the first n - ceil(t * n) + 1 of each. The orders here put
frequent tokens last and rank the others by a hash of their own, so candidates must share prefix tokens
under independent orders, as often as the threshold demands (`needed`), before they are verified on whole sets.

Candidates meet one more exact filter before whole sets are compared: each set has a bitmap of its tokens, a few bits a token, and two
bitmaps cannot differ in more bits than the sets differ in tokens. Bitmaps folded to a few longs are held against each other where pairs are made.

Links are wanted only as far as they decide the components, so nodes that agree in a min-hash band are first verified against
hubs among them: one in the first round, then, where a band still spans components, the most central node of each of HUBS hash
classes. Central is a node whose min-hashes many others have, as copies that hardly differ from their original do, and those link with
most of a group. So a group of near copies becomes a few components with some links a node, and the prefix join then
looks only for pairs between components. No pair that could join two components is skipped: the rounds only save work.

Which tokens are frequent is estimated from a hashed sixteenth of the nodes. It decides the orders, which may be any,
and so only the amount of work, never a result. Sets are rebuilt from the texts where they are needed; no task,
and never the driver, holds a group. Shingles and sets are known by 64-bit hashes.

Words are runs of anything but ASCII white space, with A-Z lowered. A text with fewer words than a shingle is one shingle. Null or
wordless text has an empty set, links with nothing and is its own component. Rows that share an id are nodes by their text; null ids
take part but never name a component unless all its ids are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import discard, materialize, maybe_broadcast, mix, slices, tidied, unused, utf8
from tidewell.llm.components import components, merged
from tidewell.llm.tokens import SPACE

WORDS = 5
PERCENT = 80
BANDS, ROWS = 4, 2
#: Min-hashes of a node, of which the first BANDS * ROWS make its bands; a hub is tried from so many per cent of agreement.
MINS, AGREE = 16, 60
#: Rounds, and hubs of a band in each but the first.
ROUNDS, HUBS = 2, 8
#: One of so many nodes is looked at for frequent tokens; so many of them must have a token; so many tokens are put last at most.
SAMPLED, FREQUENT, LAST = 16, 4, 500_000
ORDERS = 2
#: Longs of the bitmap that pairs are held against where they are made.
FOLDED = 4
SLICE = 512 << 10
#: What a task gathers before it hands rows on, in bytes.
HELD = 4 << 20
LABELS = 400_000
C = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive texts, and where each text's words begin (n + 1 places)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    new = ~space
    first = np.concatenate(([True], space[:-1]))
    first[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(new & first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.concatenate((np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))))
    weight = mix(np.arange(1, int(at.max()) + 2, dtype=np.uint64))[at]
    value = (LOWER[data].astype(np.uint64) + np.uint64(1)) * weight
    value[space] = 0
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def shingle_sets(column, words: int = WORDS):
    """Yields (row, sorted distinct shingle hashes) for each row of a text column."""
    data, off = utf8(column)
    for lo, hi in slices(off, SLICE):
        h, at = word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        full = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for j in range(words):
            full += h[j : j + len(full)] * C[j]
        full = mix(full)
        for i in range(hi - lo):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= words:
                yield lo + i, np.unique(full[a : b - words + 1])
            elif b > a:
                yield lo + i, mix((h[a:b] * C[10 : 10 + b - a]).sum(keepdims=True) + C[9 - (b - a) : 10 - (b - a)])
            else:
                yield lo + i, np.zeros(0, np.uint64)


def signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def bitmap(own: np.ndarray) -> np.ndarray:
    """The tokens of a set as bits, numbered by their low bits: 2 to 4 bits a token, a power of two in all, as bytes."""
    size = max(64, 1 << (2 * len(own) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def folded(own: np.ndarray) -> np.ndarray:
    """A bitmap of FOLDED longs, whatever the set's size: small enough to go with every row of the join."""
    bits = np.zeros(64 * FOLDED, np.uint8)
    bits[(own & np.uint64(64 * FOLDED - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def may_link(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
    """Whether sets with these bitmaps and sizes can be similar enough: what differs in bits differs in tokens."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]  # the bitmap of half the size
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (nx + ny)


def minima(own: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The low halves of a set's min-hashes."""
    low = np.full(len(by), ~np.uint64(0))
    for lo in range(0, len(own), 1 << 14):
        np.minimum(low, (own[None, lo : lo + (1 << 14)] * by[:, None]).min(axis=1), out=low)
    return low.astype(np.uint32).view(np.int32)


def sets(docs: DataFrame, key: str) -> DataFrame:
    """key, own (a hash of the text), node (a hash of the set), n (its size), mins (the low halves of its min-hashes), bits (its bitmap) and f0.. (its folded bitmap)."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("own", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("mins", T.ArrayType(T.IntegerType())), T.StructField("bits", T.BinaryType()), *[T.StructField(f"f{k}", T.LongType()) for k in range(FOLDED)]])
    by = mix(np.arange(1000, 1000 + MINS, dtype=np.uint64)) | np.uint64(1)

    def rows(batches):
        for batch in batches:
            node, n, mins, bits, folds = [], [], [], [], [np.zeros(0, np.int64)]
            for _, own in shingle_sets(batch.column(1)):
                node.append(node_of(own))
                n.append(len(own))
                mins.append(minima(own, by))
                bits.append(bitmap(own).tobytes() if len(own) else None)
                folds.append(folded(own))
            fold = np.concatenate(folds).reshape(-1, FOLDED)
            at = pa.array(np.arange(len(mins) + 1, dtype=np.int32) * MINS)
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "own": batch.column(2), "node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()), "mins": pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *mins]))), "bits": pa.array(bits, pa.binary())} | {f"f{k}": np.ascontiguousarray(fold[:, k]) for k in range(FOLDED)})

    return docs.select(key, "text", text_hash()).mapInArrow(tidied(rows), schema)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("own")


def only(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is a label."""
    labels = labels.select(F.col("label").alias("_label"))
    return docs.select(key, "text").join(maybe_broadcast(labels, LABELS), F.col(key).eqNullSafe(F.col("_label")), "left_semi")


def tokens(docs: DataFrame, key: str, order: int | None = None, last=None) -> DataFrame:
    """node, token of the nodes of docs: all tokens, or the prefix under an order. last: a broadcast array of tokens that come last."""

    def rows(batches):
        seen: set[int] = set()
        for batch in batches:
            node, token, held = [], [], 0
            for _, own in shingle_sets(batch.column(1)):
                if not len(own) or (n := node_of(own)) in seen:
                    continue
                seen.add(n)
                if order is not None:
                    rank, late = mix(own ^ C[50 + order]), last.value
                    if len(late):
                        at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                        rank = (rank >> np.uint64(1)) | ((late[at] == own).astype(np.uint64) << np.uint64(63))
                    k = len(own) - -(-PERCENT * len(own) // 100) + 1
                    own = own[np.argpartition(rank, k - 1)[:k]] if k < len(own) else own
                node.append(np.full(len(own), n, np.int64))
                token.append(signed(own))
                held += 16 * len(own)
                if held >= HELD:
                    yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate(node)), "token": pa.array(np.concatenate(token))})
                    node, token, held = [], [], 0
            if node:
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate(node)), "token": pa.array(np.concatenate(token))})

    schema = T.StructType([T.StructField("node", T.LongType(), False), T.StructField("token", T.LongType(), False)])
    return docs.select(key, "text").mapInArrow(tidied(rows), schema)


def frequent(docs: DataFrame, key: str):
    """The tokens that many nodes have, by a sample of them, as a sorted array that tasks share: no more than LAST of them."""
    seen = tokens(docs.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(SAMPLED)) == 0), key)
    counted = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = counted.orderBy(F.desc("n"), "token").limit(LAST).select("token").toArrow()
    return docs.sparkSession.sparkContext.broadcast(np.sort(found.column("token").to_numpy().view(np.uint64)))


def needed(x: Column, y: Column) -> Column:
    """How many prefix tokens two sets of these sizes must share: beyond its prefix a set has ceil(t * n) - 1 tokens."""
    overlap = F.ceil(F.lit(PERCENT) * (x + y) / F.lit(100 + PERCENT))
    return F.greatest(F.lit(1), overlap - F.greatest(F.ceil(F.lit(PERCENT) * x / 100), F.ceil(F.lit(PERCENT) * y / 100)) + 1)


def candidates(rows: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """a, b, na, nb: pairs of different components that share as many of these prefix tokens as they need.

    Prefix tokens are shuffled once, by token; which of them meet in several components, and the rows that have these, are both read from
    that shuffle. The few such tokens are hashed, so that the many rows need no sorting.
    """
    known = maybe_broadcast(comps.select("node", "component"))
    placed = rows.repartition("token").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    folds = [f"f{k}" for k in range(FOLDED)]
    kept = materialize(placed.join(spread.hint("shuffle_hash"), "token").join(nodes.select("node", "n", *folds), "node"), "spread-rows")
    x = kept.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), *[F.col(f).alias(f"{f}a") for f in folds])
    y = kept.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), *[F.col(f).alias(f"{f}b") for f in folds])
    near = (F.lit(PERCENT) * F.col("na") <= 100 * F.col("nb")) & (F.lit(PERCENT) * F.col("nb") <= 100 * F.col("na"))
    differ = sum((F.bit_count(F.col(f"{f}a").bitwiseXOR(F.col(f"{f}b"))) for f in folds), F.lit(0))  # as `may_link`
    able = F.lit(100 + PERCENT) * differ <= F.lit(100 - PERCENT) * (F.col("na") + F.col("nb"))
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near & able)
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    found = materialize(counted.where(F.col("shared") >= needed(F.col("na"), F.col("nb"))).drop("shared"), "candidates")
    discard(kept)
    return found


def ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps let them be similar enough: none that is goes."""
    asked = materialize(nodes.select("node", "n", "bits").join(ends(pairs), "node"), "bitmaps")
    side = lambda end: asked.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"{end}_bits"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "a_bits", "b_bits")

    def rows(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(k)] for k in ("a_bits", "b_bits"))
            n, m = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array(list(map(may_link, x, y, n, m)), pa.bool_()))

    found = materialize(both.mapInArrow(tidied(rows), "a long, b long"), "close")
    discard(asked)
    return found


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = close(pairs, nodes)
    labels = materialize(nodes.join(ends(pairs), "node").select("node", "label"), "asked")

    def whole(batches):
        seen: set[int] = set()
        for batch in batches:
            found, held = {}, 0
            for _, own in shingle_sets(batch.column(1)):
                if len(own) and (n := node_of(own)) not in seen:
                    seen.add(n)
                    found[n] = own.tobytes()
                    held += len(found[n])
                if held >= HELD:
                    yield pa.RecordBatch.from_pydict({"node": pa.array(list(found), pa.int64()), "own": pa.array(list(found.values()), pa.binary())})
                    found, held = {}, 0
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(found), pa.int64()), "own": pa.array(list(found.values()), pa.binary())})

    stored = only(docs, labels, key).mapInArrow(tidied(whole), "node long, own binary").join(maybe_broadcast(labels.select("node"), LABELS), "node", "left_semi")
    written = materialize(stored, "sets")
    stored = written.dropDuplicates(["node"])  # the same shuffle brings a pair's first set to it
    both = pairs.select("a", "b").join(stored.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(stored.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * same >= PERCENT * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(both.select("a", "b", "x", "y").mapInArrow(tidied(similar), "a long, b long").distinct(), "verified")
    discard(pairs, labels, written)
    return found


def central(nodes: DataFrame) -> DataFrame:
    """node, score: how often these nodes have its min-hashes, which is how similar it is to them on average, but for a factor."""
    each = nodes.select("node", F.posexplode("mins").alias("place", "low"))
    has = each.groupBy("place", "low").agg(F.count(F.lit(1)).alias("has"))
    return each.join(has, ["place", "low"]).groupBy("node").agg(F.sum("has").cast("double").alias("score"))


def hubs(nodes: DataFrame, comps: DataFrame | None, turn: int) -> DataFrame:
    """a, b: nodes with the hubs of their bands, if these are of other components and their min-hashes agree enough."""
    bands = F.array(*[F.xxhash64(F.lit(j), *[F.col("mins")[j * ROWS + i] for i in range(ROWS)]) for j in range(BANDS)])
    placed = nodes.select("node", F.col("node").alias("component"), F.explode(bands).alias("band"))
    if comps is not None:
        placed = placed.drop("component").join(maybe_broadcast(comps), "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    spread = materialize(spread, "spread-bands")
    banded = materialize(placed.join(maybe_broadcast(spread), "band"), "placed")
    mins = materialize(nodes.select("node", "mins").join(banded.select("node").distinct(), "node"), "mins")
    placed, score, scores = banded.join(mins, "node"), F.lit(0.0), None
    if comps is not None:
        scores = materialize(central(mins), "scores")
        placed, score = placed.join(maybe_broadcast(scores), "node", "left"), F.coalesce("score", F.lit(0.0))
    tie = F.xxhash64("node", F.lit(turn))
    kind = F.pmod(tie, F.lit(1 if comps is None else HUBS)).alias("kind")
    best = placed.groupBy("band", kind).agg(F.max(F.struct(score.alias("score"), tie.alias("tie"), F.col("node").alias("hub"), F.col("component").alias("theirs"))).alias("best"))
    best = materialize(best.select("band", "best.hub", "best.theirs").join(mins.select(F.col("node").alias("hub"), F.col("mins").alias("own")), "hub"), "best")
    pairs = placed.join(maybe_broadcast(best), "band").where("component != theirs")
    agree = F.size(F.filter(F.zip_with("mins", "own", lambda x, y: x == y), lambda same: same))
    found = materialize(pairs.where(100 * agree >= AGREE * MINS).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "hubs")
    discard(spread, banded, mins, scores, best)
    return found


def grouped(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows' sets, and label and component of each node."""
    made = materialize(sets(docs, key), "sets")
    first = F.first(F.struct("mins", "bits", *[f"f{k}" for k in range(FOLDED)])).alias("first")
    nodes = materialize(made.where("n > 0").groupBy("node").agg(F.min(key).alias("label"), F.max("n").alias("n"), first).select("node", "label", "n", "first.*"), "nodes")
    reps = only(docs, nodes, key)
    comps = None
    for turn in range(ROUNDS):
        tried = hubs(nodes, comps, turn)
        links = verified(tried, docs, nodes, key)
        new = materialize(components(links) if comps is None else merged(comps, links), "components")
        discard(tried, links, comps)
        comps = new
    late = frequent(reps, key)
    pairs = candidates(tokens(reps, key, 0, late), nodes, comps)
    for order in range(1, ORDERS):
        asked = materialize(nodes.join(ends(pairs), "node").select("node", "label"), "asked")
        rows = tokens(only(docs, asked, key), key, order, late)
        other = candidates(rows, nodes, comps)
        new = materialize(pairs.join(other.select("a", "b"), ["a", "b"]), "candidates")
        discard(asked, pairs, other)
        pairs = new
    links = verified(pairs, docs, nodes, key)
    new = materialize(merged(comps, links), "components")
    discard(comps, pairs, links)
    named = nodes.select("node", "label").join(new, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "named")
    discard(nodes, new)
    return made, named


def link(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of each row."""
    made, named = grouped(docs, key)
    names = named.groupBy("component").agg(F.min("label").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    out = made.join(named, "node", "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))


def one_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs without near copies, row by row: of each component the row with the smallest key (nulls last), then the smallest
    hash of its text; of rows equal in both, the smallest by all columns. Rows without words all stay."""
    made, named = grouped(docs, key)
    rows = materialize(made.where("n > 0").select(key, "own", "node").join(named.select("node", "component"), "node").groupBy("component", key, "own").agg(F.count(F.lit(1)).alias("times")), "rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), "own")).alias("first"), F.sum("times").alias("n_rows")).where("n_rows > 1")
    stays = F.col(key).eqNullSafe(F.col("first.key")) & (F.col("own") == F.col("first.own"))
    # a row is known by key and text; only rows of groups of several are here
    k, own, times = (unused(docs, f"row_{c}") for c in ("key", "own", "times"))
    known = rows.join(first, "component").select(F.col(key).alias(k), F.col("own").alias(own), F.when(stays, F.col("times")).otherwise(F.lit(0)).alias(times))
    known = maybe_broadcast(materialize(known, "known-rows"), LABELS)
    discard(made, named, rows)
    found = docs.join(known, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own)), "left")
    single = found.where(F.col(times).isNull() | (F.col(times) == 1)).select(docs.columns)
    equal = found.where(F.col(times) > 1).groupBy(k, own).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.union(equal)
