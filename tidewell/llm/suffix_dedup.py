"""Remove repeated passages: each byte that a string of ``LENGTH`` bytes covers which also starts earlier.

Strings that are equal have to meet without a row for every position. Of the ``GRAM``-byte grams in a string of LENGTH bytes the one with the smallest
hash (the first of equals) is its seed, which its content alone decides; neighbouring strings mostly share theirs, so a text becomes a run of strings about
every 32 bytes: its seed, a hash of all it covers, where it starts and how many strings it has. Runs whose seed occurs once are done with. Equal runs
are settled by their hashes: all but the first go, wherever they are. What is left are first runs that share a seed but not all their bytes.

These meet by seed, and their texts are compared by a threshold-bounded interval expansion (`repeats`): over the Burrows-Wheeler transform of a
block of runs, intervals of strings are extended backward breadth first, which gives the common prefixes of neighbouring suffixes by increasing value;
it stops at LENGTH, when the boundaries still not found are those between suffixes that share LENGTH bytes or more.

A seed with more than ``GROUP`` different runs is dealt over as many groups as it takes; these settle what they hold, and the first of each string in each
of them meet again by two 64-bit hashes of the string, a row for each group. Repeats inside a slice of a task are settled before anything is shuffled.

Texts are UTF-8 bytes; null counts as empty. Rows that repeat an id are documents of their own, in order of a hash of their text, null ids last; of rows
equal in both, all but one lose every byte from LENGTH on. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialize, mix, slices, tidied, utf8

LENGTH, GRAM = 100, 32
#: Bytes of text that are cut into runs at once, and that a task looks for repeats in before it hands runs on.
SLICE_BYTES, LOCAL_BYTES = 1 << 20, 16 << 20
#: Runs of one seed that are compared in one group; bytes of runs that are compared at once.
GROUP, BLOCK_BYTES = 4_096, 1 << 20
PARTITION_BYTES = 8 << 20
SEPARATOR = 0  # symbols are bytes plus one
U = np.uint64
FACTORS = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]
LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * FACTORS[0])


def grams(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the n bytes (a power of two) from each position on that has as many."""
    h, k = LETTERS[data], 1
    for factor in FACTORS:
        if k == n:
            return h
        if len(h) <= k:
            return np.zeros(0, np.uint64)
        left = h[:-k] * factor
        left += h[k:]
        left ^= left >> U(29)
        h, k = left, 2 * k
    raise ValueError(n)


def spans(hashes: np.ndarray, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of the length bytes (GRAM at least) from each of the positions on, by the grams that cover them."""
    out = np.full(len(at), U(salt + 1))
    for step in [*range(0, length - GRAM, GRAM), length - GRAM]:
        out = (out * FACTORS[1]) ^ hashes[at + step]
        out ^= out >> U(31)
    return mix(out)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the width values from each position on."""
    out, k = values, 1
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    return np.minimum(out[: len(out) - (width - k)], out[width - k :]) if k < width else out


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts that end there: seed, hash, start and number of the strings of each run. A text is no longer than 2^24 bytes, or comes in pieces."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    if len(data) < length:
        return none
    h = grams(data)
    place = U((1 << 24) - 1)
    least = smallest((h & ~place) | (np.arange(len(h), dtype=np.uint64) & place), length - GRAM + 1)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(least) + 1, np.int8)  # +1 where a text's strings begin, -1 after its last
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    p = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    if not len(p):
        return none
    own = least[p]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1))))
    n = np.diff(np.concatenate((first, [len(p)])))
    start = p[first]
    seed = h[(own[first] & place).astype(np.int64)]
    text = mix(spans(h, start, length) * FACTORS[2] + spans(h, start + n - 1, length) * FACTORS[3] + n.astype(np.uint64))
    return seed, text, start, n


def merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of a document as one; in order of document and start."""
    if not len(doc):
        return doc, start, n
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1]))))
    return doc[new], start[new], np.add.reduceat(n, new)


def cut(batches, length: int = LENGTH):
    """doc, seed, text, start, n of the runs of texts. A run that is equal to an earlier one of the same slice of the task goes without a seed: it is a repeat."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush():
        doc, seed, text, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, doc))
        doc, seed, text, start, n = (x[order] for x in (doc, seed, text, start, n))
        both = mix(seed * FACTORS[4] + text)
        order = np.argsort(both, kind="stable")
        again = np.zeros(len(doc), bool)
        again[order[1:]] = both[order[1:]] == both[order[:-1]]
        yield pa.RecordBatch.from_pydict({"doc": doc[~again], "seed": seed[~again].view(np.int64), "text": text[~again].view(np.int64), "start": start[~again], "n": n[~again]})
        d, s, k = merged(doc[again], start[again], n[again])
        yield pa.RecordBatch.from_pydict({"doc": d, "seed": pa.nulls(len(d), pa.int64()), "text": pa.nulls(len(d), pa.int64()), "start": s, "n": k})

    for batch in batches:
        docs, (data, off) = batch.column("doc").to_numpy(), utf8(batch.column("text"))
        for lo, hi in slices(off, SLICE_BYTES):
            for a in range(int(off[lo]), int(off[hi]), 4 * SLICE_BYTES):  # only a text of its own is longer
                b = min(int(off[hi]), a + 4 * SLICE_BYTES + length - 1)
                ends = np.minimum(off[lo + 1 : hi + 1], b) - a
                seed, text, start, n = runs(data[a:b], ends, length)
                which = np.searchsorted(ends, start, "right")
                held.append((docs[lo + which], seed, text, start + a - off[lo + which], n))
                size += b - a
                if size >= LOCAL_BYTES:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of the length symbols or more from them on, by doubling."""
    n, width = len(symbols), 7  # symbols of nine bits in a long
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = (key << 9) | padded[i : i + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
        if width >= length or rank[order[-1]] == n:
            return order
        key = rank << 32
        key[: max(0, n - width)] |= rank[width:]
        width *= 2


def boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order shares fewer than length symbols with the one before it.

    An interval of a string is extended backward by each symbol that stands before its suffixes; where the extended one ends, the next suffix
    shares as many symbols with it as the string had, if no shorter string has shown so before. Intervals whose end was known are not followed.
    """
    n = len(symbols)
    before = symbols[order - 1]
    by = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)  # from a suffix to the one with the symbol before it
    to[by] = np.arange(n)
    same = before[by[1:]] == before[by[:-1]]
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by[:-1][same]], previous[by[1:][same]] = by[1:][same], by[:-1][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])
    for found in range(length):
        if not len(low):
            break
        size = high - low + 1
        at = np.repeat(low - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        open_ = before[at] != SEPARATOR if found else np.ones(len(at), bool)
        first = np.sort(to[at[open_ & (previous[at] < np.repeat(low, size))]])
        last = np.sort(to[at[open_ & (following[at] > np.repeat(high, size))]])
        new = ~known[last + 1]
        low, high = first[new], last[new]
        known[high + 1] = True
    return known[:n]


def repeats(data: np.ndarray, ends: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in the order of their places: positions in data whose string occurs at an earlier one, and those of the first of each string."""
    starts = np.concatenate(([0], ends[:-1]))
    symbols = np.zeros(len(data) + len(ends), np.uint16)
    place = np.arange(len(data)) + np.repeat(np.arange(len(ends)), ends - starts)
    symbols[place] = data + np.uint16(1)
    back = np.full(len(symbols), -1, np.int64)  # positions in data of those at which a run's strings start
    at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    back[place[at]] = at
    order = suffixes(symbols, length)
    string = np.cumsum(boundaries(symbols, order, length))
    own = back[order]
    string, own = string[own >= 0], own[own >= 0]
    begin = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1]))) if len(own) else np.zeros(0, np.int64)
    first = np.minimum.reduceat(own, begin) if len(own) else own
    again = np.ones(len(data), bool)
    again[first] = False
    return own[again[own]], first


def compared(batches, length: int = LENGTH):
    """doc, start, n of repeats among runs that come in order of seed and group; of shared groups (hot) also the first of each string: doc, start, a, b (its hashes)."""
    names = ["seed", "part", "hot", "doc", "start", "n"]

    def found(table: pa.Table):
        table = table.combine_chunks()
        doc, start, n, hot = (table[c].to_numpy() for c in ("doc", "start", "n", "hot"))
        order = np.lexsort((start, doc))
        data, off = utf8(table["run"].take(pa.array(order)).cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
        doc, start, n, hot = doc[order], start[order], n[order], hot[order]
        ends, base = off[1:] - off[0], off[:-1] - off[0]
        data = data[off[0] : off[-1]]
        again, first = repeats(data, ends, n, length)
        again = np.sort(again)
        run = np.searchsorted(ends, again, "right")
        d, s, k = merged(doc[run], start[run] + again - base[run], np.ones(len(again), np.int64))
        yield pa.RecordBatch.from_pydict({"doc": d, "start": s, "n": k, "a": pa.nulls(len(d), pa.int64()), "b": pa.nulls(len(d), pa.int64())})
        run = np.searchsorted(ends, first, "right")
        first, run = first[hot[run]], run[hot[run]]
        if len(first):
            h = grams(data)
            a, b = (spans(h, first, length, salt).view(np.int64) for salt in (0, 1))
            yield pa.RecordBatch.from_pydict({"doc": doc[run], "start": start[run] + first - base[run], "n": np.ones(len(run), np.int64), "a": a, "b": b})

    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch]).select([*names, "run"])
        held = new if held is None else pa.concat_tables([held, new])
        size = np.cumsum(pc.binary_length(held["run"]).to_numpy())
        if len(size) and size[-1] >= BLOCK_BYTES:
            seed, part = held["seed"].to_numpy(), held["part"].to_numpy()
            begins = np.concatenate(([0], np.flatnonzero((seed[1:] != seed[:-1]) | (part[1:] != part[:-1])) + 1))
            lo = 0
            for hi in begins[1:].tolist():  # a group is never cut, and the last one may go on
                if size[hi - 1] - (size[lo - 1] if lo else 0) >= BLOCK_BYTES or hi == begins[-1]:
                    yield from found(held.slice(lo, hi - lo))
                    lo = hi
            held = held.slice(lo)
    if held is not None and held.num_rows:
        yield from found(held)


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """doc (a number that ascends with the key), key, text and copies of the different rows; and tables to discard when all is done."""
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return own.select(F.col("id").cast("long").alias("doc"), "id", "text", F.lit(1).cast("long").alias("copies")), []
    each = own.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("id", F.sha2(F.col("text"), 256).alias("hash")).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    each = materialize(each, "texts")
    order = [F.asc_nulls_last("id"), F.asc("hash")]
    # partitions of a range sort ascend, and so do these numbers
    places = materialize(each.select("id", "hash").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()), "places")
    both = each.alias("x").join(places.alias("y"), F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.hash") == F.col("y.hash"))).select("doc", "x.id", "text", "copies")
    out = materialize(both, "documents")
    discard(each, places)
    return out, [out]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, start, n: strings of documents (doc, text) that occur earlier, n of them one after the other. In several rows, in no order."""
    every = materialize(docs.select("doc", "text").mapInArrow(tidied(lambda b: cut(b, length)), "doc long, seed long, text long, start long, n long"), "runs")
    seeded = every.where("seed IS NOT NULL")
    often = materialize(seeded.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("seed"), "often")  # as a table: Spark can then split a hot seed in the join
    some = materialize(seeded.join(often, "seed"), "seeded")
    known = materialize(every.where("seed IS NULL").select("doc", "start", "n"), "known")
    discard(every, often)
    firsts = materialize(some.groupBy("seed", "text").agg(F.min(F.struct("doc", "start", "n")).alias("first"), F.count(F.lit(1)).alias("c")).select("seed", "text", "first.*", "c"), "firsts")
    equal = some.join(firsts.where("c > 1").select("seed", "text", F.col("doc").alias("d"), F.col("start").alias("s")), ["seed", "text"]).where("doc != d OR start != s").select("doc", "start", "n")
    equal = materialize(equal, "equal")
    discard(some)
    # seeds that different runs share
    shared = materialize(firsts.groupBy("seed").agg(F.count(F.lit(1)).alias("different")).where("different > 1"), "shared")
    groups = F.ceil(F.col("different") / GROUP)
    mixed = firsts.join(shared, "seed").select("doc", F.struct("seed", F.pmod("text", groups).cast("int").alias("part"), (groups > 1).alias("hot"), "start", "n").alias("run"))
    lists = mixed.groupBy("doc").agg(F.collect_list("run").alias("runs"))

    def texts(batches):
        for batch in batches:
            lists, (data, off) = batch.column("runs"), utf8(batch.column("text"))
            flat, counts = lists.flatten(), lists.value_lengths().to_numpy()
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(counts)), counts)
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            for lo in range(0, len(flat), 20_000):
                k = slice(lo, lo + 20_000)
                a = off[row[k]] + start[k]
                size = n[k] + length - 1
                ends = np.concatenate(([0], np.cumsum(size)))
                raw = data[np.repeat(a - ends[:-1], size) + np.arange(ends[-1])]
                run = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                part = flat.slice(lo, len(a))
                yield pa.RecordBatch.from_pydict({"seed": part.field("seed"), "part": part.field("part"), "hot": part.field("hot"), "doc": batch.column("doc").take(pa.array(row[k])), "start": part.field("start"), "n": part.field("n"), "run": run})

    with_text = docs.select("doc", "text").join(lists, "doc").mapInArrow(tidied(texts), "seed long, part int, hot boolean, doc long, start long, n long, run binary")
    with_text = materialize(with_text, "run-texts")
    size = with_text.agg(F.coalesce(F.sum(F.length("run")), F.lit(0))).first()[0]
    dealt = with_text.repartition(max(1, -(-size // PARTITION_BYTES)), "seed", "part").sortWithinPartitions("seed", "part")
    seen = materialize(dealt.mapInArrow(tidied(lambda b: compared(b, length)), "doc long, start long, n long, a long, b long"), "compared")
    discard(with_text, firsts, shared)
    # the first of a string in each group of a hot seed: all but the first of them
    again = seen.where("a IS NOT NULL").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("doc", "start"))).alias("all")).where("size(all) > 1")
    again = again.select(F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("x")).select("x.doc", "x.start", F.lit(1).cast("long").alias("n"))
    return known.union(equal).union(seen.where("a IS NULL").select("doc", "start", "n")).union(again)


def coverage(start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the removed runs of a text begin and end."""
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate((start + n - 1 + length)[order])
    new = np.concatenate(([True], start[1:] > end[:-1])) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return start[at], end[np.concatenate((at[1:], [len(start)])) - 1] if len(start) else end


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the text's remaining bytes) of each row."""
    own, spent = numbered(docs, key, text)
    found = repeated_spans(own, length).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("found"))

    def kept(batches):
        for batch in batches:
            lists, (data, off) = batch.column("found"), utf8(batch.column("text"))
            flat, counts = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            at = np.concatenate(([0], np.cumsum(counts)))
            start, n = (flat.field(c).to_numpy() for c in ("start", "n"))
            removed, number, left = [], [], []
            for i in range(batch.num_rows):
                whole = data[off[i] : off[i + 1]]
                if counts[i]:
                    a, b = coverage(start[at[i] : at[i + 1]], n[at[i] : at[i + 1]], length)
                    keep = np.concatenate(([0], b)), np.concatenate((a, [len(whole)]))
                    left.append(b"".join(whole[x:y].tobytes() for x, y in zip(*keep, strict=True)))
                    removed.append(int((b - a).sum()))
                    number.append(len(a))
                else:
                    left.append(whole.tobytes())
                    removed.append(0)
                    number.append(0)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "copies": batch.column("copies"), "n_bytes": np.diff(off), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(number, pa.int64()), "kept": pa.array(left, pa.binary())})

    joined = own.join(found, "doc", "left").select("id", "copies", "text", "found")
    out = joined.mapInArrow(tidied(kept), joined.select("id", "copies").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary"))
    if not spent:
        return out.select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept")
    # the further copies of a row repeat all of it
    all_ = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(F.col("id").alias(key), "n_bytes", F.when(all_, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(all_, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(all_, F.encode(F.lit(""), "utf-8")).otherwise(F.col("kept")).alias("kept"))
