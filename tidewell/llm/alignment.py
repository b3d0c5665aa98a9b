"""Align the tokens of two tokenizers over the same bytes, and count which ids go together.

Both token streams of a text end at byte offsets; where an A token and a B token end together they cut the text into groups, and all A tokens of
a group are linked with all B tokens of it. Alignment goes in lockstep: one state vector holds the A and B pointers of all documents of a batch; each
step moves the pointer that is behind, or both and marks a cut where they are level, and documents that are done leave the vector.
A cut closes a group, whose links follow from its two ranges.

The count of an id pair is the number of documents that hold it linked. A task counts pairs of its blocks of documents, Spark sums these by pair, and
each block gets the counts of its own pairs back: in one partition they come before the block's documents, which then stream past them. So memory
follows a block's distinct pairs, and what is shuffled the distinct pairs of blocks and of documents. The highest count of each A id is at most a row for each entry of the vocabulary
and is broadcast.

A's tokens are those of the text with a space before it; B adds that space itself. Special tokens' strings are plain text. Texts that are null or
empty, or whose joined tokens of either side are not these bytes (a text that holds U+2581, say), have no tokens: zeros and an empty digest.
Rows that repeat an id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, tidied
from tidewell.llm.tokens import RARE_SPACE, Encoder, byte_symbols, tokenizer_path

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text that goes in lockstep together, and text of a block of documents whose pairs are counted together.
BATCH_BYTES, BLOCK_BYTES = 4 << 20, 64 << 20
#: Links of a group beyond which its pairs are counted by distinct ids of both sides instead of link by link.
LARGE_GROUP = 4_096


class ByteLevel(Encoder):
    """A byte-level vocabulary to which special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.odd = re.compile(RARE_SPACE)
        back = {c: b for b, c in byte_symbols().items()}
        size = self.tokenizer.get_vocab_size()
        special = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes = [special.get(i) or bytes(back[c] for c in self.tokenizer.id_to_token(i) or "") for i in range(size)]


class Pieces(Encoder):
    """A piece vocabulary with byte fallback. Pieces that span two neighbouring bytes are known, so a text is cut where no piece can."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        size, self.known, self.whole_only, self.odd = self.pieces.get_piece_size(), {}, False, re.compile(rb"(?!)")
        spans, self.bytes = np.zeros((256, 256), bool), []
        for i in range(size):
            piece = self.pieces.id_to_piece(i)
            if self.pieces.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.pieces.is_control(i) or self.pieces.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
                own = np.frombuffer(self.bytes[-1], np.uint8)
                spans[own[:-1], own[1:]] = True
        self.none = size  # stands for a unit that its tokens do not give back
        self.bytes.append(b"")
        self.free = ~spans
        self.free[:, 0x80:0xC0] = False  # inside a character
        if spans[10].any() or spans[:, 10].any():  # a line feed could not stand before a unit without effect
            self.free[:, np.arange(256) != 32] = False
        self.space = self.pieces.encode("\n")[0]

    def _units(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.free[data[:-1], data[1:]]
        cut[starts] = True
        cut[len(data)] = True
        return np.flatnonzero(cut)

    def _learn(self, units: list[str]) -> None:
        if len(self.known) + len(units) > 200_000:
            self.known.clear()
        led = [u[1:] if u[0] == " " else "\n" + u for u in units]  # the library puts a space before
        for unit, ids in zip(units, self.pieces.encode(led, num_threads=1), strict=True):
            ids = [self.space] if unit == " " else ids if unit[0] == " " else ids[2:]
            same = b"".join(map(self.bytes.__getitem__, ids)) == unit.encode()
            self.known[unit] = np.array(ids if same else [self.none], "<u4").tobytes()


@lru_cache(maxsize=2)
def coders(byte_level: str, pieces: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(byte_level), Pieces(pieces)


def encoded(coder: Encoder, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts and how many each has."""
    ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for _, _, some, bounds in coder.encode(column):
        ids.append(some)
        counts.append(np.diff(bounds))
    return np.concatenate(ids), np.concatenate(counts)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a cut stands behind each token. ends: byte offsets in all texts one after the other; counts: tokens of each text."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    stop = np.cumsum(counts_a)
    a, b = stop - counts_a, np.cumsum(counts_b) - counts_b
    a, b, stop = a[counts_a > 0], b[counts_a > 0], stop[counts_a > 0]
    while len(a):
        x, y = ends_a[a], ends_b[b]
        level = x == y
        cut_a[a[level]] = True
        cut_b[b[level]] = True
        a = a + (x <= y)
        b = b + (y <= x)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    return cut_a, cut_b


class Digits:
    """Ids in decimal, one row of bytes each, with room for what comes behind."""

    def __init__(self, size: int):
        width = len(str(size))
        own = np.arange(size).astype(f"S{width}")  # shorter ones end in zero bytes
        self.rows = np.zeros((size, width + 1), np.uint8)
        self.rows[:, :width] = np.frombuffer(own.tobytes(), np.uint8).reshape(size, width)


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = coders(byte_level, pieces)
        self.length_a, self.length_b = (np.array(list(map(len, c.bytes)), np.int64) for c in (self.a, self.b))
        self.digits = Digits(max(len(self.length_a), len(self.length_b)))
        self.many = len(self.length_b)
        if len(self.length_a) * self.many >= 1 << 32:
            raise ValueError("a pair of ids has to fit in 32 bits")

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """ids and counts of both sides; texts that either side does not give back have none."""
        column = column.cast(pa.large_string()).fill_null("")
        led = pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        size = pc.binary_length(led).to_numpy().astype(np.int64)
        sides = []
        good = np.ones(len(size), bool)
        for coder, lengths in ((self.a, self.length_a), (self.b, self.length_b)):
            ids, counts = encoded(coder, led)
            row = np.repeat(np.arange(len(counts)), counts)
            good &= np.bincount(row, lengths[ids], len(counts)).astype(np.int64) == size
            sides.append((ids, counts, row))
        return tuple(x for ids, counts, row in sides for x in (ids[good[row]], np.where(good, counts, 0)))

    def align(self, a: np.ndarray, counts_a: np.ndarray, b: np.ndarray, counts_b: np.ndarray) -> dict:
        """n_groups, n_links, digest and the distinct linked pairs with the number of their links, text by text."""
        texts = len(counts_a)
        cut_a, cut_b = lockstep(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), counts_a, counts_b)
        to_a, to_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        from_a, from_b = (np.concatenate(([0], x[:-1])) if len(x) else x for x in (to_a, to_b))
        wide, high = to_a - from_a, to_b - from_b
        text = np.searchsorted(np.cumsum(counts_a), from_a, "right")
        links = wide * high
        out = {"n_groups": np.bincount(text, minlength=texts), "n_links": np.bincount(text, links, texts).astype(np.int64)}
        out["digest"] = self.digest(a, b, to_a, to_b, from_b, wide, high, text, texts)
        # pairs: most groups link by link, large ones by their distinct ids
        small = np.flatnonzero(links <= LARGE_GROUP)
        n = links[small]
        group = np.repeat(small, n)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        row, column = np.divmod(nth, high[group])
        key = (text[group].astype(np.uint64) << np.uint64(32)) | (a[from_a[group] + row].astype(np.uint64) * np.uint64(self.many) + b[from_b[group] + column])
        key.sort()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        key, times = key[at], np.diff(np.concatenate((at, [len(key)])))
        large = np.flatnonzero(links > LARGE_GROUP)
        if len(large):
            keys, counts = [key], [times]
            for g in large.tolist():
                (x, n_x), (y, n_y) = np.unique(a[from_a[g] : to_a[g]], return_counts=True), np.unique(b[from_b[g] : to_b[g]], return_counts=True)
                keys.append(((np.uint64(text[g]) << np.uint64(32)) | (x.astype(np.uint64)[:, None] * np.uint64(self.many) + y[None, :])).reshape(-1))
                counts.append((n_x[:, None] * n_y[None, :]).reshape(-1))
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        bounds = np.searchsorted(key, np.arange(texts + 1, dtype=np.uint64) << np.uint64(32))
        return out | {"pairs": (key & np.uint64(0xFFFFFFFF)).astype("<u4"), "times": times, "bounds": bounds}

    def digest(self, a, b, to_a, to_b, from_b, wide, high, text, texts: int) -> list[str]:
        rows = np.empty((len(a) + len(b), self.digits.rows.shape[1]), np.uint8)
        at_a, at_b = np.arange(len(a)) + np.repeat(from_b, wide), np.arange(len(b)) + np.repeat(to_a, high)
        rows[at_a], rows[at_b] = self.digits.rows[a], self.digits.rows[b]
        rows[:, -1] = ord(",")
        rows[at_a[to_a - 1], -1] = ord("|")
        last = np.concatenate((text[1:] != text[:-1], [True])) if len(text) else np.zeros(0, bool)
        rows[at_b[to_b - 1], -1] = np.where(last, 0, ord(";"))
        shown = rows != 0
        size = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))
        ends = np.zeros(texts + 1, np.int64)
        ends[text[last] + 1] = (to_a + to_b)[last]
        ends = size[np.maximum.accumulate(ends)]
        flat = memoryview(rows[shown])
        return [hashlib.sha256(flat[x:y]).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    paths = byte_level or tokenizer_path(BYTE_LEVEL), pieces or tokenizer_path(PIECES)
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    # pairs and times of a document: those that are linked more than once come first, with their times; of a block: all, with the number of documents
    columns = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    types = f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"

    def rows(batches):
        from pyspark import TaskContext

        aligner, block, size = Aligner(*paths), TaskContext.get().partitionId() << 32, 0
        held, held_bytes = [], 0
        pairs, docs_of = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def flush():
            nonlocal pairs, docs_of, held, held_bytes
            ids = pa.concat_arrays([x[0] for x in held])
            a, n_a, b, n_b = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4))
            held, held_bytes = [], 0
            found = aligner.align(a, n_a, b, n_b)
            bounds, own, times = found["bounds"].tolist(), found["pairs"], found["times"]
            each, more = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                often = times[lo:hi] > 1
                each.append(own[lo:hi][often].tobytes() + own[lo:hi][~often].tobytes())
                more.append(times[lo:hi][often].astype("<u4").tobytes())
            pairs, which = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            docs_of = np.bincount(which, np.concatenate([docs_of, np.ones(len(own))]), len(pairs)).astype(np.int64)
            n = len(n_a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), ids, *(pa.array(x, pa.int64()) for x in (n_a, n_b, found["n_groups"], found["n_links"])), pa.array(found["digest"], pa.string()), pa.array(each, pa.binary()), pa.array(more, pa.binary())], columns)

        def close():
            nonlocal pairs, docs_of, size, block
            raw = pa.array([pairs.astype("<u4").tobytes()], pa.binary()), pa.array([docs_of.astype("<u4").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, ids_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *raw], columns)
            pairs, docs_of, size, block = pairs[:0], docs_of[:0], 0, block + 1

        for batch in batches:
            ids_type, text = batch.column("id").type, batch.column("text").cast(pa.large_string()).fill_null("")
            ends = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))
            lo = 0
            while lo < len(ends):
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + BATCH_BYTES - held_bytes, "right")))
                held.append((batch.column("id").slice(lo, hi - lo), *aligner.tokens(text.slice(lo, hi - lo))))
                held_bytes += int(ends[hi - 1]) - base
                size += int(ends[hi - 1]) - base
                lo = hi
                if held_bytes >= BATCH_BYTES or lo < len(ends):
                    yield from flush()
                    if size >= BLOCK_BYTES:
                        yield from close()
        if held:
            yield from flush()
        if len(pairs):
            yield from close()
        aligner.a.forget()
        aligner.b.forget()

    aligned = materialize(own.mapInArrow(tidied(rows), types), "aligned")
    is_table = "n_a IS NULL"

    def opened(batches):
        for batch in batches:
            for block, pairs, n in zip(batch.column("block").to_pylist(), batch.column("pairs"), batch.column("times"), strict=True):
                p, n = np.frombuffer(pairs.as_buffer(), "<u4").astype(np.int64), np.frombuffer(n.as_buffer(), "<u4").astype(np.int64)
                for lo in range(0, len(p), 50_000):
                    yield pa.RecordBatch.from_pydict({"block": np.full(len(p[lo : lo + 50_000]), block), "pair": p[lo : lo + 50_000], "n": n[lo : lo + 50_000]})

    tables = materialize(aligned.where(is_table).select("block", "pairs", "times").mapInArrow(tidied(opened), "block long, pair long, n long"), "pairs")
    many = Aligner(*paths).many
    counts = materialize(tables.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"pair div {many}")), "counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # no more rows than A's vocabulary
    known = counts.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    looked_up = tables.select("block", "pair").join(known, "pair").select("block", "pair", "count", "best")
    stream = looked_up.unionByName(aligned.where(f"NOT ({is_table})"), allowMissingColumns=True)
    stream = stream.repartition("block").sortWithinPartitions(F.col("block"), F.col("pair").asc_nulls_last())

    def summed(batches):
        at, table = None, []
        pair = count = best = None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            begins = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)])) if len(blocks) else np.zeros(1, np.int64)
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                if blocks[lo] != at:
                    at, table, pair = int(blocks[lo]), [], None
                part = batch.slice(lo, hi - lo)
                n = hi - lo - part.column("pair").null_count
                if n:
                    table.append([part.column(c).slice(0, n).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")])
                part = part.slice(n)
                if not part.num_rows:
                    continue
                if pair is None:
                    pair, count, best = (np.concatenate(x) for x in zip(*table, strict=True)) if table else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
                    table = []
                n_best, total = [], []
                for raw, more in zip(part.column("pairs"), part.column("times"), strict=True):
                    which = np.searchsorted(pair, np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64))
                    times = np.frombuffer(more.as_buffer(), "<u4").astype(np.int64)
                    k, c, g = len(times), count[which], best[which]
                    total.append(int(c[k:].sum() + (c[:k] * times).sum()))
                    n_best.append(int(g[k:].sum() + (g[:k] * times).sum()))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), part.column("groups_sha256")], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = stream.mapInArrow(tidied(summed), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", key)
