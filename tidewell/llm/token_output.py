"""Token ids of documents as raw payloads with constant-time keyed access.

Format: a table in which each row is one block of consecutive documents in ascending key order:
``shard, block`` (ascending with the key), ``n_docs, n_ids``, ``payload`` (all ids, little-endian,
two bytes each if the vocabulary allows, else four), ``keys`` (int64), and a minimal perfect hash index:
``displacements`` (int32), ``fingerprints`` (uint32) and ``slots`` (uint32: which document of the block), with
``ends`` (int64: ids up to the end of each document). A key is looked up by hash and displace: its bucket's
displacement gives its slot out of exactly n_docs, the stored fingerprint says whether it is there.
Spark writes the table, so a failed task leaves nothing behind and any store will do.

A key is the document's id with its occurrence: rows that repeat an id are documents of their own (in order of
their text), null ids come first. Null text counts as empty. A block is closed at ``block_ids`` ids; a
longer document has a block of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import maybe_broadcast, mix, new_path, tidied
from tidewell.llm.tokens import encoder, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 20
BLOCKS = "shard int, block int, first_key long, last_key long, n_docs long, n_ids long, width int, payload binary, keys binary, nulls long, first_occurrence long, displacements binary, fingerprints binary, slots binary, ends binary"
STEP = np.uint64(0x9E3779B97F4A7C15)


def key_hash(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """occurrence: 0.. among equal keys; a negative one stands for a null key."""
    return mix(mix(keys.astype(np.int64).view(np.uint64)) + occurrence.astype(np.int64).view(np.uint64) * STEP)


def occurrences(keys: np.ndarray, nulls: int, first: int) -> np.ndarray:
    """Of each row of a block: nulls rows come first; first: how many rows of its first key stand in blocks before."""
    n = np.arange(len(keys))
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    new[nulls : nulls + 1] = True
    start = np.maximum.accumulate(np.where(new, n, 0))
    out = n - start + np.where(start == 0, first, 0)
    return np.where(n < nulls, -1 - out, out)


def _slot(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    moved = (mix(hashes + displacement.astype(np.int64).view(np.uint64) * STEP) % np.uint64(n)).astype(np.int64)
    return np.where(displacement < 0, -displacement.astype(np.int64) - 1, moved)


def perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """Displacements of about n / 4 buckets under which n distinct hashes fall into n distinct slots."""
    n = len(hashes)
    buckets = (hashes % np.uint64(max(1, n // 4))).astype(np.int64)
    out, taken = np.zeros(max(1, n // 4), np.int32), np.zeros(n, bool)
    order = np.argsort(buckets, kind="stable")
    sizes = np.bincount(buckets, minlength=len(out))
    ends = np.cumsum(sizes)
    free: list[int] | None = None
    for b in np.argsort(-sizes, kind="stable").tolist():
        own = hashes[order[ends[b] - sizes[b] : ends[b]]]
        if len(own) == 0:
            break
        if len(own) == 1:  # the last ones: any free slot, named outright
            if free is None:
                free = np.flatnonzero(~taken).tolist()
            out[b] = -free.pop() - 1
            continue
        base = 0
        while True:
            tries = np.arange(base, base + 64, dtype=np.int64)
            slots = (mix(own[None, :] + tries.view(np.uint64)[:, None] * STEP) % np.uint64(n)).astype(np.int64)
            ordered = np.sort(slots, axis=1)
            fits = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                k = int(np.argmax(fits))
                out[b] = base + k
                taken[slots[k]] = True
                break
            base += 64
    return out


def block_row(shard: int, block: int, keys: np.ndarray, nulls: int, first: int, ids: list[np.ndarray], width: int) -> dict:
    hashes = key_hash(keys, occurrences(keys, nulls, first))
    moves = perfect_hash(hashes)
    slot = _slot(hashes, moves[(hashes % np.uint64(len(moves))).astype(np.int64)], len(keys))
    prints, slots = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slot], slots[slot] = (mix(hashes ^ STEP) >> np.uint64(32)).astype("<u4"), np.arange(len(keys))
    ends = np.cumsum([len(x) for x in ids]).astype("<i8")
    payload = np.concatenate(ids).astype(f"<u{width}").tobytes()
    return {"shard": shard, "block": block, "first_key": int(keys[nulls]) if nulls < len(keys) else None, "last_key": int(keys[-1]) if nulls < len(keys) else None, "n_docs": len(keys), "n_ids": int(ends[-1]), "width": width, "payload": payload, "keys": keys.astype("<i8").tobytes(), "nulls": nulls, "first_occurrence": first, "displacements": moves.astype("<i4").tobytes(), "fingerprints": prints.tobytes(), "slots": slots.tobytes(), "ends": ends.tobytes()}


def write(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID, key: str = "doc_id", block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of docs to the table at to, in ascending order of the key."""
    path = path or tokenizer_path(VOCABULARY)
    schema = docs.sparkSession.createDataFrame([], BLOCKS).schema

    def blocks(batches):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        coder = encoder(path)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        keys: list[int] = []
        absent, first, ids, n, last, seen = 0, 0, [], 0, object(), 0

        def flush():
            nonlocal keys, absent, ids, n, block
            row = block_row(shard, block, np.array(keys, np.int64), absent, first, ids, width)
            keys, absent, ids, n, block = [], 0, [], 0, block + 1
            return pa.RecordBatch.from_pylist([row], schema=to_arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        to_arrow = to_arrow_schema(schema)
        for batch in batches:
            own = batch.column(0).to_pylist()
            for lo, hi, found, at in coder.encode(batch.column(1)):
                for i in range(hi - lo):
                    k = own[lo + i]
                    seen = seen + 1 if k == last else 0
                    last = k
                    if not keys:
                        first = seen
                    keys.append(0 if k is None else k)
                    absent += k is None
                    ids.append(np.append(found[at[i] : at[i + 1]], np.uint32(end_id)))
                    n += len(ids[-1])
                    if n >= block_ids:
                        yield flush()
        if keys:
            yield flush()
        coder.forget()

    ordered = docs.select(F.col(key).cast("long").alias(key), "text").repartitionByRange(key).sortWithinPartitions(key, "text")
    ordered.mapInArrow(tidied(blocks), schema).write.option("compression", "zstd").parquet(to)
    return to


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """shard, block, first_key, last_key and start: how many ids stand before the block."""
    blocks = spark.read.parquet(at).select("shard", "block", "first_key", "last_key", "n_docs", "n_ids")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))  # a row for each range partition
    shards = shards.select("shard", (F.sum("all_ids").over(Window.orderBy("shard")) - F.col("all_ids")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    return blocks.withColumn("within", within).join(shards, "shard").withColumn("start", F.col("within") + F.col("before")).drop("within", "before", "n_ids", "n_docs")


class Block:
    """A block of the table in memory, and its keyed access."""

    def __init__(self, row: dict):
        self.n, self.nulls = row["n_docs"], row["nulls"]
        self.ids = np.frombuffer(row["payload"], f"<u{row['width']}")
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.moves, self.prints, self.slots, self.ends = (np.frombuffer(row[k], d) for k, d in (("displacements", "<i4"), ("fingerprints", "<u4"), ("slots", "<u4"), ("ends", "<i8")))

    def find(self, keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Which document of the block each key is, -1 for one that the fingerprints don't know."""
        hashes = key_hash(keys, occurrence)
        slot = _slot(hashes, self.moves[(hashes % np.uint64(len(self.moves))).astype(np.int64)], self.n)
        known = self.prints[slot] == (mix(hashes ^ STEP) >> np.uint64(32)).astype("<u4")
        return np.where(known, self.slots[slot].astype(np.int64), -1)

    def span(self, doc: int) -> tuple[int, int]:
        return int(self.ends[doc - 1]) if doc else 0, int(self.ends[doc])


def digests(spark: SparkSession, at: str, key: str = "doc_id") -> DataFrame:
    """Each document as read back through the index: key, start, n_tokens, ids_crc32."""
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"
    columns = ["start", "n_docs", "nulls", "first_occurrence", "width", "payload", "keys", "displacements", "fingerprints", "slots", "ends"]

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in columns}
                block = Block(row)
                docs = block.find(block.keys, occurrences(block.keys, block.nulls, row["first_occurrence"]))
                if (docs < 0).any():
                    raise ValueError("a key's fingerprint differs from the stored one")
                spans = [block.span(d) for d in docs.tolist()]
                yield pa.RecordBatch.from_pydict({
                    key: pa.array([None if j < block.nulls else int(x) for j, x in enumerate(block.keys)], pa.int64()),
                    "start": pa.array([row["start"] + a for a, _ in spans], pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(block.ids[a:b].astype("<u4")) for a, b in spans], pa.int64()),
                })

    blocks = spark.read.parquet(at).drop("first_key", "last_key", "n_ids")
    return blocks.join(maybe_broadcast(manifest(spark, at)), ["shard", "block"]).select(columns).mapInArrow(tidied(rows), schema)


def lookup(spark: SparkSession, at: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of the wanted keys (the first document of each): key, ids. Keys that aren't there have no row."""
    routes = maybe_broadcast(manifest(spark, at).select("shard", "block", "first_key", "last_key"))
    asked = wanted.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    asked = asked.join(routes, (F.col("k") >= F.col("first_key")) & (F.col("k") <= F.col("last_key")))
    asked = asked.groupBy("shard", "block").agg(F.collect_list("k").alias("asked"))  # no more than a block's key range

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, keys = Block(row), np.array(row["asked"], np.int64)
                found = block.find(keys, np.zeros(len(keys), np.int64))
                hits = [(int(k), block.ids[slice(*block.span(d))]) for k, d in zip(keys, found.tolist(), strict=True) if d >= 0 and block.keys[d] == k]
                yield pa.RecordBatch.from_pydict({key: pa.array([k for k, _ in hits], pa.int64()), "ids": pa.array([x.astype(np.int32) for _, x in hits], pa.list_(pa.int32()))})

    return spark.read.parquet(at).drop("first_key", "last_key").join(asked, ["shard", "block"]).mapInArrow(tidied(rows), f"{key} long, ids array<int>")


def token_output(docs: DataFrame, path: str | None = None, end_id: int = END_ID, key: str = "doc_id") -> DataFrame:
    """Write docs to a new table in the shared folder and read it back."""
    spark = docs.sparkSession
    return digests(spark, write(docs, new_path(spark, "token-ids"), path, end_id, key), key)
