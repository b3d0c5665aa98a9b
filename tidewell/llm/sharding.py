"""Place documents in shards through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table whose size is prime (an offset and a step
from two hashes of its name; the step is coprime to a prime size). Shards take turns, each claiming the first
slot in its order that is still free, so all own within one slot of the same share, and a shard that comes
or goes moves few other slots. A document's slot is its key's hash modulo the size: one broadcast lookup.

The table has ``size`` rows whatever the corpus holds, which bounds the broadcast. Rows with a null key are placed
like any other key (by the hash of null). Equal keys share a shard; a group of copies under different keys is spread,
and so is a frequent source, which is no part of the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SIZE = 65_537  # a prime; at least a hundred slots a shard keeps shares within one per cent


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """The shard (its place in shards) that owns each slot."""
    if not is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("size must be a prime, no smaller than the number of shards; their names must differ")
    owner = [-1] * size
    at = [_hash(f"offset {s}") % size for s in shards]
    step = [_hash(f"step {s}") % (size - 1) + 1 for s in shards]
    left = size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """slot, shard: size rows."""
    return spark.createDataFrame([(slot, shard) for slot, shard in enumerate(fill(shards, size))], "slot long, shard int")


def place(docs: DataFrame, shards: list[str] | int = SHARDS, size: int = SIZE, key: str = "doc_id") -> DataFrame:
    """docs with slot and shard. Columns of docs with these names are replaced."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    slotted = docs.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(size)))
    return slotted.join(F.broadcast(lookup_table(docs.sparkSession, names, size)), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(docs: DataFrame, to: str, shards: list[str] | int = SHARDS, size: int = SIZE, key: str = "doc_id", files: int = 4) -> None:
    """A folder for each shard at to, each of so many files, so that no shard is one task's work."""
    placed = place(docs, shards, size, key).drop("slot")
    n = shards if isinstance(shards, int) else len(shards)
    placed.repartition(n * files, "shard", F.pmod(F.xxhash64(key, F.lit("file")), F.lit(files))).write.partitionBy("shard").parquet(to)


def moved(before: list[str], after: list[str], size: int = SIZE) -> float:
    """The share of slots whose shard stays on but loses them when the shards change."""
    a, b = fill(before, size), fill(after, size)
    stay = set(before) & set(after)
    return sum(before[x] in stay and before[x] != after[y] for x, y in zip(a, b, strict=True)) / size
