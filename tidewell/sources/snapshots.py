"""Tables that are replaced together: a snapshot is written whole, then committed; a reader keeps to the one it opened.

Below a folder, ``data`` holds what writers wrote, each write in a folder of its own, and ``commits`` a small file for each
version, which lists the folders of every table. A commit file is written under another name and renamed, and a version that is there is never
replaced, so readers see the old tables or the new ones, and of two writers from one version the later fails. A write that dies half-way leaves the
last version as it was. A table may have several folders: a version can add to a table without writing the rest of it again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, at: str) -> list[int]:
    fs, path = _files(spark, f"{at}/commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []


@dataclass
class Snapshot:
    """A version that was opened: its tables stay what they are whatever is committed later."""

    spark: SparkSession
    at: str
    version: int
    folders: dict[str, list[str]]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.at}/{f}" for f in self.folders[name]])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self.folders}


def latest(spark: SparkSession, at: str, version: int | None = None) -> Snapshot | None:
    """The last version (or the given one); none if nothing was committed."""
    there = versions(spark, at)
    if not there:
        return None
    number = there[-1] if version is None else version
    text = "\n".join(r["value"] for r in spark.read.text(f"{at}/commits/{number:012d}").collect())  # one line
    return Snapshot(spark, at, number, json.loads(text))


def written(df: DataFrame, at: str, name: str) -> str:
    """df below data, to be committed later; the folder's name."""
    folder = f"data/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{at}/{folder}")
    return folder


def commit(spark: SparkSession, at: str, folders: dict[str, list[str]], after: int) -> int:
    """Make these the tables of the version after the given one (0: none yet)."""
    fs, final = _files(spark, f"{at}/commits/{after + 1:012d}")
    draft = final.suffix(f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {after + 1} of {at} is there already")
    return after + 1


def replace(tables: dict[str, DataFrame], at: str) -> int:
    """All tables of the folder become these, or nothing changes."""
    spark = next(iter(tables.values())).sparkSession
    before = latest(spark, at)
    folders = {name: [written(df, at, name)] for name, df in tables.items()}
    return commit(spark, at, folders, before.version if before else 0)


def expire(spark: SparkSession, at: str, keep: int = 2) -> int:
    """Delete what only versions before the last so many read; how many folders went. Folders that were never committed stay: a writer may still be at work."""
    there = versions(spark, at)
    old, live = there[:-keep], {f for v in there[-keep:] for own in latest(spark, at, v).folders.values() for f in own}
    gone = {f for v in old for own in latest(spark, at, v).folders.values() for f in own} - live
    for path in [*(f"{at}/commits/{v:012d}" for v in old), *(f"{at}/{f}" for f in gone)]:
        fs, p = _files(spark, path)
        fs.delete(p, True)
    return len(gone)
