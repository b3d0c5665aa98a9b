"""Bring an index up to date with what changed in its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import index
from tidewell.session import settled
from tidewell.sources import snapshots

#: Seconds by which a file must be newer to count as modified.
SLACK = 0.1


def changes(stored: DataFrame, found: DataFrame, slack: float = SLACK) -> DataFrame:
    """path, status (added, deleted, modified, same). Both: path, mtime."""
    both = stored.select("path", F.col("mtime").alias("old")).join(found.select("path", F.col("mtime").alias("new")), "path", "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("new") > F.col("old") + slack, "modified").otherwise("same")
    return both.select("path", status.alias("status"))


def is_fresh(stored: DataFrame, found: DataFrame) -> bool:
    return changes(stored, found).where("status != 'same'").isEmpty()


def forced(stored: DataFrame, names: list[str]) -> DataFrame:
    """stored with the mtime of the named files (path, file name or stem) set to zero, so that they count as modified."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    hit = F.col("path").isin(*names) | name.isin(*names) | F.regexp_replace(name, r"\.[^.]*$", "").isin(*names)
    return stored.withColumn("mtime", F.when(hit, 0.0).otherwise(F.col("mtime")))


def updated(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """chunks without those of deleted and modified files, and the fresh chunks of added and modified ones. All by path."""
    gone = changed.where("status IN ('deleted', 'modified')").select("path")
    new = changed.where("status IN ('added', 'modified')").select("path")
    return chunks.join(gone, "path", "left_anti").unionByName(fresh.join(new, "path", "left_semi"))


def tokenised(docs: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """Chunks and postings of documents (path, text)."""
    own = index.chunked(docs.select(F.col("path").alias("doc_id"), F.lit("").alias("source"), "text"))
    own = settled(own)
    terms = index.vectors(own).select(F.col("doc_id").alias("path"), F.lit(generation).alias("generation"), "chunk_order", "term", "n", F.round(F.col("n") / F.col("tf")).cast("long").alias("total"))
    return own.select(F.col("doc_id").alias("path"), F.lit(generation).alias("generation"), "chunk_order", "text"), terms


def live(snapshot: snapshots.Snapshot, name: str) -> DataFrame:
    """Rows of chunks or postings that are of a file's last version."""
    return snapshot.table(name).join(snapshot.table("files").select("path", "generation"), ["path", "generation"], "left_semi")


def write_back(spark: SparkSession, at: str, listing: DataFrame, docs: DataFrame, slack: float = SLACK) -> bool:
    """Bring the index at a folder up to date with a listing (path, mtime); whether anything changed. docs: path, text of the files, of which only changed ones are read on.

    New chunks and postings are added as folders of their own; nothing that stays is written or tokenised again. Document frequencies change by what went
    and what came. All is committed as one version: a file's last generation says which of its rows count.
    """
    before = snapshots.latest(spark, at)
    stored = before.table("files") if before else spark.createDataFrame([], "path string, mtime double, generation int")
    changed = settled(changes(stored, listing, slack).where("status != 'same'"))
    if changed.isEmpty():
        return False
    version = before.version if before else 0
    generation = version + 1
    new, gone = changed.where("status IN ('added', 'modified')").select("path"), changed.where("status IN ('deleted', 'modified')").select("path")
    chunks, postings = tokenised(docs.join(new, "path", "left_semi"), generation)
    folders = {name: list(own) for name, own in before.folders.items()} if before else {}
    for name, df in (("chunks", chunks), ("postings", postings)):
        folders.setdefault(name, []).append(snapshots.written(df, at, name))
    came = spark.read.parquet(f"{at}/{folders['postings'][-1]}").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counts = came
    chunk_counts = spark.read.parquet(f"{at}/{folders['chunks'][-1]}").agg(F.count(F.lit(1)).alias("chunks"))
    if before:
        went = live(before, "postings").join(gone, "path", "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        counts = before.table("df").union(came).union(went).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        lost = live(before, "chunks").join(gone, "path", "left_semi").agg((-F.count(F.lit(1))).alias("chunks"))
        chunk_counts = before.table("meta").union(chunk_counts).union(lost).agg(F.sum("chunks").alias("chunks"))
    files = stored.join(changed.select("path"), "path", "left_anti").unionByName(listing.join(new, "path", "left_semi").select("path", "mtime").withColumn("generation", F.lit(generation)))
    for name, df in (("files", files), ("df", counts), ("meta", chunk_counts)):
        folders[name] = [snapshots.written(df, at, name)]
    snapshots.commit(spark, at, folders, version)
    return True


def weights(snapshot: snapshots.Snapshot) -> DataFrame:
    """path, chunk_order, term, tf and idf of the index."""
    total = snapshot.table("meta")  # one row
    idf = snapshot.table("df").crossJoin(F.broadcast(total)).select("term", F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return live(snapshot, "postings").join(idf, "term").select("path", "chunk_order", "term", (F.col("n") / F.col("total")).alias("tf"), "idf")
