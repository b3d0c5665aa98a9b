"""Reading and writing knowledge bases: Markdown folders, glossaries, alias tables, index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.sources import snapshots

INDEX = ("chunks", "vectors", "idf", "meta")


def read_markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """path, name, mtime, text, title and aliases of all Markdown files below the folders, or of single files."""
    if not paths or any("." in p.rsplit("/", 1)[-1] and not p.endswith(".md") for p in paths):
        raise ValueError("give folders or .md files")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(list(paths))
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    read = files.select("path", name.alias("name"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), text.alias("text"))
    return read.withColumn("title", X.title(F.col("text"), F.regexp_replace("name", r"\.md$", ""))).withColumn("aliases", X.aliases(F.col("text")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """nth, line of a single small file, in order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("nth", "line")).withColumn("line", X.strip(F.col("line")))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """ord, slang, formal: lines `slang | formal`; blank lines and comments are skipped, the last of equal slang holds."""
    return parse_glossary(lines(spark, path))


def parse_glossary(rows: DataFrame) -> DataFrame:
    parts = rows.where("line != '' AND NOT startswith(line, '#') AND contains(line, '|')").select("nth", F.split("line", r"\|", 2).alias("p"))
    each = parts.select("nth", X.strip(F.col("p")[0]).alias("slang"), X.strip(F.col("p")[1]).alias("formal")).where("slang != '' AND formal != ''")
    return each.groupBy("slang").agg(F.min("nth").alias("ord"), F.max_by("formal", "nth").alias("formal")).select("ord", "slang", "formal")


def glossary_lines(glossary: DataFrame) -> DataFrame:
    """The lines of a glossary file, in order."""
    return glossary.orderBy("ord").select(F.concat_ws(" | ", "slang", "formal").alias("value"))


def parse_aliases(rows: DataFrame) -> DataFrame:
    """official, ord, nick from the rows of a Markdown table `| official | nick / nick | origin |`."""
    cells = F.transform(F.split("line", r"\|"), X.strip)
    each = rows.where("line != '' AND NOT startswith(line, '#') AND NOT startswith(line, '|--')").select("nth", cells.alias("c")).where("size(c) >= 4")
    each = each.select("nth", F.col("c")[1].alias("official"), F.col("c")[2].alias("nicks")).where("official NOT IN ('', '官中译名') AND nicks != ''")
    each = each.select("nth", "official", F.posexplode(F.split("nicks", r"\s*/\s*")).alias("at", "nick")).where("nick != ''")
    return each.groupBy("official", "nick").agg(F.min(F.struct("nth", "at")).alias("first")).select("official", (F.col("first.nth") * 1000 + F.col("first.at")).alias("ord"), "nick")


def settings(rows: DataFrame) -> DataFrame:
    """key, value of KEY=VALUE lines; the first = splits, comments are skipped."""
    parts = rows.where("line != '' AND NOT startswith(line, '#') AND contains(line, '=')").select(F.split("line", "=", 2).alias("p"))
    return parts.select(X.strip(F.col("p")[0]).alias("key"), X.strip(F.col("p")[1]).alias("value"))


def write_index(tables: dict[str, DataFrame], to: str) -> None:
    """An index's tables below a folder, all replaced together: a write that fails leaves what was there."""
    snapshots.replace(tables, to)


def read_index(spark: SparkSession, at: str, names: tuple[str, ...] = INDEX) -> dict[str, DataFrame]:
    """The tables of the version that is the last one now; later writes do not change them."""
    own = snapshots.latest(spark, at)
    if own is None:
        raise FileNotFoundError(f"no index at {at}")
    return {name: own.table(name) for name in names}


def save_knowledge(at: str, files: DataFrame, chunks: DataFrame, nicknames: DataFrame, meta: DataFrame | None = None) -> None:
    """Replace what is known of a collection in one commit. files, chunks, nicknames: as the store's tables; meta: key, value, which adds to what is there."""
    spark = files.sparkSession
    before = snapshots.latest(spark, at)
    old = before.table("meta") if before and "meta" in before.folders else spark.createDataFrame([], "key string, value string")
    kept = old if meta is None else old.join(meta, "key", "left_anti").unionByName(meta.select("key", "value"))
    each = nicknames.groupBy("filename", "nickname").agg(F.min("ord").alias("ord"))
    snapshots.replace({"files": files, "chunks": chunks, "nicknames": each, "meta": kept}, at)


def load_knowledge(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """files; chunks with their place (chunk_order); nicknames as a list for each file, in order; meta."""
    own = snapshots.latest(spark, at)
    if own is None:
        raise FileNotFoundError(f"no knowledge at {at}")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "nickname"))), lambda n: n["nickname"])
    return {"files": own.table("files"), "chunks": own.table("chunks"), "nicknames": own.table("nicknames").groupBy("filename").agg(ordered.alias("nicknames")), "meta": own.table("meta")}


def has_knowledge(spark: SparkSession, at: str) -> bool:
    own = snapshots.latest(spark, at)
    return own is not None and not own.table("files").isEmpty()


def clear_knowledge(spark: SparkSession, at: str) -> None:
    """Nothing is known any more; readers of earlier versions keep theirs."""
    own = snapshots.latest(spark, at)
    if own is not None:
        snapshots.replace({name: df.limit(0) for name, df in own.tables().items()}, at)
