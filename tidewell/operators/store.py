"""The operational store's statements as transformations of its tables: append, upsert, history, listings, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def appended(table: DataFrame, rows: DataFrame, order: list[str], id_: str = "id") -> DataFrame:
    """table and rows with the next ids, in that order. Rows of one call are few; the table is not sorted."""
    last = table.agg(F.coalesce(F.max(id_), F.lit(0)).alias("last"))
    new = rows.withColumn("n", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(last)).withColumn(id_, F.col("n") + F.col("last"))
    return table.unionByName(new.drop("n", "last"), allowMissingColumns=True)


def upserted(table: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key in that order. The maximum is combined before it is shuffled, so a frequent key is no one task's work."""
    rest = [c for c in table.columns if c not in key]
    top = table.groupBy(*key).agg(F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_top"))
    return top.select(*key, "_top._row.*")


def rated(feedback: DataFrame) -> DataFrame:
    """Feedback whose rating is allowed."""
    return feedback.where("rating BETWEEN 1 AND 5")


def deleted(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti")


def history(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each conversation, oldest first by nth. messages: conversation_id, id, role, content."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    last = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return last.withColumn("nth", F.row_number().over(Window.partitionBy("conversation_id").orderBy("id"))).drop("back")


def transcripts(messages: DataFrame, n: int = 10, characters: int = 200) -> DataFrame:
    """conversation_id, transcript: what a model is shown of the history."""
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    lines = history(messages, n).withColumn("line", F.concat(speaker, F.left("content", F.lit(characters))))
    ordered = F.array_sort(F.collect_list(F.struct("nth", "line")))
    return lines.groupBy("conversation_id").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("transcript"))


def conversations(messages: DataFrame, characters: int = 40) -> DataFrame:
    """conversation_id, title (the start of the first message), msg_count, last_id."""
    return messages.groupBy("conversation_id").agg(F.left(F.min_by("content", "id"), F.lit(characters)).alias("title"), F.count(F.lit(1)).alias("msg_count"), F.max("id").alias("last_id"))


def with_messages(conversations_: DataFrame, messages: DataFrame, characters: int = 40) -> DataFrame:
    """The conversations table (id, title, created_at, updated_at) after messages were added: each touches its conversation, and the first names one without a title."""
    new = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("_last"), F.left(F.min_by("content", "id"), F.lit(characters)).alias("_first"))
    title = F.when(F.col("title") == "", F.coalesce("_first", "title")).otherwise(F.col("title"))
    return conversations_.join(new, "id", "left").select("id", title.alias("title"), "created_at", F.greatest("updated_at", "_last").alias("updated_at"))


def listed(conversations_: DataFrame, messages: DataFrame, n: int = 10) -> DataFrame:
    """The n conversations that were touched last, each with the number of its messages, which may be none."""
    counts = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("msg_count"))
    each = conversations_.orderBy(F.desc("updated_at"), F.desc("id")).limit(n).join(counts, "id", "left")
    return each.withColumn("msg_count", F.coalesce("msg_count", F.lit(0))).orderBy(F.desc("updated_at"), F.desc("id"))


def last_id(conversations_: DataFrame) -> DataFrame:
    """id of the conversation that was touched last, in one row (null if there is none)."""
    return conversations_.agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"))


def recent(table: DataFrame, n: int, *order) -> DataFrame:
    return table.orderBy(*order).limit(n)


def differences(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, status (added, removed, changed, same), old and new value."""
    o, n = old.select(key, F.col(value).alias("old"), F.lit(True).alias("_o")), new.select(key, F.col(value).alias("new"), F.lit(True).alias("_n"))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return o.join(n, key, "full").select(key, status.alias("status"), "old", "new")


def stats(logs: DataFrame) -> DataFrame:
    """One row of usage figures in one pass. logs: as the store's query_logs."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return logs.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.bround(F.coalesce(F.avg("latency_ms"), F.lit(0.0))).cast("long").alias("avg_latency_ms"),
        F.count_if(F.coalesce(F.col("error") != "", F.lit(False))).alias("error_count"),
        F.count_distinct(F.when(F.col("session_id") > 0, F.col("session_id"))).alias("session_count"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"),
    )
