"""Schemas of the operational store, and the additive migration that older tables need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE = {
    "query_logs": "id long, question string, answer string, mode string, hit_files string, rewrite string, latency_ms long, session_id long, prompt_tokens long, completion_tokens long, error string, created_at timestamp",
    "glossary": "ord int, slang string, formal string, created_at timestamp",
    "feedback": "query_id long, rating int, comment string, created_at timestamp",
    "knowledge_files": "filename string, filepath string, mtime double, title string",
    "knowledge_chunks": "id long, chunk_text string, source string, chunk_order long",
    "knowledge_nicknames": "filename string, nickname string, ord int",
    "knowledge_meta": "key string, value string",
    "conversations": "id long, title string, created_at timestamp, updated_at timestamp",
    "messages": "id long, conversation_id long, role string, content string, hit_files string, created_at timestamp",
}
#: What a column that an older table lacks is filled with; other columns get null.
DEFAULTS = {"session_id": 0, "prompt_tokens": 0, "completion_tokens": 0, "error": "", "hit_files": "", "title": ""}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(STORE[name])


def migrated(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of the store's table; missing ones are added."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema(name)])
