"""Neutralise prompt injection and redact personal data, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases, in the order in which they are tried.
INJECTIONS = (
    r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+instructions?",
    r"(?i)forget\s+(all\s+)?(previous|above|prior)\s+instructions?",
    r"(?i)you\s+are\s+now\s+(a\s+)?[\p{L}\p{N}_]+",
    r"(?i)system\s*[：:]\s*",
    r"<\|im_start\|>|<\|im_end\|>",
    r"\[system\]|\[/system\]",
    r"(?i)prompt\s*=\s*",
    r"忽略(上面|之前|所有|前面)的",
    r"忘记(上面|之前|所有|前面)的",
    r"你现在是",
    r"输出(你的|系统|原始)",
    r"系统\s*[：:]",
    r"扮演|角色扮演",
    r"(?i)作为\s*(一个|AI|语言模型)",
)
# Kinds of personal data and their forms, in the order in which they are redacted.
PERSONAL = (
    ("[EMAIL]", r"[A-Za-z0-9_./+-]+@[A-Za-z0-9_.-]+\.[a-z]{2,}"),
    ("[PHONE]", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("[ID]", r"(?<!\d)[1-6]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"),
    ("[IP]", r"(?<!\d)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d)"),
    ("[CARD]", r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"),
)


def neutralized(text: Column) -> Column:
    """struct(text, blocked): all matches of the first phrase that occurs become [FILTERED]; later phrases are left alone."""
    out = F.lit(None)
    for pattern in reversed(INJECTIONS):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_replace(text, pattern, "[FILTERED]")).otherwise(out)
    return F.struct(F.coalesce(out, text).alias("text"), out.isNotNull().alias("blocked"))


def redacted(text: Column) -> Column:
    """struct(text, count): each kind in turn on what the one before left."""
    count = F.lit(0)
    for mark, pattern in PERSONAL:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, mark)
    return F.struct(text.alias("text"), count.alias("count"))
