"""Column expressions that prepare text: trimming, titles, aliases, chunks and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, OVERLAP, LEAST = 500, 100, 20
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}"
# What marks a passage of figures.
STAT_HEADERS = ("主武器性能数据", "主武器基础数据")
STAT_KEYWORDS = ("确定数", "射程", "伤害", "DPS", "/100", "攻击力", "耐久度", "机动性", "蓄力速度", "涂地射程", "有效射程", "确定数维持射程")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def title(text: Column, stem: Column) -> Column:
    """The first heading of level one without the details suffix; the file's stem if there is none."""
    found = strip(F.regexp_extract(text, r"(?m)^#\s+(.+)", 1))
    cut = F.when(F.contains(found, F.lit(" - ")), F.regexp_replace(found, r"\s*[-—–]\s*(?:完整)?武器详情.*$", "")).otherwise(found)
    return F.when(cut == "", stem).otherwise(cut)


def aliases(text: Column) -> Column:
    """Nicknames of a document: the alias line, or else its names in Chinese, Japanese and Korean."""
    line = strip(F.regexp_extract(text, r"俗称[：:][ \t]*(.+)", 1))
    split = F.filter(F.transform(F.split(line, "[、，,]"), strip), lambda x: x != "")
    section = F.regexp_extract(text, r"(?s)## Names in Other Languages\s*\n+(.*?)(?=\n## |\z)", 1)
    raw = F.regexp_extract_all(section, F.lit(r"(?i)-\s*\*\*(?:Chinese|Japanese|Korean)\b[^:\n]*\*\*\s*:\s*(.+?)(?:\n|\z)"), F.lit(1))
    foreign = F.transform(raw, lambda x: F.concat(F.lit(" "), F.regexp_replace(strip(x), r"\s+", " ")))
    named = F.transform(foreign, lambda x: strip(F.regexp_replace(x, r" (?:[A-Za-z]|\().*$", "")))
    return F.when(line.isin("", "—", "-", "无"), F.filter(named, lambda x: F.length(x) >= 2)).otherwise(split)


def windows(paragraph: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Every size characters, size - overlap apart."""
    at = F.sequence(F.lit(1), F.greatest(F.length(paragraph), F.lit(1)), F.lit(size - overlap))
    return F.transform(at, lambda i: F.substring(paragraph, i, F.lit(size)))


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Paragraphs put together up to size; one that does not fit is cut into windows. Chunks of no more than least characters go."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    paragraphs = F.filter(F.transform(F.split(strip(text), r"\n\n+"), strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def add(state: Column, p: Column) -> Column:
        opened, done = state["open"], state["done"]
        flushed = F.when(opened != "", F.concat(done, F.array(opened))).otherwise(done)
        fits = F.length(opened) + F.length(p) <= size
        return F.struct(
            F.when(fits, strip(F.concat(opened, F.lit("\n\n"), p))).otherwise(F.lit("")).alias("open"),
            F.when(fits, done).otherwise(F.concat(flushed, windows(p, size, overlap))).alias("done"),
        )

    folded = F.aggregate(paragraphs, start, add, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return F.filter(folded, lambda c: F.length(c) > least)


def tokens(text: Column, segmenter: Callable[[Column], Column] | None = None) -> Column:
    """Words of letters, digits and underscores in lower case; of each CJK span all bigrams and all characters. Repeats count.

    Words of a CJK span need a dictionary: a segmenter of `tidewell.functions.segment` adds them.
    """
    plain = F.regexp_extract_all(F.regexp_replace(F.lower(text), f"[{CJK}]+", " "), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    spans = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))

    def grams(n: int) -> Column:
        none = F.array().cast("array<string>")
        each = lambda s: F.when(F.length(s) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n))))
        return F.flatten(F.transform(spans, each))

    own = F.when(F.size(spans) == 0, plain).otherwise(F.concat(plain, grams(2), grams(1)))
    return own if segmenter is None else F.concat(own, segmenter(text))


def is_stat(chunk: Column, headers=STAT_HEADERS, keywords=STAT_KEYWORDS, least: int = 3) -> Column:
    """A passage of figures: it has a header, or at least so many of the keywords."""
    header = F.lit(False)
    for h in headers:
        header = header | F.contains(chunk, F.lit(h))
    return header | (sum((F.contains(chunk, F.lit(k)).cast("int") for k in keywords), F.lit(0)) >= least)


def prefixed(name: Column, chunk: Column) -> Column:
    return F.concat(F.lit("["), name, F.lit("]\n"), chunk)


def snippet(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def file_name(name: Column, full_width: bool = False) -> Column:
    """A name that file systems take: forbidden characters become their full-width forms, or go."""
    return F.translate(name, '\\/:*?"<>|', "＼／：＊？＂＜＞｜" if full_width else "")
