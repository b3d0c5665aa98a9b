"""Deterministic rewrites of questions: glossary, counted-shots slang, nicknames; and directives in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals of the slang and what they stand for.
NUMERALS = {"一": "1", "二": "2", "两": "2", "三": "3", "四": "4", "五": "5"}
SLANG = "(一|二|两|三|四|五|几)确"
#: Dollars for a million tokens, in and out.
PRICES = (0.14, 0.28)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, new, at, F.length(old))).otherwise(text)


def glossed(text: Column, glossary: Column) -> Column:
    """Every entry of glossary (array of structs ord, slang, formal), in order, replaces all its occurrences; later entries see the outcome."""
    return F.aggregate(F.array_sort(F.filter(glossary, lambda g: g["slang"] != "")), text, lambda t, g: F.replace(t, g["slang"], g["formal"]))


def counted(text: Column) -> Column:
    """The first numeral with its suffix becomes a searchable term."""
    word = F.regexp_extract(text, SLANG, 1)
    number = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in NUMERALS.items()])
    term = F.when(word == "几", F.lit("最低确定数是多少")).otherwise(F.concat(F.lit("最低确定数为"), number))
    return F.when(word == "", text).otherwise(replace_first(text, F.concat(word, F.lit("确")), term))


def renamed(text: Column, names: Column) -> Column:
    """names: array of structs (ord, canonical, nick), one for each file and nickname.

    In file order, longer nicknames first, the first occurrence of a nickname becomes the canonical name unless that is there already.
    """
    ordered = F.array_sort(F.transform(names, lambda n: F.struct(n["ord"], (-F.length(n["nick"])).alias("shorter"), n["canonical"], n["nick"])))
    return F.aggregate(ordered, text, lambda t, n: F.when((n["nick"] == n["canonical"]) | F.contains(t, n["canonical"]), t).otherwise(replace_first(t, n["nick"], n["canonical"])))


def directive(answer: Column) -> Column:
    """struct(kind, query): EXHAUST, or SEARCH anywhere, or an answer that begins with it in any case; nulls if it is an answer."""
    text = F.regexp_replace(answer, r"^\s+|\s+$", "")
    found = lambda p: F.nullif(F.regexp_replace(F.regexp_extract(text, p, 1), r"^\s+|\s+$", ""), F.lit(""))
    exhaust, search, prefix = found(r"EXHAUST:\s*(.+?)(?:\n|$)"), found(r"SEARCH:\s*(.+?)(?:\n|$)"), found(r"(?is)^SEARCH:(.*)$")
    kind = F.when(exhaust.isNotNull(), F.lit("EXHAUST")).when(F.coalesce(search, prefix).isNotNull(), F.lit("SEARCH"))
    return F.struct(kind.alias("kind"), F.coalesce(exhaust, search, prefix).alias("query"))


def without_directives(answer: Column, fallback: str) -> Column:
    left = F.regexp_replace(F.regexp_replace(answer, r"\n?(SEARCH|EXHAUST):\s*.*", ""), r"^\s+|\s+$", "")
    return F.when(left == "", F.lit(fallback)).otherwise(left)


def mode_label(mode: Column, dense: Column) -> Column:
    """What a log says about retrieval: mode is tfidf, dense or hybrid, dense the dense source (null: none)."""
    return F.when((mode == "tfidf") | ((mode != "dense") & dense.isNull()), F.lit("TF-IDF only")).when(mode == "dense", F.concat(F.lit("Dense only ("), F.coalesce(dense, F.lit("unknown")), F.lit(")"))).otherwise(F.concat(F.lit("TF-IDF + Dense/"), dense))


def cost(prompt: Column, completion: Column) -> Column:
    return prompt / 1e6 * PRICES[0] + completion / 1e6 * PRICES[1]
