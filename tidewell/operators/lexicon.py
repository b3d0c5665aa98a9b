"""A big lexicon in texts: which terms a text contains, and the replacement of aliases by names.

A lexicon is an automaton that reads a text once however many terms there are. It is broadcast in blocks of at most about ``CHARACTERS``
characters, counted before; each block is one pass over the texts, which stay where they are. So neither a product of texts and terms nor a
join by containment is ever planned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.automata import Terms
from tidewell.session import settled

#: An automaton has a node for each character at most, of about 60 bytes.
CHARACTERS = 4 << 20


def blocks(rows: DataFrame, term: str, order: str | None, limit: int) -> Iterator[list]:
    """The rows in blocks whose terms have at most about limit characters: by hash, or in ascending order (rows of equal order together)."""
    size = rows.agg(F.sum(F.length(term))).first()[0] or 0
    n = max(1, -(-size // limit))
    if n == 1:
        yield rows.collect()
        return
    if order is None:
        block = F.pmod(F.xxhash64(term), F.lit(n))
    else:
        rows = rows.repartitionByRange(n, order)
        block = F.spark_partition_id()
    own = settled(rows.withColumn("block", block))
    for i in range(n):
        yield own.where(F.col("block") == i).drop("block").collect()


def held(texts: DataFrame, terms: DataFrame, limit: int = CHARACTERS) -> DataFrame:
    """qid, term: the terms (exact spelling) that each text contains. texts: qid, text. terms: term; empty ones and repeats are passed over."""
    spark = texts.sparkSession
    schema = T.StructType([T.StructField("qid", texts.schema["qid"].dataType), T.StructField("term", T.StringType())])
    out = spark.createDataFrame([], schema)
    for rows in blocks(terms.where("term != ''").select("term").distinct(), "term", None, limit):
        own = Terms(spark, [r["term"] for r in rows])

        def found(batches, own=own):
            for batch in batches:
                row, terms = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for k in own.held(text):
                        row.append(i)
                        terms.append(own.shared.value[k])
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(row, pa.int64())), pa.array(terms, pa.string())], ["qid", "term"])

        out = out.union(texts.select("qid", "text").mapInArrow(found, schema))
    return out


class Renaming:
    """Aliases and names in the order in which they are tried."""

    def __init__(self, spark, rows: list[tuple[str, str]]):
        nicks = sorted({nick for nick, _ in rows})
        self.terms, at = Terms(spark, nicks), {nick: [] for nick in nicks}
        for i, (nick, _) in enumerate(rows):
            at[nick].append(i)
        self.shared = spark.sparkContext.broadcast((rows, [at[nick] for nick in nicks]))

    def apply(self, text: str | None) -> str | None:
        """Each entry in turn replaces its alias's first occurrence, unless the name is there. Only entries whose alias is there are looked at."""
        rows, at = self.shared.value
        last = -1
        while text:
            entries = (i for k in self.terms.held(text) for i in at[k] if i > last and rows[i][1] not in text)
            last = min(entries, default=-1)
            if last < 0:
                break
            nick, canonical = rows[last]
            text = text.replace(nick, canonical, 1)
        return text


def renamed(texts: DataFrame, names: DataFrame, limit: int = CHARACTERS) -> DataFrame:
    """texts (qid, text) with aliases replaced. names: ord, at, canonical, nick.

    In order of ord, longer aliases first, then by at: the first occurrence of an alias becomes the name unless that is there already; later
    entries see the outcome. Blocks are ranges of ord, so one after the other they do as the whole lexicon would.
    """
    spark, kind = texts.sparkSession, texts.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", kind), T.StructField("text", T.StringType())])
    own = names.where("nick != '' AND canonical != '' AND nick != canonical").select("ord", "at", "canonical", "nick")
    out = texts.select("qid", "text")
    for rows in blocks(own, "nick", "ord", limit):
        rows.sort(key=lambda r: (r["ord"], -len(r["nick"]), r["at"], r["nick"]))
        entries = Renaming(spark, [(r["nick"], r["canonical"]) for r in rows])

        def applied(batches, entries=entries):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array([entries.apply(t) for t in batch.column("text").to_pylist()], pa.string())], ["qid", "text"])

        out = out.mapInArrow(applied, schema)
    return out
