"""Answer batches of questions from a collection: one retrieval, or rounds in which the model asks for more.

The model is a callable from a list of prompts to a list of answers; it is called on Arrow batches in the tasks and must be picklable.
A batch of questions goes through each step as one plan, keyed by qid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import rewrite, security
from tidewell.functions.segment import Segmenter
from tidewell.operators import entities, index, search, store
from tidewell.operators.dense import cosines
from tidewell.operators.dense import encoded as vectors_of
from tidewell.session import settled

Model = Callable[[list[str]], list[str]]
FALLBACK = "No definite answer follows from the documents found. Please ask in another way."


def asked(model: Model, prompt: Column) -> Column:
    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model(s.tolist()))

    return call(prompt)


def prepared(questions: DataFrame, glossary: Column | None = None) -> DataFrame:
    """qid, question (safe), query (rewritten), blocked, redacted."""
    safe = questions.select("qid", security.neutralized(F.col("question")).alias("n")).select("qid", "n.blocked", security.redacted(F.col("n.text")).alias("r"))
    query = F.col("r.text") if glossary is None else rewrite.glossed(F.col("r.text"), glossary)
    return safe.select("qid", F.col("r.text").alias("question"), rewrite.counted(query).alias("query"), "blocked", F.col("r.count").alias("redacted"))


@dataclass
class Dense:
    """The dense side of retrieval: vectors of the chunks (doc_id, chunk_order, embedding), the model that encodes a query, and its weight (1: dense alone)."""

    vectors: DataFrame
    encode: Callable[[list[str]], list[list[float]]]
    weight: float = 0.5


def followed(questions: DataFrame, messages: DataFrame, model: Model, n: int = 10) -> DataFrame:
    """questions (qid, conversation_id, question) with query: a follow-up question rewritten by the model so that it stands for itself.

    The model sees the conversation's last messages. Without any, or if the model fails or answers nothing, the query is the question.
    """
    told = questions.join(store.transcripts(messages, n), "conversation_id", "left")
    prompt = F.concat(F.lit("Rewrite the last question as a search query that needs no context.\n\n"), F.col("transcript"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nQuery:"))

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out, there = pd.Series([None] * len(s), dtype=object), s.notna().to_numpy()
            if there.any():
                try:
                    out[there] = model(s[there].tolist())
                except Exception:  # noqa: BLE001  whatever a model raises, the questions stay as they are
                    out[:] = None
            yield out

    reply = F.regexp_replace(call(prompt), r"""^[\s"']+|[\s"']+$""", "")
    own = told.select(*questions.columns, reply.alias("_reply"))
    return own.select(*questions.columns, F.when(F.coalesce(F.col("_reply"), F.lit("")) == "", F.col("question")).otherwise(F.col("_reply")).alias("query"))


def retrieved(questions: DataFrame, chunks: DataFrame, k: int, per_source: int, names: DataFrame | None = None, segmenter: Segmenter | None = None, dense: Dense | None = None) -> DataFrame:
    """The diversified best chunks of each question: qid, doc_id, chunk_order, source, text, score, rank. names: the sources that a question is restricted to.

    With a dense side both scores are scaled by their largest over all chunks and mixed before anything is filtered; a question that the model gives no vector is found by terms alone.
    """
    return search.texts(ranked(questions, chunks, k, per_source, names, segmenter, dense), chunks)


def ranked(questions: DataFrame, chunks: DataFrame, k: int, per_source: int, names: DataFrame | None = None, segmenter: Segmenter | None = None, dense: Dense | None = None) -> DataFrame:
    """`retrieved` without the texts. Without a dense side only rows that can be among a question's best leave a task."""
    columns = ["qid", *index.ID, "source", "score", "rank"]
    if dense is None:
        return search.diverse(questions, chunks, k, per_source, names, segmenter).select(*columns)
    scored = search.scores(questions, chunks, segmenter)
    vectors = vectors_of(questions.select("qid", F.col("question").alias("text")), dense.encode).select("qid", "embedding")
    close = cosines(vectors, dense.vectors.select(F.struct(*index.ID).alias("vec_id"), "embedding")).select("qid", "vec_id.*", "score")
    scored = search.fused(scored, close, dense.weight, index.ID).where("score > 0")
    if names is not None:
        scored = search.of_names(settled(scored), chunks, names)
    placed = scored.join(chunks.select(*index.ID, "source", F.xxhash64("text").alias("same")), index.ID)
    return search.diversified(placed, k, per_source, same="same").select(*columns)


def understood(questions: DataFrame, glossary: Column | None, names: DataFrame | None, reference: str | None) -> tuple[DataFrame, DataFrame | None]:
    """qid, question, shown (with its note), query, blocked, redacted; and the sources that questions are restricted to."""
    own = settled(prepared(questions, glossary))
    if names is None:
        return own.withColumn("shown", F.col("question")), None
    known, filters = entities.resolved(own, names, reference)
    shown = entities.noted(F.col("question"), F.col("note")).alias("shown")
    return own.select("qid", "blocked", "redacted").join(known.select("qid", "question", "query", shown), "qid"), filters


def answered(questions: DataFrame, chunks: DataFrame, model: Model, glossary: Column | None = None, k: int = 14, per_source: int = 2, names: DataFrame | None = None, reference: str | None = None, segmenter: Segmenter | None = None, dense: Dense | None = None) -> DataFrame:
    """qid, answer, hit_files, blocked, redacted. names, reference: as `entities.resolved`, names being sources."""
    own, filters = understood(questions, glossary, names, reference)
    found = settled(retrieved(own.select("qid", F.col("query").alias("question")), chunks, k, per_source, filters, segmenter, dense))
    both = own.join(search.context(found), "qid", "left").join(search.hit_sources(found), "qid", "left")
    prompt = search.prompt(F.coalesce("context", F.lit("")), F.col("shown"))
    return both.select("qid", rewrite.without_directives(asked(model, prompt), FALLBACK).alias("answer"), F.coalesce("hit_files", F.lit("")).alias("hit_files"), "blocked", "redacted")


def accumulated(before: DataFrame | None, new: DataFrame) -> DataFrame:
    """Chunks by (qid, text), the score of the round that found them first, ranked anew."""
    each = new if before is None else before.unionByName(new)
    first = each.groupBy("qid", F.xxhash64("text").alias("same")).agg(F.min_by(F.struct("round", *index.ID, "source", "score", "text"), F.struct("round", *index.ID)).alias("c")).select("qid", "c.*")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "round", *index.ID)))


def in_rounds(questions: DataFrame, chunks: DataFrame, model: Model, rounds: int = 4, k: int = 14, per_source: int = 2, most: int = 200, glossary: Column | None = None, names: DataFrame | None = None, reference: str | None = None, segmenter: Segmenter | None = None, dense: Dense | None = None) -> DataFrame:
    """qid, answer, rounds. In each round the model answers, or asks to SEARCH for something else, or to EXHAUST all that matches.

    After EXHAUST with something new, or the last round, it must answer from the chunks gathered (most at most). The loop runs over rounds, never over rows.
    Only the first round is restricted to the sources that a question names; later ones compare with all.
    """
    own, filters = understood(questions, glossary, names, reference)
    open_ = settled(own.select("qid", F.col("shown").alias("question"), "query"))
    gathered, done = None, None
    for number in range(1, rounds + 1):
        found = retrieved(open_.select("qid", F.col("query").alias("question")), chunks, k, per_source, filters if number == 1 else None, segmenter, dense).drop("rank").withColumn("round", F.lit(number))
        gathered = settled(accumulated(gathered.drop("rank") if gathered is not None else None, found))
        context = search.context(gathered.where(F.col("rank") <= 2 * k))
        reply = open_.join(context, "qid", "left").withColumn("reply", asked(model, search.prompt(F.coalesce("context", F.lit("")), F.col("question"))))
        reply = settled(reply.select("qid", "question", "query", "reply", rewrite.directive(F.col("reply")).alias("d")))
        all_ = reply.where("d.kind = 'EXHAUST'").select("qid", F.col("d.query").alias("question"))
        hits = search.exhaustive(search.scores(all_, chunks, segmenter), most).join(chunks.select(*index.ID, "source"), index.ID)
        more = search.expanded(hits, chunks).drop("hit").join(chunks.select(*index.ID, "text"), index.ID).withColumn("round", F.lit(number))
        new = more.join(gathered.select("qid", *index.ID), ["qid", *index.ID], "left_anti").select("qid").distinct().withColumn("more", F.lit(True))
        gathered = settled(accumulated(gathered.drop("rank"), more))
        again = (F.col("d.kind") == "SEARCH") & (F.col("d.query") != F.col("query")) & F.lit(number < rounds)
        state = reply.join(new, "qid", "left").withColumn("state", F.when(F.col("d.kind").isNull(), "answered").when(again, "open").otherwise("forced"))
        state = settled(state)
        forced = state.where("state = 'forced'").join(search.context(gathered.where(F.col("rank") <= most)), "qid", "left")
        forced = forced.select("qid", rewrite.without_directives(asked(model, F.concat(search.prompt(F.coalesce("context", F.lit("")), F.col("question")), F.lit("\nAnswer now."))), FALLBACK).alias("answer"))
        final = state.where("state = 'answered'").select("qid", F.col("reply").alias("answer")).unionByName(forced).withColumn("rounds", F.lit(number))
        done = final if done is None else done.unionByName(final)
        open_ = state.where("state = 'open'").select("qid", "question", F.col("d.query").alias("query"))
        if open_.isEmpty():
            break
    return done
