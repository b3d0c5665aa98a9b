"""Sparse, hybrid and exhaustive search of chunks for a batch of questions, and what is made of the hits.

Scores are rounded to six places before anything is ranked, so that ties do not depend on the order of summation;
ties go to the chunk that comes first. A filter on the rank follows every ranking directly, so Spark keeps k rows a group in each task before it
shuffles. What is read more than once (postings of a batch's terms, scores) is written first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as X
from tidewell.functions.segment import Segmenter, cut, slices
from tidewell.operators.index import ID
from tidewell.session import settled

#: Tokens of questions that go to every task at once, and rows of a side that may be broadcast.
BATCH_TERMS = 1_000_000
PLACES = 6


def query_vectors(questions: DataFrame, weights: DataFrame, segmenter: Segmenter | None = None) -> DataFrame:
    """qid, term, weight: tf over all tokens of the question, known terms only, times idf. segmenter: the index's."""
    tokens = questions.select("qid", X.tokens(F.col("question"), segmenter).alias("tokens"))
    each = tokens.select("qid", F.size("tokens").alias("total"), F.explode("tokens").alias("term")).groupBy("qid", "term", "total").agg(F.count(F.lit(1)).alias("n"))
    return each.join(weights.select("term", "idf"), "term").select("qid", "term", (F.col("n") / F.col("total") * F.col("idf")).alias("weight"), "idf")


def small(df: DataFrame, rows: int = BATCH_TERMS) -> DataFrame:
    """df, broadcast if it has no more rows. It is counted here: for what is read, not for what is long computed; adaptive execution sizes that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def met(chunks: DataFrame, terms: list[str], segmenter: Segmenter | None = None, once: bool = False) -> DataFrame:
    """Of every chunk: its ID, at (places in terms of those that it has) and tf. A chunk is tokenised once, its terms are counted in its task, nothing is shuffled.

    once: of equal texts of a source that an Arrow batch holds only the first chunk; adds its source, same (a hash of its text) and n, how many it stands for.
    """
    spark = chunks.sparkSession
    more = ["source", "same", "n"] if once else []
    known = spark.sparkContext.broadcast(terms)

    def counted(batches):
        names, kept = pa.array(known.value, pa.string()), {}
        for batch in batches:
            if once:
                batch = first_copies(batch)
            tokens = batch.column("tokens")
            total = tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            own = tokens.flatten().dictionary_encode()
            place = pc.fill_null(pc.index_in(own.dictionary, names), -1).to_numpy()[own.indices.to_numpy()].astype(np.int64)
            row = np.repeat(np.arange(len(total)), total)
            if segmenter is not None:
                at = 0
                for some in slices(batch.column("spans")):
                    own, words, sizes = cut(some, segmenter.terms, kept)
                    words = pc.fill_null(pc.index_in(own, names), -1).to_numpy()[words].astype(np.int64)
                    total[at : at + len(some)] += sizes
                    row, place = np.concatenate((row, np.repeat(np.arange(at, at + len(some)), sizes)[words >= 0])), np.concatenate((place, words[words >= 0]))
                    at += len(some)
            key, n = np.unique(row[place >= 0] * (len(names) + 1) + place[place >= 0], return_counts=True)
            row, place = np.divmod(key, len(names) + 1)
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(total))))), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(n / total[row], pa.float64()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, [*ID, *more]), *lists], [*ID, *more, "at", "tf"])

    text = [X.tokens(F.col("text")).alias("tokens"), *([segmenter.spans(F.col("text")).alias("spans")] if segmenter is not None else [])]
    own = chunks.select(*ID, *(["source", F.unhex(F.md5("text")).alias("same")] if once else []), *text)
    kinds = ", ".join([*(f"{c} {own.schema[c].dataType.simpleString()}" for c in [*ID, *more] if c != "n"), *(["n bigint"] if once else [])])
    return settled(own.mapInArrow(counted, f"{kinds}, at array<int>, tf array<double>"))


def changes(column: pa.Array) -> np.ndarray:
    """Which values differ from the one before; of no value it is the first."""
    column = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate(([True], column[1:] != column[:-1]))[: len(column)]


def first_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of the rows of equal source and same the one with the smallest ID, with n, how many there are."""
    batch = batch.take(pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in ["same", "source", *ID]], null_placement="at_start"))
    first = np.flatnonzero(changes(batch.column("same")) | changes(batch.column("source")))
    n = pa.array(np.diff(first, append=batch.num_rows))
    batch = batch.take(pa.array(first))
    return pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, "n"])


def scores(questions: DataFrame, chunks: DataFrame, segmenter: Segmenter | None = None, keep: int | None = None) -> DataFrame:
    """qid, doc_id, chunk_order, score of every chunk that shares a term with the question.

    Questions come in blocks of at most about BATCH_TERMS tokens. The terms of a block go to every task with their weights; a chunk's products with all
    questions are summed where the chunk lies, so only scores leave the task. keep: of each question a task keeps what can be among so many best.
    """
    return union(scored(questions.sparkSession, block, chunks, questions.schema["qid"].dataType, segmenter, keep) for block, _ in asked(questions, segmenter))


def asked(questions: DataFrame, segmenter: Segmenter | None) -> Iterator[tuple[list[tuple], Column]]:
    """The questions in blocks of at most about BATCH_TERMS tokens: pairs of a qid and its tokens, and a condition on qid that says which are in the block."""
    own = settled(questions.select("qid", X.tokens(F.col("question"), segmenter).alias("tokens")))
    size = own.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = max(1, -(-size // BATCH_TERMS))
    for block in range(blocks):
        inside = F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block
        some = own.where(inside).select("qid", "tokens").toArrow()
        yield list(zip(some["qid"].to_pylist(), some["tokens"].to_pylist(), strict=True)), inside


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Scores that a task sums at once.
CELLS = 4_000_000
#: Scores that a task sums at once where it then compares them with those that it holds.
SLICE = 500_000


@dataclass
class Weights:
    """What the terms of a block of questions weigh: those of term i are questions and weights at first[i] to first[i + 1]."""

    question: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    qids: pa.Array

    def products(self, at: pa.ListArray, tf: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending keys row * (number of questions) + question of those that share a term, and their scores."""
        many, rows = max(1, len(self.qids)), len(at)
        row = np.repeat(np.arange(rows), at.value_lengths().to_numpy())
        at, tf = at.flatten().to_numpy(), tf.flatten().to_numpy()
        n = self.first[at + 1] - self.first[at]
        which = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        key, value = np.repeat(row, n) * many + self.question[which], np.repeat(tf, n) * self.weight[which]
        if 8 * len(key) < rows * many:
            key, inverse = np.unique(key, return_inverse=True)
            return key, np.bincount(inverse, value, len(key))
        score, there = np.bincount(key, value, rows * many), np.bincount(key, minlength=rows * many)
        key = np.flatnonzero(there)
        return key, score[key]


def weighed(questions: list[tuple], terms: list[str], own: DataFrame) -> Weights:
    """own: `met` of the terms."""
    n = F.col("n") if "n" in own.columns else F.lit(1)
    total = own.agg(F.sum(n)).first()[0] or 0
    df = np.zeros(len(terms), np.int64)
    for r in own.select(n.alias("n"), F.explode("at").alias("at")).groupBy("at").agg(F.sum("n").alias("df")).collect():  # no more rows than the block has terms
        df[r["at"]] = r["df"]
    idf_ = np.log((total - df + 0.5) / (df + 0.5) + 1)
    place = {t: i for i, t in enumerate(terms)}
    each = [(place[t], q, n / len(tokens)) for q, (_, tokens) in enumerate(questions) for t, n in Counter(tokens or []).items() if df[place[t]]]
    each.sort()
    at, question, tf = (np.array([x[i] for x in each], kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
    weight = tf * idf_[at] * idf_[at]  # the chunk's weight and the question's both hold the idf
    return Weights(question, weight, np.searchsorted(at, np.arange(len(terms) + 1)), pa.array([q for q, _ in questions]))


def scored(spark, questions: list[tuple], chunks: DataFrame, kind, segmenter: Segmenter | None, keep: int | None) -> DataFrame:
    """`scores` of one block: pairs of a qid and its tokens."""
    questions = [(q, tokens) for q, tokens in questions if tokens]
    terms = sorted({t for _, tokens in questions for t in tokens})
    own = met(chunks, terms, segmenter)
    shared = spark.sparkContext.broadcast(weighed(questions, terms, own))
    schema = T.StructType([T.StructField("qid", kind), *[chunks.schema[c] for c in ID], T.StructField("score", T.DoubleType())])

    def summed(batches):
        own = shared.value
        many = max(1, len(own.qids))
        for whole in batches:
            for lo in range(0, whole.num_rows, max(1, CELLS // many)):
                batch = whole.slice(lo, max(1, CELLS // many))
                key, score = own.products(batch.column("at"), batch.column("tf"))
                row, q = np.divmod(key, many)
                if keep is not None and len(key):
                    order = np.lexsort((-score, q))
                    begin = np.searchsorted(q[order], np.arange(many + 1))
                    last = order[np.minimum(begin[:-1] + keep, np.maximum(begin[1:], 1)) - 1]  # the last that counts of each question
                    ok = score >= score[last][q] - 10.0**-PLACES  # ties after rounding stay
                    row, q, score = row[ok], q[ok], score[ok]
                columns = [own.qids.take(pa.array(q)), *(batch.column(c).take(pa.array(row)) for c in ID), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["qid", *ID, "score"])

    return own.mapInArrow(summed, schema).withColumn("score", F.round("score", PLACES))


def best(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each question with their rank."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *(ties or ID))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(scored: DataFrame, chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """As `best`, but a question with fewer than k hits is filled up with the first chunks at score zero."""
    first = best(scored.where("score > 0"), k).drop("rank")
    filler = chunks.select(*ID).orderBy(*ID).limit(2 * k)  # k of them are no hits of a question, or it has k hits
    zero = questions.select("qid").crossJoin(F.broadcast(filler)).join(first.select("qid", *ID), ["qid", *ID], "left_anti").withColumn("score", F.lit(0.0))
    return best(first.unionByName(zero), k)


def exhaustive(scored: DataFrame, most: int = 200, share: float = 0.1) -> DataFrame:
    """All positive hits of at least a share of the question's best score, up to most."""
    scored = settled(scored.where("score > 0"))
    top = scored.groupBy("qid").agg(F.max("score").alias("top"))
    return best(scored.join(top, "qid").where(F.col("score") >= share * F.col("top")), most).drop("top")


def of_sources(scored: DataFrame, chunks: DataFrame, sources: list[str] | None) -> DataFrame:
    """Hits from the named sources only; no names mean no filter."""
    if not sources:
        return scored
    return scored.join(chunks.where(F.col("source").isin(*sources)).select(*ID), ID, "left_semi")


def of_names(scored: DataFrame, chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Hits under a filter for each question. names: qid, name (a source). A question without names keeps its hits.

    A question with names gets all chunks of these sources, those without a common term at score zero, and nothing else; so it may get nothing.
    """
    filtered = names.select("qid").distinct()
    free = scored.join(filtered, "qid", "left_anti").select("qid", *ID, "score")
    own = chunks.select(*ID, "source").join(names.select("qid", F.col("name").alias("source")).distinct(), "source")
    bound = own.join(scored.select("qid", *ID, "score"), ["qid", *ID], "left").select("qid", *ID, F.coalesce("score", F.lit(0.0)).alias("score"))
    return free.unionByName(bound)


def fused(sparse: DataFrame, dense: DataFrame, weight: float, on: list[str]) -> DataFrame:
    """Both scores divided by their largest over all rows of the question, and mixed. Rows that one side lacks count zero there."""
    tops = lambda df: df.groupBy("qid").agg(F.max("score").alias("top"))
    scaled = lambda df, name: df.join(tops(df), "qid").select("qid", *on, F.when(F.col("top") == 0, 0.0).otherwise(F.col("score") / F.col("top")).alias(name))
    both = scaled(settled(sparse), "s").join(scaled(settled(dense), "d"), ["qid", *on], "full")
    mixed = F.coalesce("s", F.lit(0.0)) * (1 - weight) + F.coalesce("d", F.lit(0.0)) * weight
    return both.select("qid", *on, F.round(mixed, PLACES).alias("score"))


def diversified(scored: DataFrame, k: int, per_source: int = 2, ties: list[str] = ID, same: str = "text") -> DataFrame:
    """First the best of each source, then up to per_source of each, then the rest. Rows: qid, source, score, text (or a hash of it: same) and the ties.

    Rows of equal text and score are taken once. A result takes no more than k rows from a source, so only so many of each are ranked together.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rest = [c for c in scored.columns if c not in ("qid", same, "score", *ties)]
    first = scored.groupBy("qid", same, "score").agg(F.min(F.struct(*ties, F.struct(*rest).alias("_rest"))).alias("_first"))
    first = first.select("qid", *[f"_first.{t}" for t in ties], "score", same, "_first._rest.*").select(*scored.columns)
    return in_turn(first, k, per_source, ties)


def in_turn(rows: DataFrame, k: int, per_source: int, ties: list[str] = ID) -> DataFrame:
    """The k best of each question with round and rank: the best of each source, then up to per_source of each, then the rest."""
    own = Window.partitionBy("qid", "source").orderBy(F.desc("score"), *ties)
    each = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k)
    rounds = F.when(F.col("nth") == 1, 1).when(F.col("nth") <= per_source, 2).otherwise(3)
    w = Window.partitionBy("qid").orderBy("round", F.desc("score"), *ties)
    return each.withColumn("round", rounds).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("nth")


class Turns:
    """Rows that can be among each question's k best by `in_turn`, of all that a task has seen.

    A row whose rank among some of the rows is beyond k has no better one among all: of each source the n-th best of all is no worse than the n-th best of some.
    So k rows a question are held, and rows that cannot come before the last of them are not even sorted.
    """

    def __init__(self, k: int, per_source: int, many: int):
        self.k, self.per_source, self.rows = k, per_source, None
        self.last = np.full(many, 4), np.zeros(many, np.int64)  # round and units of each question's k-th row, if it has so many
        self.keys, self.units = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the rows: question and source, ascending, and the best first

    def can(self, q: np.ndarray, source: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Which rows can come before the k-th, or tie with it."""
        worst, least = self.last[0][q], self.last[1][q]
        ok = np.flatnonzero((worst > 1) | (units >= least))
        key, units, worst, least = (q[ok] << 32) | source[ok], units[ok], worst[ok], least[ok]
        at = np.searchsorted(self.keys, key)
        held = [np.append(self.units, -1)[np.where(np.append(self.keys, -1)[i] == key, i, -1)] for i in (at, np.minimum(at + self.per_source - 1, len(self.keys)))]
        turn = np.where(units >= held[0], 1, np.where(units >= held[1], 2, 3))
        return ok[(turn < worst) | ((turn == worst) & (units >= least))]

    def add(self, rows: pa.Table) -> None:
        """rows: q, code (of the source), units (of the rounded score), ID and whatever else."""
        rows = pa.concat_tables([self.rows, rows]) if self.rows is not None else rows
        ties = [(c, "ascending") for c in ID]
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("code", "ascending"), ("units", "descending"), *ties], null_placement="at_start"))
        new = np.flatnonzero(np.diff((rows["q"].to_numpy() << 32) | rows["code"].to_numpy(), prepend=-1))
        nth = np.arange(rows.num_rows) - np.repeat(new, np.diff(new, append=rows.num_rows)) + 1
        turn = np.where(nth == 1, 1, np.where(nth <= self.per_source, 2, 3))
        rows = rows.append_column("turn", pa.array(turn)).append_column("at", pa.array(np.arange(rows.num_rows)))
        rows = rows.filter(pa.array(nth <= self.k))
        order = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("turn", "ascending"), ("units", "descending"), *ties], null_placement="at_start"))
        q = order["q"].to_numpy()
        begin = np.searchsorted(q, np.arange(len(self.last[0]) + 1))
        order = order.append_column("rank", pa.array(np.arange(len(q)) - begin[q] + 1))
        full = np.flatnonzero(np.diff(begin) >= self.k)
        at = begin[full] + self.k - 1
        self.last[0][full], self.last[1][full] = order["turn"].to_numpy()[at], order["units"].to_numpy()[at]
        kept = order.filter(pc.less_equal(order["rank"], self.k))
        self.rows = kept.take(pc.sort_indices(kept["at"])).drop_columns(["turn", "at", "rank"]).combine_chunks()
        self.keys, self.units = (self.rows["q"].to_numpy() << 32) | self.rows["code"].to_numpy(), self.rows["units"].to_numpy()


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that are sorted by column, cut so that no group of equal values is divided, and where groups begin."""
    rest = None
    for batch in batches:
        batch = pa.concat_batches([rest, batch]) if rest is not None else batch
        heads = np.flatnonzero(changes(batch.column(column)))
        rest = batch.slice(heads[-1]) if len(heads) else None
        if len(heads) > 1:
            yield batch.slice(0, heads[-1]), heads[:-1]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def diverse(questions: DataFrame, chunks: DataFrame, k: int, per_source: int = 2, names: DataFrame | None = None, segmenter: Segmenter | None = None) -> DataFrame:
    """qid, doc_id, chunk_order, source, score, round, rank: `diversified` of the positive `scores`, under a filter for each question as `of_names` if names are given.

    Chunks of equal text have equal scores, so they meet in one task before anything is scored, and the first that a question may have stands for them.
    Of its questions a task then holds k rows each (`Turns`); no other score leaves it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, kind = questions.sparkSession, questions.schema["qid"].dataType
    return in_turn(union(candidates(spark, block, chunks, kind, k, per_source, names.where(inside) if names is not None else None, segmenter) for block, inside in asked(questions, segmenter)), k, per_source)


def candidates(spark, questions: list[tuple], chunks: DataFrame, kind, k: int, per_source: int, names: DataFrame | None, segmenter: Segmenter | None) -> DataFrame:
    """qid, doc_id, chunk_order, source, score of the rows of one block that tasks hold for `diverse`."""
    terms = sorted({t for _, tokens in questions for t in tokens or []})
    own = met(chunks, terms, segmenter, once=True)
    place = {q: i for i, (q, _) in enumerate(questions)}
    of_source: dict = {}
    for r in names.select("qid", "name").distinct().collect() if names is not None else []:  # of the block's questions
        if r["qid"] in place and r["name"] is not None:
            of_source.setdefault(r["name"], []).append(place[r["qid"]])
    bound = np.zeros(len(questions), bool)
    if names is not None:
        bound[[place[r["qid"]] for r in names.select("qid").distinct().collect() if r["qid"] in place]] = True
    shared = spark.sparkContext.broadcast((weighed(questions, terms, own), bound, {name: np.sort(np.array(q)) for name, q in of_source.items()}))
    columns = ["source", *ID]
    schema = T.StructType([T.StructField("qid", kind), *[chunks.schema[c] for c in columns], T.StructField("score", T.DoubleType()), T.StructField("bound", T.BooleanType())])
    unit = 10**PLACES

    def held(batches):
        own, bound, of_source = shared.value
        many = max(1, len(own.qids))
        turns, codes = Turns(k, per_source, many), {}

        def out(rows):
            q = rows["q"].to_numpy()
            values = [own.qids.take(pa.array(q)), *(rows[c] for c in columns), rows["score"], pa.array(bound[q])]
            return pa.table(values, ["qid", *columns, "score", "bound"]).combine_chunks().to_batches()

        for whole, heads in grouped(batches, "same"):
            for lo in range(0, len(heads), max(1, SLICE // many)):
                some = heads[lo : lo + max(1, SLICE // many) + 1]
                end = whole.num_rows if lo + max(1, SLICE // many) >= len(heads) else some[-1]
                some = some[: max(1, SLICE // many)]
                batch, some = whole.slice(some[0], end - some[0]), some - some[0]
                texts = batch.take(pa.array(some))
                key, score = own.products(texts.column("at"), texts.column("tf"))
                text, q = np.divmod(key, many)
                row = some[text]
                source = batch.column("source").dictionary_encode(null_encoding="encode")
                values = source.dictionary.to_pylist()
                if bound.any():  # of a text's chunks the first that the question may have, whatever its score
                    free = ~bound[q]
                    lists = [of_source.get(v, np.zeros(0, np.int64)) for v in values]
                    n, start = np.array([len(x) for x in lists]), np.cumsum([0, *map(len, lists)])
                    code = source.indices.to_numpy()
                    n, begin = n[code], start[code]
                    rows = np.repeat(np.arange(batch.num_rows), n)
                    asks = np.concatenate(lists)[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].astype(np.int64)
                    own_key, first = np.unique((np.searchsorted(some, rows, "right") - 1) * many + asks, return_index=True)
                    at = np.searchsorted(key, own_key)
                    met_ = np.append(key, -1)[at] == own_key
                    row, q = np.concatenate((row[free], rows[first])), np.concatenate((q[free], asks[first]))
                    score = np.concatenate((score[free], np.where(met_, np.append(score, 0.0)[at], 0.0)))
                units = score * unit + 0.5
                sure = np.abs(units - np.rint(units)) > 1e-6  # how Spark rounds the others only it can say
                units = np.floor(units).astype(np.int64)
                code = np.array([codes.setdefault(v, len(codes)) for v in values], np.int64)[source.indices.to_numpy()]

                def table(which, batch=batch, row=row, q=q, code=code, units=units, score=score):
                    own = batch.select(columns).take(pa.array(row[which]))
                    return pa.table([pa.array(x[which]) for x in (q, code[row], units, score)] + own.columns, ["q", "code", "units", "score", *columns])

                unsure = np.flatnonzero(~sure)
                if len(unsure):
                    yield from out(table(unsure))
                ok = np.flatnonzero(sure & ((units > 0) | bound[q]))
                ok = ok[turns.can(q[ok], code[row[ok]], units[ok])]
                if len(ok):
                    turns.add(table(ok))
        if turns.rows is not None:
            yield from out(turns.rows)

    found = own.drop("n").repartition("same").sortWithinPartitions("same", *ID).mapInArrow(held, schema)
    return found.withColumn("score", F.round("score", PLACES)).where("bound OR score > 0").drop("bound")


def texts(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked with the chunks' text. At most k rows a question: they go to the chunks, which are not shuffled, unless they are too many."""
    return chunks.select(*ID, "text").join(small(settled(ranked)), ID).select(*ranked.columns, "text")


def context(ranked: DataFrame) -> DataFrame:
    """qid, context: the hits' texts in rank order. At most k rows a question."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return ranked.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n---\n\n").alias("context"))


def prompt(documents: Column, question: Column) -> Column:
    return F.concat(F.lit("<documents>\n"), documents, F.lit("\n</documents>\n\n<user_query>\n"), question, F.lit("\n</user_query>"))


def hit_sources(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("hit_files"))


def expanded(hits: DataFrame, chunks: DataFrame, families: DataFrame | None = None, stat: Column | None = None) -> DataFrame:
    """The hits and all other chunks of their sources, at the source's best score.

    Of the sources of one family only the keeper (the shortest name, of equal ones the first) gives chunks that stat marks. families: source, family.
    """
    tops = hits.groupBy("qid", "source").agg(F.max("score").alias("score"))
    tops = tops.join(families, "source", "left").withColumn("family", F.coalesce("family", "source")) if families is not None else tops.withColumn("family", F.col("source"))
    keeper = tops.groupBy("qid", "family").agg(F.min(F.struct(F.length("source").alias("n"), F.col("source"))).alias("k")).select("qid", "family", F.col("k.source").alias("keeper"))
    rest = chunks.join(tops.join(keeper, ["qid", "family"]), "source")
    rest = rest.where(~(stat if stat is not None else X.is_stat(F.col("text"))) | (F.col("keeper") == F.col("source")))
    rest = rest.join(hits.select("qid", *ID), ["qid", *ID], "left_anti")
    columns = ["qid", *ID, "source", "score"]
    return hits.select(*columns).withColumn("hit", F.lit(True)).unionByName(rest.select(*columns).withColumn("hit", F.lit(False)))
