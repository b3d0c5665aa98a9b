"""Diversified search whose scores stay in their tasks: the same rows as from all scores, and few of them shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.jobs import queries as q
from tidewell.operators import index, search

SF = "/root/testdata/sf0.001"


def collection(spark, seed, n=160):
    """Chunks of few words in few sources: many ties, many copies within a source and across sources."""
    r = random.Random(seed)
    rows = [(i, r.randrange(2), f"s{r.randrange(7)}", " ".join(r.choices("ab cd ef gh".split(), k=r.randrange(1, 4)))) for i in range(n)]
    questions = [(0, "ab"), (1, "cd cd ef"), (2, "zz"), (3, ""), (4, "gh ab"), (5, "ef")]
    names = [(1, "s1"), (1, "s4"), (2, "s2"), (3, "s0"), (3, "s6"), (4, "s5"), (5, "none")]
    return spark.createDataFrame(rows, "doc_id long, chunk_order int, source string, text string"), spark.createDataFrame(questions, "qid long, question string"), spark.createDataFrame(names, "qid long, name string")


@pytest.mark.parametrize("seed, k, per_source, filtered", [(1, 3, 2, False), (2, 14, 2, True), (3, 9, 1, True), (4, 9, 3, False), (5, 1, 2, True), (6, 20, 4, True)])
def test_same_as_from_all_scores(spark, monkeypatch, seed, k, per_source, filtered):
    monkeypatch.setattr(search, "SLICE", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chunks, questions, names = collection(spark, seed)
        scored = search.scores(questions, chunks).where("score > 0")
        scored = search.of_names(scored, chunks, names) if filtered else scored
        placed = scored.join(chunks, index.ID)
        wanted = search.diversified(placed, k, per_source).select("qid", *index.ID, "source", "score", "round", "rank")
        found = search.diverse(questions, chunks, k, per_source, names if filtered else None).select(wanted.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
        assert wanted.where("qid = 3").isEmpty() != filtered  # a question without words gets the chunks of its sources
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_scores_leave_a_task(spark):
    chunks, questions, names = collection(spark, 7, 4000)
    chunks = chunks.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")))
    block, _ = next(search.asked(questions, None))
    left = search.candidates(spark, block, chunks, questions.schema["qid"].dataType, 5, 2, names, None)
    assert left.count() <= 5 * len(block) * left.rdd.getNumPartitions()


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Join")


def test_retrieval_joins_no_scores(spark):
    """Before, every score of a question with every chunk of its sources met the chunks and the filters in joins that shuffled them all."""
    assert joins(q.QUERIES["question_retrieval"](spark, SF)) == 0


def test_context_shuffles_no_chunks(spark):
    """Texts come by one join, to which the best rows are broadcast."""
    plan = q.QUERIES["context_assembly"](spark, SF)
    assert joins(plan) == 1 and "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_diversified_joins_no_scores(spark):
    assert joins(q.QUERIES["diversified_topk"](spark, SF)) == 0


def test_hit_files_joins_no_scores(spark):
    assert joins(q.QUERIES["hit_files"](spark, SF)) == 0
