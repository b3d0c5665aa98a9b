"""A segmenter cuts each different span once, whatever the batches, and counts are those of the words."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidewell.functions import segment
from tidewell.functions.automata import Terms
from tidewell.jobs import queries as q
from tidewell.operators import search

NAMES = ["ab", "abc", "bca", "cab", "aa", "x"]


def texts(spark, n=60):
    r = random.Random(3)
    rows = [(i, 0, " ".join("".join(r.choices("abcx", k=r.randrange(1, 9))) for _ in range(r.randrange(0, 6)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, 0, None), (n + 1, 0, "7 8")], "doc_id long, chunk_order int, text string")


def words(spark, text):
    terms = Terms(spark, sorted(x for x in NAMES if len(x) > 1))
    return [w for s in (text or "").split() if s.isalpha() for w in segment.segment(s, terms)]


@pytest.mark.parametrize("most, kept", [(1, 0), (5, 3), (1 << 18, 1 << 16)])
def test_words_and_counts(spark, monkeypatch, most, kept):
    monkeypatch.setattr(segment, "SPANS", most)
    monkeypatch.setattr(segment, "KEPT", kept)
    own = texts(spark)
    columns = [segment.segmenter(spark, NAMES, "[a-z]+")(F.col("text")).alias("w"), segment.counter(spark, NAMES, "[a-z]+", 2)(F.col("text")).alias("c")]
    for r in own.coalesce(1).select("text", *columns).collect():
        wanted = words(spark, r["text"])
        assert r["w"] == wanted
        assert {x["word"]: x["n"] for x in r["c"]} == {w: n for w, n in Counter(wanted).items() if len(w) > 1}


def test_repeated_spans_are_cut_once(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(segment, "segment", lambda text, terms, plain=segment.segment: cuts.append(text) or plain(text, terms))
    spans, kept = pa.array([["abc", "abca"] * 50, [], ["abc"], ["abca", "x"]]), {}
    for some in [spans, spans]:
        different, place, sizes = segment.cut(some, Terms(spark, ["ab", "abc"]), kept)
        assert list(sizes) == [150, 0, 1, 3] and different.take(pa.array(place[-3:])).to_pylist() == ["abc", "a", "x"]
    assert sorted(cuts) == ["abc", "abca", "x"]


def test_index_counts_words_of_a_segmenter(spark):
    """The words go into the terms and the totals of a chunk, though only spans are handed to its task."""
    own = texts(spark).where("text IS NOT NULL")
    cutter = segment.segmenter(spark, NAMES, "[a-z]+")
    for r in search.met(own, ["ab", "abc", "c"], cutter).join(own, ["doc_id", "chunk_order"]).collect():
        wanted = Counter(words(spark, r["text"]) + r["text"].split())
        assert dict(zip(r["at"], np.round(r["tf"], 9), strict=True)) == {i: round(wanted[t] / wanted.total(), 9) for i, t in enumerate(["ab", "abc", "c"]) if wanted[t]}


def test_documents_of_one_id_are_summed(spark, tmp_path):
    for t in oracle.TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    docs = spark.createDataFrame([(1, "word and word"), (1, "and word"), (2, "and wordand"), (None, "word"), (None, "word x"), (3, "")], "doc_id long, text string")
    docs.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    assert oracle.of_spark(q.QUERIES["lexicon_words"](spark, str(tmp_path))) == oracle.of_sql(q.SQL["lexicon_words"], str(tmp_path))


def test_lexicon_words_shuffles_no_words(spark):
    plan = q.QUERIES["lexicon_words"](spark, "/root/testdata/sf0.001").where("doc_id >= 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 1 and "LeftAnti" in plan
