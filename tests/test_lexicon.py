"""Names in questions: the automaton against containment, renaming against the plain loop, and what a question is restricted to."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import segment
from tidewell.functions.automata import Terms
from tidewell.jobs import answer
from tidewell.jobs import queries as q
from tidewell.operators import dense, entities, index, lexicon, search

SF = "/root/testdata/sf0.001"


def drawn(seed, n, longest, letters="abc武器 "):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [lexicon.CHARACTERS, 40])
def test_held(spark, limit):
    texts, terms = [*drawn(1, 60, 40), None, ""], [*drawn(2, 80, 4), "", "abc", "bc", "abc"]
    found = lexicon.held(spark.createDataFrame(list(enumerate(texts)), "qid long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), limit)
    wanted = {(i, t) for i, x in enumerate(texts) for t in terms if x and t and t in x}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == wanted and len(rows) == len(wanted)


def replaced(text, names):
    """names: (ord, at, canonical, nick)."""
    for _, _, canonical, nick in sorted(names, key=lambda n: (n[0], -len(n[3]), n[1])):
        if nick and canonical and nick != canonical and canonical not in text and nick in text:
            text = text.replace(nick, canonical, 1)
    return text


@pytest.mark.parametrize("limit", [lexicon.CHARACTERS, 30])
def test_renamed(spark, limit):
    texts, words = drawn(3, 80, 25), drawn(4, 60, 3) + drawn(5, 60, 6)
    rng = random.Random(6)
    names = [(k % 23, k, rng.choice(words), w) for k, w in enumerate(words)]
    found = lexicon.renamed(spark.createDataFrame(list(enumerate(texts)), "qid long, text string"), spark.createDataFrame(names, "ord long, at long, canonical string, nick string"), limit)
    assert {r["qid"]: r["text"] for r in found.collect()} == {i: replaced(t, names) for i, t in enumerate(texts)}


def test_leftmost_longest(spark):
    terms = sorted({t for t in drawn(7, 60, 4, "abc") if len(t) > 1})
    own = Terms(spark, terms)
    for text in drawn(8, 200, 15, "abcd"):
        i, wanted = 0, []
        while i < len(text):
            n = max((len(t) for t in terms if text.startswith(t, i)), default=1)
            wanted.append(text[i : i + n])
            i += n
        assert segment.segment(text, own) == wanted
    with pytest.raises(ValueError):
        segment.segmenter(spark, ["x" * segment.CHARACTERS, "yy"])


def test_registered(spark):
    names = spark.createDataFrame([("stem", "title"), ("x", "title"), ("stem", None)], "stem string, title string")
    assert sorted(r["name"] for r in segment.registered(names).collect()) == ["stem", "title"]


NAMES = [("bow", 0, "Tri Bow"), ("bow", 1, "tb"), ("bow", 2, "bow"), ("弓", 0, "三弓"), ("弓", 1, "Tri Bow"), ("mg", 0, "N MG"), ("mg", 1, "brush"), ("mg", 2, "tb"), ("ref", 0, "Names"), ("bad", 0, "")]


def asked(spark, *questions):
    return spark.createDataFrame([(i, x, x) for i, x in enumerate(questions)], "qid long, question string, query string")


def test_title_and_alias_are_both_kept(spark):
    names = spark.createDataFrame(NAMES, "name string, ord int, term string")
    found = entities.matched(asked(spark, "is tb the TRI BOW?"), names)
    assert sorted(map(tuple, found.collect())) == [(0, "bow", "Tri Bow", "Tri Bow", "tb"), (0, "mg", "tb", None, "tb"), (0, "弓", "Tri Bow", None, "Tri Bow")]
    assert {tuple(r) for r in entities.meanings(found, names).collect()} == {(0, "tb", "N MG"), (0, "Tri Bow", "三弓")}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_resolved(spark):
    names = spark.createDataFrame(NAMES, "name string, ord int, term string")
    known, filters = entities.resolved(asked(spark, "the brush", "tb and brush", "nothing", "BRUSH"), names, "ref")
    rows = {r["qid"]: (r["query"], r["note"]) for r in known.collect()}
    assert rows[0] == ("the N MG", "'brush' = N MG")
    assert rows[1] == ("三弓 and N MG", "'brush' = N MG; 'tb' = Tri Bow")
    assert rows[2] == ("nothing", "") and rows[3] == ("BRUSH", "'brush' = N MG")  # replacement minds the case, matching does not
    of = lambda qid: {r["name"] for r in filters.where(F.col("qid") == qid).collect()}
    assert of(0) == {"mg", "ref"} and of(1) == {"弓", "mg", "ref"} and of(2) == set() and of(3) == {"mg", "ref"}
    assert entities.resolved(asked(spark, "the brush"), names, "absent")[1].count() == 1
    shown = known.select("qid", entities.noted(F.col("question"), F.col("note")).alias("s")).orderBy("qid").collect()
    assert shown[0]["s"].endswith("]\n\nthe brush") and shown[2]["s"] == "nothing"


def test_question_filter(spark):
    chunks = spark.createDataFrame([(1, "bow", 0, "alpha words here"), (2, "mg", 0, "beta text here"), (3, "mg", 0, "gamma text"), (4, "x", 0, "alpha beta")], "doc_id long, source string, chunk_order int, text string")
    questions = spark.createDataFrame([(0, "alpha beta"), (1, "alpha"), (2, "alpha")], "qid long, question string")
    names = spark.createDataFrame([(0, "mg"), (1, "absent")], "qid long, name string")
    found = search.of_names(search.scores(questions, chunks), chunks, names)
    hits = sorted((r["qid"], r["doc_id"], r["score"] > 0) for r in found.collect())
    assert hits == [(0, 2, True), (0, 3, False), (2, 1, True), (2, 4, True)]


def test_answers_keep_to_named_sources(spark):
    chunks = spark.createDataFrame([(1, "bow", 0, "alpha words here"), (2, "mg", 0, "beta text here"), (3, "x", 0, "alpha and brush")], "doc_id long, source string, chunk_order int, text string")
    names = spark.createDataFrame(NAMES, "name string, ord int, term string")
    questions = spark.createDataFrame([(0, "alpha of brush"), (1, "alpha")], "qid long, question string")
    seen = answer.answered(questions, chunks, lambda prompts: prompts, names=names).collect()
    by = {r["qid"]: r for r in seen}
    assert by[0]["hit_files"] == "mg" and "'brush' = N MG" in by[0]["answer"] and by[1]["hit_files"] == "bow, x"
    rounds = answer.in_rounds(questions, chunks, lambda prompts: ["done " + p if "x brush" in p or "alpha and brush" in p else "SEARCH: alpha and brush" for p in prompts], names=names)
    found = {r["qid"]: (r["rounds"], r["answer"]) for r in rounds.collect()}
    assert found[0][0] == 2 and "alpha and brush" in found[0][1] and found[1][0] == 1  # only the first round is restricted


def test_blocks_of_questions_and_kept_scores(spark, monkeypatch):
    own, questions = q.written(spark, SF), q.batch(spark, SF)
    whole = search.scores(questions, own)
    rows = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(search, "BATCH_TERMS", 300)
    monkeypatch.setattr(search, "CELLS", 200)
    assert sorted(map(tuple, search.scores(questions, own).collect())) == rows
    kept = search.scores(questions, own, keep=3)
    assert kept.count() < len(rows)
    assert sorted(map(tuple, search.best(kept, 3).collect())) == sorted(map(tuple, search.best(whole, 3).collect()))


def test_dense_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).integers(-3, 4, 4)]) for i in range(80)] + [(98, None), (99, [0.0] * 4)], "vec_id long, embedding array<float>").repartition(3)
    asked_ = vectors.where("vec_id < 9").select(F.col("vec_id").alias("qid"), "embedding")
    whole = dense.cosines(asked_, vectors)
    rows = sorted(map(tuple, whole.collect()))
    assert len(rows) == 9 * 81 and all(abs(r[2]) < 1e-9 for r in rows if r[1] == 99)
    wanted = sorted(map(tuple, dense.best(whole, 5, "vec_id").collect()))
    monkeypatch.setattr(dense, "BLOCK_BYTES", 64)
    monkeypatch.setattr(dense, "CELLS", 40)
    assert sorted(map(tuple, dense.cosines(asked_, vectors).collect())) == rows
    found = dense.top_k(asked_, vectors, 5)
    assert sorted(map(tuple, found.collect())) == wanted
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_expansion_is_spread(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "RoundRobinPartitioning" in plan(index.chunked(docs))
