"""Worked examples and properties of the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.jobs import queries as q
from tidewell.operators import dense, entities, incremental, index, reports, search, store
from tidewell.sources import corpus, markdown
from tidewell.streaming import updates

SF = "/root/testdata/sf0.001"


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_idf(spark):
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(["aa bb " * 5, "bb cc " * 5, "cc cc " * 5])], "doc_id long, source string, text string")
    own = index.chunked(docs)
    assert {r["term"]: round(r["idf"], 6) for r in index.idf(index.vectors(own), own).collect()}["aa"] == 0.980829


def test_fusion(spark):
    side = lambda values: spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "qid long, doc_id long, score double")
    found = search.fused(side([2, 1, 0]), side([0.2, 0.8, 0.4]), 0.5, ["doc_id"]).orderBy("doc_id").collect()
    assert [r["score"] for r in found] == [0.625, 0.75, 0.25]


def test_threshold(spark):
    own = spark.createDataFrame([(0, i, 0, s) for i, s in enumerate([1.0, 0.5, 0.1, 0.09, 0.0])], "qid long, doc_id long, chunk_order int, score double")
    assert sorted(r["score"] for r in search.exhaustive(own).collect()) == [0.1, 0.5, 1.0]


@pytest.mark.parametrize("k, wanted", [(4, ["A.9", "B.2", "C.1", "A.8"]), (5, ["A.9", "B.2", "C.1", "A.8", "A.7"])])
def test_diversify(spark, k, wanted):
    rows = [(0, i, 0, s, src, f"{src}{s}") for i, (src, s) in enumerate([("A", 0.9), ("A", 0.8), ("A", 0.7), ("B", 0.2), ("C", 0.1)])]
    own = spark.createDataFrame(rows, "qid long, doc_id long, chunk_order int, score double, source string, text string")
    assert [f"{r['source']}{r['score']}".replace("0.", ".") for r in search.diversified(own, k).orderBy("rank").collect()] == wanted
    with pytest.raises(ValueError):
        search.diversified(own, 0)


def test_filter_is_a_subset(spark):
    own = q.chunks(spark, SF)
    scored = search.scores(q.batch(spark, SF), own)
    kept = search.of_sources(scored, own, ["src1"]).select(scored.columns)
    assert kept.exceptAll(scored).isEmpty() and search.of_sources(scored, own, []) is scored


def test_plan_has_no_product_for_equi_joins(spark):
    plan = search.scores(q.batch(spark, SF), q.chunks(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_scan_is_pruned(spark):
    plan = q.QUERIES["mode_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan


def test_encoded(spark):
    texts = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [len(r["embedding"]) for r in dense.encoded(texts).collect()] == [64, 64]


def test_entities(spark):
    names = spark.createDataFrame([("f1", 0, "Tri Bow"), ("f1", 1, "tb"), ("f2", 0, "三弓"), ("f2", 1, "Tri Bow"), ("f3", 0, "")], "name string, ord int, term string")
    asked = spark.createDataFrame([(0, "the TRI BOW"), (1, "a tb?"), (2, "none")], "qid long, question string")
    found = entities.matched(asked, names)
    assert tuples(found) == [(0, "f1", "Tri Bow", "Tri Bow", None), (0, "f2", "Tri Bow", None, "Tri Bow"), (1, "f1", "tb", None, "tb")]
    assert (1, "f2", "Tri Bow") in tuples(entities.cross_language(found, names).select("qid", "name", "term"))
    nicks = spark.createDataFrame([(0, "b", "B"), (0, "a", "A"), (0, "C", "C")], "qid long, nick string, canonical string")
    assert entities.note(nicks).first()["note"] == "'a' = A; 'b' = B"


def test_families(spark):
    names = spark.createDataFrame([(x,) for x in ["X", "X Deco", "XMG", "XMILK", "XMILK D", "X Deco MG"]], "name string")
    assert {r["name"]: r["family"] for r in entities.families(names).collect()} == {"X": "X", "X Deco": "X", "XMG": "X", "XMILK": "XMILK", "XMILK D": "XMILK", "X Deco MG": "X"}


def test_merged_aliases(spark):
    own = spark.createDataFrame([("f", 0, "a")], "name string, ord int, nick string")
    table = spark.createDataFrame([("T", 0, "a"), ("T", 1, "b"), ("U", 0, "c")], "official string, ord int, nick string")
    titles = spark.createDataFrame([("f", "T")], "name string, title string")
    assert tuples(entities.merged_aliases(own, table, titles).select("nick", "status")) == [("a", "kept"), ("b", "merged")]
    assert tuples(entities.merge_report(own, table, titles)) == [("T", "f", "merged", 1), ("U", "", "skipped", 0)]


def test_expand_keeps_one_familys_figures(spark):
    own = spark.createDataFrame([(1, 0, "X", "DPS 伤害 射程 a"), (2, 0, "XMG", "DPS 伤害 射程 a"), (2, 1, "XMG", "intro"), (3, 0, "Y", "z")], "doc_id long, chunk_order int, source string, text string")
    hits = spark.createDataFrame([(0, 2, 1, "XMG", 0.5), (0, 1, 9, "X", 0.7)], "qid long, doc_id long, chunk_order int, source string, score double")
    families = spark.createDataFrame([("X", "X"), ("XMG", "X")], "source string, family string")
    found = search.expanded(hits, own, families).where("NOT hit")
    assert tuples(found.select("doc_id", "chunk_order", "score")) == [(1, 0, 0.7)]


def test_store(spark):
    logs = spark.createDataFrame([(1, "a")], "id long, mode string")
    added = store.appended(logs, spark.createDataFrame([("y",), ("x",)], "mode string"), ["mode"])
    assert tuples(added) == [(1, "a"), (2, "x"), (3, "y")]
    terms = spark.createDataFrame([("s", "old", 1), ("s", "new", 2), ("t", "u", 1)], "slang string, formal string, at int")
    assert tuples(store.upserted(terms, ["slang"], ["at"]).select("slang", "formal")) == [("s", "new"), ("t", "u")]
    assert tuples(store.deleted(terms, spark.createDataFrame([("s",)], "slang string"), ["slang"]).select("slang")) == [("t",)]
    assert store.rated(spark.createDataFrame([(0,), (5,), (None,)], "rating int")).count() == 1
    messages = spark.createDataFrame([(1, i, "user", str(i)) for i in range(1, 13)], "conversation_id long, id long, role string, content string")
    assert [r["content"] for r in store.history(messages, 10).orderBy("nth").collect()] == [str(i) for i in range(3, 13)]
    diff = store.differences(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), spark.createDataFrame([("b", "3"), ("c", "4")], "k string, v string"), "k", "v")
    assert {r["k"]: r["status"] for r in diff.collect()} == {"a": "removed", "b": "changed", "c": "added"}


def test_migration(spark):
    old = spark.createDataFrame([(1, "q")], "id long, question string")
    new = schemas.migrated(old, "query_logs").first()
    assert new["session_id"] == 0 and new["error"] == "" and new["answer"] is None


def test_percentiles(spark):
    runs = spark.createDataFrame([(x,) for x in (3265, 3353, 3579, 3614, 4704, 2830, 3161, 3219, 4362, 3504)], "latency_ms long")
    row = reports.latencies(runs).first()
    assert (row["p50"], row["p90"], row["p95"], row["p99"], row["min"], row["max"], row["avg"]) == (3504, 4704, 4704, 4704, 2830, 4704, 3559)
    assert "| p50 | 3504 |" in reports.markdown(reports.latencies(runs))


def test_incremental(spark):
    stored = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0)], "path string, mtime double")
    found = spark.createDataFrame([("a", 100.05), ("b", 100.2), ("d", 5.0)], "path string, mtime double")
    changed = incremental.changes(stored, found)
    assert {r["path"]: r["status"] for r in changed.collect()} == {"a": "same", "b": "modified", "c": "deleted", "d": "added"}
    assert not incremental.is_fresh(stored, found) and incremental.is_fresh(stored, stored)
    old = spark.createDataFrame([("a", "a0"), ("b", "b0"), ("c", "c0")], "path string, text string")
    new = spark.createDataFrame([("a", "a0"), ("b", "b1"), ("d", "d1")], "path string, text string")
    assert tuples(incremental.updated(old, changed, new)) == tuples(new)  # as a full rebuild
    assert incremental.forced(stored, ["b"]).where("mtime = 0").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.md").write_text("# One\n\n俗称：甲、乙\n")
    (tmp_path / "two.md").write_text("no heading")
    (tmp_path / "skip.txt").write_text("# no")
    assert tuples(corpus.read_markdown(spark, str(tmp_path)).select("name", "title", "aliases")) == [("one.md", "One", ["甲", "乙"]), ("two.md", "two", [])]
    with pytest.raises(ValueError):
        corpus.read_markdown(spark, "x.txt")
    (tmp_path / "g").write_text("# c\n\na | b | c\nx | y\na | z\n")
    glossary = corpus.read_glossary(spark, str(tmp_path / "g"))
    assert tuples(glossary.select("slang", "formal")) == [("a", "z"), ("x", "y")]
    assert [r["value"] for r in corpus.glossary_lines(glossary).collect()] == ["a | z", "x | y"]
    rows = spark.createDataFrame([(0, "| 官中译名 | 俗称 | x |"), (1, "|---|---|---|"), (2, "| A | b / c / b | o |"), (3, "K=V=W")], "nth int, line string")
    assert [r["nick"] for r in corpus.parse_aliases(rows).orderBy("ord").collect()] == ["b", "c"]
    assert tuples(corpus.settings(rows.where("nth = 3"))) == [("K", "V=W")]
    corpus.write_index({"chunks": glossary}, str(tmp_path / "index"))
    assert corpus.read_index(spark, str(tmp_path / "index"), ("chunks",))["chunks"].count() == 2


def test_markdown_files(spark, tmp_path):
    to = tmp_path / "pages"
    to.mkdir()
    pages = spark.createDataFrame([("a:b", "one"), ("c?", None), ("", "no"), (None, "no"), (" d ", "vier é")], "name string, text string").repartition(3)
    markdown.write_pages(pages, str(to))
    markdown.write_pages(pages.where("name = 'a:b'").withColumn("text", F.lit("new")), str(to))
    assert {p.name: p.read_text() for p in to.iterdir()} == {"ab.md": "new", "c.md": "", "d.md": "vier é"}
    markdown.write_pages(pages.where("name = 'a:b'"), str(to), full_width=True)
    before = {p.name for p in to.iterdir()}
    assert "a：b.md" in before
    dies = pages.withColumn("text", F.when(F.col("name") == " d ", F.raise_error(F.lit("lost"))).otherwise(F.lit("x"))).withColumn("name", F.concat("name", F.lit("2")))
    with pytest.raises(Exception, match="lost"):
        markdown.write_pages(dies, str(to))
    assert {p.name for p in to.iterdir()} == before  # neither files nor the staging folder


def test_markdown_task_after_an_abort(tmp_path, monkeypatch):
    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 1)

    monkeypatch.setattr(markdown.TaskContext, "get", Task)
    writer = markdown.MarkdownSource({"path": str(tmp_path / "pages")}).writer(None, False)
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([{"name": "a", "text": "late"}]))
    assert list((tmp_path / "pages").iterdir()) == []


def test_families_in_ranges(spark):
    rng = random.Random(2)
    own = {"".join(rng.choice("aab") for _ in range(rng.randint(0, 6))) + rng.choice(["", " D", "MG", "D", "（x"]) for _ in range(300)}
    wanted = {}
    for name in sorted(own, key=lambda n: (len(n), n)):
        bases = [b for b in wanted if wanted[b] == b and name.startswith(b) and (name[len(b)] in " （" or name[len(b) :] in entities.SUFFIXES)]
        wanted[name] = min(bases, key=len, default=name)
    found = {r["name"]: r["family"] for r in entities.families(spark.createDataFrame([(n,) for n in own], "name string")).collect()}
    assert found == wanted and sum(k != v for k, v in found.items()) > 50


def test_ranks_without_a_single_task(spark):
    runs = spark.range(5000).selectExpr("id * 7919 % 1013 AS latency_ms", "id % 3 AS k")
    values = sorted(r["latency_ms"] for r in runs.collect())
    report = reports.latencies(runs)
    row = report.first()
    assert [row[k] for k in reports.POINTS] == [values[int(len(values) * p)] for p in reports.POINTS.values()]
    ranks = reports.running(runs.groupBy("latency_ms").agg(F.count(F.lit(1)).alias("c")), "latency_ms", [])
    assert "Exchange SinglePartition" not in ranks._jdf.queryExecution().executedPlan().toString()
    for r in reports.latencies(runs, by=["k"]).collect():
        own = sorted(x["latency_ms"] for x in runs.where(F.col("k") == r["k"]).collect())
        assert [r[k] for k in reports.POINTS] == [own[int(len(own) * p)] for p in reports.POINTS.values()]


def test_conversations(spark):
    t = lambda n: dt.datetime(2024, 1, 1, n)
    own = spark.createDataFrame([(1, "", t(1), t(1)), (2, "", t(2), t(2)), (3, "named", t(3), t(3))], "id long, title string, created_at timestamp, updated_at timestamp")
    messages = spark.createDataFrame([(1, 7, "user", "second", t(9)), (1, 5, "user", "f" * 50, t(5)), (3, 6, "user", "x", t(4))], "conversation_id long, id long, role string, content string, created_at timestamp")
    after = store.with_messages(own, messages)
    assert [tuple(r)[:2] + (r["msg_count"],) for r in store.listed(after, messages).collect()] == [(1, "f" * 40, 2), (3, "named", 1), (2, "", 0)]
    assert store.last_id(after).first()["id"] == 1 and store.last_id(after.limit(0)).first()["id"] is None


def test_stream(spark, tmp_path):
    schema = "doc_id long, source string, text string, ts timestamp"
    rows = [(i, "s", f"document number {i} of the stream", dt.datetime(2024, 1, 1)) for i in range(3)]
    spark.createDataFrame([*rows, rows[0]], schema).write.parquet(str(tmp_path / "in"))
    stream = updates.chunk_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = updates.upsert_into(spark, stream, str(tmp_path / "log"), ["doc_id"], "chunk_order").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert updates.latest(spark, str(tmp_path / "log"), ["doc_id"], "chunk_order").select("doc_id").distinct().count() == 3


