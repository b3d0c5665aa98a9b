"""Replacement of tables as a whole, and the index that follows its files."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import incremental, index
from tidewell.sources import corpus, snapshots


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_readers_are_pinned(spark, tmp_path):
    at = str(tmp_path / "index")
    one, two = (spark.createDataFrame([(x,)], "v string") for x in ("one", "two"))
    assert snapshots.latest(spark, at) is None
    corpus.write_index({"chunks": one, "meta": one}, at)
    held = corpus.read_index(spark, at, ("chunks", "meta"))
    corpus.write_index({"chunks": two, "meta": two}, at)
    assert tuples(held["chunks"]) == [("one",)] and tuples(corpus.read_index(spark, at, ("meta",))["meta"]) == [("two",)]
    assert snapshots.versions(spark, at) == [1, 2] and tuples(snapshots.latest(spark, at, 1).table("chunks")) == [("one",)]
    corpus.write_index({"chunks": one, "meta": one}, at)
    assert snapshots.expire(spark, at, 1) == 4 and snapshots.versions(spark, at) == [3]
    assert tuples(corpus.read_index(spark, at, ("chunks",))["chunks"]) == [("one",)]


def test_a_write_that_dies_leaves_the_old_index(spark, tmp_path):
    at = str(tmp_path / "index")
    good = spark.createDataFrame([("a", 1)], "v string, n int")
    corpus.write_index({"chunks": good, "meta": good}, at)
    dies = good.select("v", F.raise_error(F.lit("lost")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        corpus.write_index({"chunks": good.select(F.lit("b").alias("v"), "n"), "meta": dies}, at)  # dies in its second table
    assert snapshots.versions(spark, at) == [1]
    assert all(tuples(df) == [("a", 1)] for df in corpus.read_index(spark, at, ("chunks", "meta")).values())
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, at, {}, 0)
    with pytest.raises(FileNotFoundError):
        corpus.read_index(spark, str(tmp_path / "none"))


def test_knowledge(spark, tmp_path):
    at = str(tmp_path / "known")
    files = spark.createDataFrame([("a.md", "/x/a.md", 1.0, "A")], "filename string, filepath string, mtime double, title string")
    chunks = spark.createDataFrame([(1, "t0", "a.md", 0), (2, "t1", "a.md", 1)], "id long, chunk_text string, source string, chunk_order long")
    nicks = spark.createDataFrame([("a.md", "z", 0), ("a.md", "b", 1), ("a.md", "z", 2)], "filename string, nickname string, ord int")
    meta = lambda **kv: spark.createDataFrame(list(kv.items()), "key string, value string")
    assert not corpus.has_knowledge(spark, at)
    corpus.save_knowledge(at, files, chunks, nicks, meta(model="m", size="1"))
    corpus.save_knowledge(at, files, chunks, nicks, meta(size="2"))
    found = corpus.load_knowledge(spark, at)
    assert tuples(found["nicknames"]) == [("a.md", ["z", "b"])] and tuples(found["meta"]) == [("model", "m"), ("size", "2")]
    assert [r["chunk_text"] for r in found["chunks"].orderBy("chunk_order").collect()] == ["t0", "t1"] and corpus.has_knowledge(spark, at)
    corpus.clear_knowledge(spark, at)
    assert not corpus.has_knowledge(spark, at) and tuples(corpus.load_knowledge(spark, at)["meta"]) == []
    assert tuples(found["files"]) == [("a.md", "/x/a.md", 1.0, "A")]


def test_write_back_equals_a_rebuild(spark, tmp_path, monkeypatch):
    rng, read = random.Random(4), []
    chunked = index.chunked

    def watched(docs, *args, **kwargs):
        read.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        return chunked(docs, *args, **kwargs)

    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 200])))
    files = {f"/k/{i}.md": (100.0, text()) for i in range(6)}
    monkeypatch.setattr(index, "chunked", watched)
    at = str(tmp_path / "live")
    for step in range(4):
        docs = spark.createDataFrame([(p, t) for p, (_, t) in files.items()], "path string, text string")
        listing = spark.createDataFrame([(p, m) for p, (m, _) in files.items()], "path string, mtime double")
        assert incremental.write_back(spark, at, listing, docs) and not incremental.write_back(spark, at, listing, docs)
        own = snapshots.latest(spark, at)
        whole = str(tmp_path / f"whole{step}")
        seen = len(read)
        assert incremental.write_back(spark, whole, listing, docs)
        rebuilt = snapshots.latest(spark, whole)
        del read[seen:]
        for name in ("df", "meta"):
            assert tuples(own.table(name)) == tuples(rebuilt.table(name))
        rounded = lambda s: tuples(incremental.weights(s).select("path", "chunk_order", "term", F.round("tf", 9), F.round("idf", 9)))
        assert rounded(own) == rounded(rebuilt) and len(rounded(own)) > 10
        assert tuples(incremental.live(own, "chunks").drop("generation")) == tuples(rebuilt.table("chunks").drop("generation"))
        if step:
            assert read[-1] == changed
        changed = sorted(rng.sample(sorted(files), 2))
        for p in changed:
            files[p] = (files[p][0] + 1, text())
        for p in rng.sample(sorted(set(files) - set(changed)), 1):
            del files[p]
        files[f"/k/new{step}.md"] = (5.0, text())
        changed = sorted([*changed, f"/k/new{step}.md"])
