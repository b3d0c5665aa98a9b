"""The pipeline against its stages' own rules."""

import corpus_pipeline
from tests.llm.test_operators import docs, held, shingles, spans, words
from tidewell.llm import toxicity
from tidewell.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    own = table(spark, SF, "documents")
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in own.collect()}
        stage(spark, own, SF).write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in new.collect()}
        if name == "toxicity":
            grammar = toxicity.fit(own, table(spark, SF, "labels"))
            assert set(after) == {i for i, r in before.items() if grammar.score(r["text"]) < 0.7}
        if name == "jaccard_join":
            sets = {i: frozenset(shingles(words(r["text"]))) for i, r in before.items()}
            for i in set(before) - set(after):
                assert any(j < i and 100 * len(sets[i] & sets[j]) >= 50 * len(sets[i] | sets[j]) for j in after)
            kept = sorted(after)
            assert not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0 for k, i in enumerate(kept) for j in kept[:k])
        if name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not held(r["text"], items)}
        if name == "secret_scans":
            assert set(after) == set(before) and not any(spans(r["text"]) for r in after.values())
            assert all(after[i]["n_chars"] == len(after[i]["text"]) for i in after)
        if name == "packing":
            assert set(after) == set(before)
        else:
            assert new.columns == own.columns and 0 < len(after) <= len(before)
        own = new


def test_empty(spark):
    own = docs(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, own, SF).count() == 0


def test_copies_by_row(spark):
    long = lambda x: " ".join(f"{x}{i}" for i in range(60))
    a, b, c, d, e = map(long, "abcde")
    rows = [(1, a), (2, a), (2, b), (2, b + " more"), (3, c), (3, c), (3, c), (None, d), (None, d), (None, a), (4, e), (None, e), (None, None), (None, ""), (5, ""), (5, "")]
    own = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = corpus_pipeline.drop_near_copies(spark, own, SF)
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert kept.columns == own.columns
    (two,) = [t for i, t in found if i == 2]
    assert two in (b, b + " more")
    assert found == sorted([(1, a), (2, two), (3, c), (None, d), (4, e), (None, None), (None, ""), (5, ""), (5, "")], key=str)


def test_clashing_columns(spark):
    """Columns that stages use names of keep their values, whatever they are called."""
    long = lambda x: " ".join(f"{x}{i}" for i in range(60))
    names = ["found", "item_ids", "kinds", "node", "row", "own", "candidate_key", "candidate_kinds", "decontamination_row", "row_key", "row_times", "component"]
    texts = [long("a"), long("a"), "password=abcdefgh " + long("b"), None]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, own, SF)
        assert kept.columns == own.columns
        for r in kept.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
    assert kept.where("doc_id = 2").first()["text"] == "[SECRET] " + long("b")
