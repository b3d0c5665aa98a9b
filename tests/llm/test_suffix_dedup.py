"""Repeated passages against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import queries
from tidewell.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, start int, found string, doc long, copies int"


def brute(rows, length=100):
    """rows: (doc_id, text). By the definition; rows of one id in order of a hash of their text, null ids last."""
    own = [(i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), n, (t or "").encode()) for n, (i, t) in enumerate(rows)]
    seen, out = set(), []
    for null, i, _, _, raw in sorted(own):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((None if null else i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, length=100):
    df = spark.createDataFrame([(i, t, 0, "", 0, 0) for i, t in rows], DOCS).repartition(5)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in S.dedup(df, length=length).collect()), key=str)


def passages(seed, docs, alphabet="abcdefgh é"):
    """Texts put together from common passages, some altered, some cut, and own words."""
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list(alphabet), n))
    common = [word(int(n)) for n in rng.integers(60, 700, 12)]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            x = common[int(rng.integers(0, len(common)))]
            a, b = sorted(rng.integers(0, len(x) + 1, 2).tolist())
            x = x if rng.random() < 0.5 else x[a:b]
            if x and rng.random() < 0.3:
                k = int(rng.integers(0, len(x)))
                x = x[:k] + "#" + x[k + 1 :]
            parts += [x, word(int(rng.integers(0, 50)))]
        out.append("".join(parts))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 255]), min_size=3, max_size=40), min_size=1, max_size=8), st.integers(1, 9))
def test_boundaries(texts, length):
    """Common prefixes shorter than length, of the suffixes that do not reach a text's end within it."""
    symbols = np.array([s for t in texts for s in [*(x + 1 for x in t), S.SEPARATOR]], np.uint16)
    order = S.suffixes(symbols, length)
    below = S.boundaries(symbols, order, length)
    own = symbols.tolist() + [S.SEPARATOR] * length
    assert sorted(order.tolist()) == list(range(len(symbols)))
    for k in range(1, len(order)):
        x, y = (own[order[k - 1 + i] : order[k - 1 + i] + length] for i in (0, 1))
        assert x <= y
        if S.SEPARATOR not in y or S.SEPARATOR not in x:
            assert below[k] == (x != y)


@pytest.mark.parametrize("group,block,part", [(4_096, 1 << 20, 16 << 20), (2, 500, 2_000)])
def test_against_brute_force(spark, monkeypatch, group, block, part):
    for name, value in (("GROUP", group), ("BLOCK_BYTES", block), ("LOCAL_BYTES", part), ("SLICE_BYTES", part)):
        monkeypatch.setattr(S, name, value)
    texts = passages(1, 60) + ["", None, "x" * 99, "x" * 100, "x" * 101, "x" * 350, "ab" * 300, "é" * 120, "y" * 99 + "x" * 100]
    rng = np.random.default_rng(2)
    rows = list(zip(rng.permutation(len(texts)).tolist(), texts, strict=True))
    assert found(spark, rows) == brute(rows)
    assert sum(r[2] for r in brute(rows)) > 1_000


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 1_000)
    x = passages(5, 1, "abcdefghijklmnop")[0] + "".join(chr(97 + i) for i in np.random.default_rng(9).integers(0, 26, 9_000))
    rows = [(2, x[3_700:4_400] + "??" + x[:500]), (1, x), (3, "!" + x)]
    assert found(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark):
    a, b = "".join(passages(7, 3)), "".join(passages(8, 3))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, a + "z"), (None, None), (2, "short"), (2, "short"), (0, a[50:]), (-5, b + a)]
    assert found(spark, rows) == brute(rows)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sum(r["n_removed"] for r in got) > 0
