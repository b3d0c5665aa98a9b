"""Alignment of two tokenizers against whole texts encoded by the unaltered libraries."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import alignment as A
from tidewell.llm import queries, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, block int, pairs string, id int, n_a string"
ODD = ["", None, " ", "  ", "a ", "a  b ", "\n", "\n\n a", "x▁y", "<|endoftext|> <s></s> <unk> <0x41>", "café café ﬁ①", "　wide　space", "﻿mark", "\U0001f600\U0001f1e9\U0001f1ea", "\0nul\0", "=" * 3_000, " " * 500, "ab" * 900, "特殊武器 text", "don't we'll I'D", "tab\tend\t", "e.g. 3.14, 1,000;x:y!?", "a" * 700 + "\n" + "b" * 700, "\x85nel line"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokens.tokenizer_path(A.BYTE_LEVEL))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path(A.PIECES))


def streams(libraries, text):
    """(id, bytes) of both sides, or nothing."""
    a, b = libraries
    back = {c: x for x, c in tokens.byte_symbols().items()}
    if not text:
        return [], []
    x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def groups(x, y):
    ends = lambda s: [sum(len(t) for _, t in s[: k + 1]) for k in range(len(s))] if len(s) < 50 else list(__import__("itertools").accumulate(len(t) for _, t in s))
    ends_x, ends_y = ends(x), ends(y)
    both, out, i, j = set(ends_x) & set(ends_y), [], 0, 0
    for cut in sorted(both):
        p, q = ends_x.index(cut, i) + 1, ends_y.index(cut, j) + 1
        out.append(([t for t, _ in x[i:p]], [t for t, _ in y[j:q]]))
        i, j = p, q
    return out


def brute(libraries, rows):
    found = [(i, *streams(libraries, t)) for i, t in rows]
    aligned = [(i, x, y, groups(x, y)) for i, x, y in found]
    linked = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for *_, gs in aligned]
    count = Counter(p for c in linked for p in c)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for (i, x, y, gs), c in zip(aligned, linked, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in gs)
        best = sum(n for p, n in c.items() if count[p] == highest[p[0]])
        out.append((i, len(x), len(y), len(gs), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeinrst AB.,;:!?'\n\t éß▁武\U0001f600<s>|0129"), max_size=60), min_size=1, max_size=5))
def test_units_give_the_ids_of_whole_texts(libraries, texts):
    own = A.Aligner(tokens.tokenizer_path(A.BYTE_LEVEL), tokens.tokenizer_path(A.PIECES))
    a, n_a, b, n_b = own.tokens(pa.array(texts, pa.string()))
    wanted = [streams(libraries, t) for t in texts]
    assert n_a.tolist() == [len(x) for x, _ in wanted] and n_b.tolist() == [len(y) for _, y in wanted]
    assert a.tolist() == [i for x, _ in wanted for i, _ in x] and b.tolist() == [i for _, y in wanted for i, _ in y]


@pytest.mark.parametrize("batch,block,large", [(8 << 20, 64 << 20, 4_096), (300, 900, 3)])
def test_against_brute_force(spark, monkeypatch, libraries, batch, block, large):
    for name, value in (("BATCH_BYTES", batch), ("BLOCK_BYTES", block), ("LARGE_GROUP", large)):
        monkeypatch.setattr(A, name, value)
    rows = list(enumerate(ODD)) + [(3, "again a text"), (3, "again a text"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, 0, "", 0, "") for i, t in rows], DOCS).repartition(3)
    assert found(A.align(df)) == brute(libraries, rows)


def test_nothing(spark):
    assert found(A.align(spark.createDataFrame([], DOCS))) == []
    assert found(A.align(spark.createDataFrame([(1, None, 0, "", 0, "")], DOCS))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = found(queries.op11_alignment(spark, SF))
    assert got == brute(libraries, rows)
    assert sum(r[1] > 0 for r in got) > 150
