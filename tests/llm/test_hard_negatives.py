"""Hard negatives against brute force on odd vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import hard_negatives as H

VECTORS = "label int, vec_id long, embedding array<double>, score string, rank int"


def brute(rows, every=100):
    """rows: (label, id, vector). Python integers throughout."""
    own = []
    for n, (label, i, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((n, label, i, [int(np.floor(256 * x)) for x in v]))
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    order = lambda s, r: (-s, r[2] is None, r[2] or 0, r[0])
    out = []
    for a in own:
        if a[2] is None or a[2] % every:
            continue
        near = sorted((order(dot(a[3], r[3]), r), r) for r in own if r[0] != a[0] and r[1] == a[1] and len(r[3]) == len(a[3]))[:5]
        for (s, *_), p in near:
            far = [(dot(a[3], r[3]), r) for r in own if r[1] != a[1] and len(r[3]) == len(a[3])]
            far = sorted(order(n, r) for n, r in far if 30 * -s <= 100 * n <= 90 * -s)[:10]
            out += [(a[2], p[2], k + 1, None if null else i, -s, -n) for k, (n, null, i, _) in enumerate(far)]
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.integers(0, 40), st.integers(1, 9), st.integers(0, 60), st.integers(0, 2**32))
def test_packed_products(anchors, candidates, d, bits, seed):
    rng = np.random.default_rng(seed)
    draw = lambda n: np.floor(rng.uniform(-(2.0**bits), 2.0**bits, (n, d)))
    a, c = draw(anchors), draw(candidates)
    c[rng.random(len(c)) < 0.3] *= 2.0**40  # some rows far larger than others
    wanted = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)), H.LEAST), H.MOST) for q in c] for p in a]
    assert H.products(a, c).tolist() == wanted


@pytest.mark.parametrize("block", [2_048, 1])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(H, "CANDIDATES", 16)
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), int(i), [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(300)]  # many ties
    rows += [(1, 100, rows[100][2]), (1, 100, rows[100][2]), (2, 100, [0.5, 0.25, -0.125, 0.5])]  # repeated ids and rows
    rows += [(None, 400, [1.0] * 4), (1, 500, None), (1, 600, [1.0, None, 1.0, 1.0]), (1, 700, [float("nan")] * 4), (1, 800, [float("inf"), 0.0, 0.0, 0.0]), (2, None, [0.5, 0.5, 0.5, 0.5])]
    rows += [(0, 900, []), (0, 901, []), (1, 902, []), (1, 1000, [0.5] * 6), (1, 1001, [0.5] * 6), (2, 1002, [0.3] * 6), (2, 1100, [3e5, 1.0, 1.0, 1.0]), (2, 1101, [2e5, 1.0, 0.0, 1.0]), (0, 1102, [1e5, 0.0, 1.0, 1.0])]
    found = H.mine(spark.createDataFrame([(label, i, v, "s", 0) for label, i, v in rows], VECTORS).repartition(5), 100, F.col("label"))
    key = lambda x: (x[0], x[1] is None, x[1] or 0, x[3] is None, x[3] or 0, *x[4:])  # noqa: E731  which of equal rows is first doesn't show
    assert sorted(map(key, map(tuple, found.collect()))) == sorted(map(key, brute(rows)))
    assert {x[0] for x in brute(rows)} >= {0, 100, 200, 900, 1000, 1100}


def test_no_rows_and_no_anchors(spark):
    assert H.mine(spark.createDataFrame([], VECTORS), 100, F.col("label")).collect() == []
    assert H.mine(spark.createDataFrame([(1, 1, [1.0], "s", 0), (2, 2, [0.5], "s", 0)], VECTORS), 100, F.col("label")).collect() == []
    text = spark.createDataFrame([("x", 100, [1.0], "s", 0), ("x", 1, [1.0], "s", 0), ("y", 2, [0.5], "s", 0)], VECTORS.replace("label int", "label string"))
    assert [tuple(r) for r in H.mine(text, 100, F.col("label")).collect()] == [(100, 1, 1, 2, 65536, 32768)]
