"""Hard negatives against brute force: random, clustered, tied, repeated and odd rows; and what the trees leave out."""

import math

import numpy as np
import pytest

pytest.importorskip("candlemill.llm")
from candlemill.llm import hard_negatives  # noqa: E402

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, every=50):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = [max(-(1 << 26), min(1 << 26, math.floor(float(np.float32(x)) * 256))) for x in v]
        if i not in best or (label, own) < best[i]:
            best[i] = (label, own)
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, k) for i, (k, w) in best.items() if i != a)
        for p, i, _ in [x for x in scored if x[2] == label][:5]:
            p = -p
            fits = [(n, -s) for s, n, k in scored if k != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(a, i, r + 1, n, p, s) for r, (n, s) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every=50):
    return sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), every).collect())


def clustered(n=700, dims=6, seed=5):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dims)) * 4
    rows = []
    for i in range(n):
        k = int(draw.integers(12))
        v = centres[k] + draw.normal(size=dims) * 0.3
        rows.append((i, k % 4, [float(np.float32(x)) for x in v]))
    return rows


def test_clusters_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 10)
    rows = clustered()
    # a third of the rows have one vector
    rows += [(10_000 + i, i % 3, rows[0][2]) for i in range(350)]
    assert mined(spark, rows, 10) == plain(rows, 10)


def test_odd_rows(spark):
    rows = clustered(120, 3)
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, [1.0, 2.0, 3.0]), (200, None, [1.0, 2.0, 3.0]), (300, 1, None), (350, 1, [1.0, None, 3.0]), (400, 1, [nan, 1.0, 1.0]), (450, 1, [1.0, inf, 1.0]), (500, 1, []), (550, 2, [1.0]), (600, 2, [1.0, 2.0, 3.0, 4.0, 5.0]), (650, 1, [3.0e38, -3.0e38, 1.0])]
    rows += [(-50, 0, [0.5, 0.5, 0.5]), (-50, 0, [0.5, 0.5, 0.5]), (0, 3, [9.0, 9.0, 9.0]), (700, 0, [0.0, 0.0, 0.0]), (750, -1, [1.0, 1.0, 1.0]), (800, 99, [5.0, 5.0, 5.0])]
    rows += [(1000 + i, i % 2, [2.0, 1.0, 0.0]) for i in range(60)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(50, None, None)]) == [] and mined(spark, [(50, 1, [1.0])]) == []


def test_pairs_of_nodes_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 20)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 20)
    own = hard_negatives.whole(hard_negatives.picked(spark.createDataFrame(clustered(), SCHEMA), id="vec_id", label="label", v="embedding"))
    search = hard_negatives.Search(own, own.filter("id % 2 = 0"), 6)
    blocks = search.anchors.selectExpr("a_block", "a_leaf", "a_n", "a_vectors").collect()
    candidates = search.rows.collect()
    least = {b.a_leaf: 4_000_000.0 for b in blocks}
    kept = set(hard_negatives.leaf_pairs(search.anchor_tree, search.row_tree, least, dict.fromkeys(least, math.inf)))
    everything = {(a.a_leaf, c.leaf) for a in blocks for c in candidates}
    assert 0 < len(kept) < 0.7 * len(everything) and kept <= everything
    for a in blocks:
        for c in candidates:
            top = hard_negatives.products(hard_negatives.matrix(a.a_vectors, a.a_n), hard_negatives.matrix(c.vectors, c.n)).max()
            assert top < 4_000_000 or (a.a_leaf, c.leaf) in kept


def test_names(spark):
    rows = clustered(150, 3)
    frame = spark.createDataFrame([("extra", *r, "extra") for r in rows], "id string, vec_id long, label int, embedding array<float>, block string").withColumnRenamed("block", "a_block")
    assert sorted(tuple(r) for r in hard_negatives.mine(frame).collect()) == plain(rows)


def test_exact_products():
    a = np.array([[1 << 26, -(1 << 26)], [3, 4]], np.int32)
    assert hard_negatives.products(a, a).tolist() == [[1 << 53, -(1 << 26)], [-(1 << 26), 25]]
