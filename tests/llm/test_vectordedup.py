import math
import random

import numpy as np
import pytest

from barloom.llm import vectordedup as V
from barloom.llm._common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def usable(e, label):
    return label is not None and e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e)


def brute(rows, cosine=0.98):
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    x = [np.array(np.array(r[1], np.float32), float) if usable(r[1], r[2]) else None for r in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine:
                    n[i] += 1
                    parent[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r[0]), r[0])
    return sorted((r[0], n[i], first[find(i)], r[0] == first[find(i)]) for i, r in enumerate(rows))


def vectors(seed=0, n=40, dim=16):
    rnd = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rnd.standard_normal(dim)
        for _ in range(rnd.integers(1, 6)):
            noisy = base + rnd.standard_normal(dim) * rnd.choice([0, 0.05, 0.12, 0.2])
            rows.append((len(rows) + 10, [float(np.float32(v)) for v in noisy * rnd.uniform(0.1, 9)], int(rnd.integers(0, 2)), "x"))
    return rows


ODD = [
    (1, None, 0, "x"), (2, [], 0, "x"), (3, [0.0] * 16, 0, "x"), (4, [1.0, None] + [0.0] * 14, 0, "x"), (5, [float("nan")] + [1.0] * 15, 0, "x"), (6, [float("inf")] + [1.0] * 15, 0, "x"),
    (7, [1.0] * 16, None, "x"), (8, [1.0] * 8, 0, "x"), (9, [2.0] * 8, 0, "x"),
]


@pytest.mark.parametrize("block,most", [(2048, 100_000), (7, 100_000), (3, 0)])
def test_like_brute_force(spark, monkeypatch, block, most):
    rows = ODD + vectors()
    monkeypatch.setattr(V, "HOT_MOST", most)
    monkeypatch.setattr(V, "OCCUPANCY", 4)
    plain = V.linked
    monkeypatch.setattr(V, "linked", lambda r, scratch, cosine: plain(r, scratch, cosine, block))
    got = V.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_copies_count(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1, "x") for i in (5, 3, 9)] + [(3, [1.0, 2.0, 3.0], 1, "x")] + [(4, [1.0, 2.0, 3.0], 2, "x")]
    got = sorted(map(tuple, V.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(3, 3, 3, True), (3, 3, 3, True), (4, 0, 4, True), (5, 3, 3, False), (9, 3, 3, False)]


def test_empty_table(spark):
    assert V.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_the_traversal():
    rnd = np.random.default_rng(1)
    base = V.normalised(rnd.standard_normal((3000, 32)))
    moved = V.normalised(base + rnd.standard_normal(base.shape) * 0.03)
    index = V.MultiIndex(base, 24)
    near = (base * moved).sum(1) >= V.COSINE
    cells, (l1, l2) = index.cells(moved), index.bounds(base)
    visited = l1[np.arange(len(base)), cells[0]] + l2[np.arange(len(base)), cells[1]] <= index.stop
    assert near.sum() > 1000 and visited[near].mean() > 0.99
    # the bound holds: a stop at the threshold's own distance loses nothing
    assert ((l1[np.arange(len(base)), cells[0]] + l2[np.arange(len(base)), cells[1]])[near] <= 2 - 2 * V.COSINE + 1e-9).all()
    # and the traversal does leave most cells out
    assert np.mean([(l1[i][:, None] + l2[i][None] <= index.stop).mean() for i in range(200)]) < 0.5


@pytest.mark.parametrize("n", [2000, 8000])
def test_recall_of_the_query_at_two_sizes(spark, n):
    """Against brute force over pairs; rows moved grow in proportion."""
    rnd = np.random.default_rng(n)
    base = rnd.standard_normal((n // 2, 32))
    x = np.concatenate([base, base + rnd.standard_normal(base.shape) * rnd.choice([0.05, 0.15, 0.2], (n // 2, 1))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % (n // 2) % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    y = V.normalised(x.astype(float))
    near = (y[: n // 2] * y[n // 2 :]).sum(1) >= V.COSINE
    got = {r["vec_id"]: r["n_links"] for r in V.near_duplicates(spark, df).collect()}
    found = sum(got[i] for i in range(n // 2))
    assert near.sum() > n / 10 and found >= 0.99 * near.sum()
    assert V.centroids(10 * n, 2, V.SAMPLE) > 2 * V.centroids(n, 2, V.SAMPLE) or n == 2000


def test_multi_sequence_is_in_order_and_whole():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        a, b, stop = rnd.uniform(0, 1, rnd.integers(1, 9)), rnd.uniform(0, 1, rnd.integers(1, 9)), rnd.uniform(0, 2)
        got = list(V.multi_sequence(a, b, stop))
        sums = [a[i] + b[j] for i, j in got]
        assert sums == sorted(sums) and set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= stop} and len(got) == len(set(got))


def test_hot_cell_is_many_tasks(spark):
    """70 % of the vectors in one cell: no task has them all."""
    rnd = np.random.default_rng(5)
    hot = rnd.standard_normal(16)
    x = [hot + rnd.standard_normal(16) * 0.001 if i % 10 < 7 else rnd.standard_normal(16) for i in range(600)]
    df = spark.createDataFrame([(1, 16, "0", 0, False, i, 1, v.tolist()) for i, v in enumerate(x)], "_x int, dim int, label string, cell long, foreign boolean, id long, copies long, embedding array<double>").drop("_x")
    got = V.linked(df, Scratch(spark, "test"), block=50)
    counts = got.filter("n IS NOT NULL").groupBy("a").agg({"n": "sum"}).collect()
    assert sorted(r[1] for r in counts)[-420:] == [419] * 420


def test_forest_spans_a_block():
    rnd = random.Random(2)
    x = np.array([[math.cos(a), math.sin(a)] for a in (rnd.uniform(0, 2) for _ in range(60))])
    ids = np.arange(60)
    one = np.ones(60, np.int64)
    who, n, forest = V.link_block(x, ids, one, np.zeros(60, bool), x, ids, one, 0.999)
    full = (x @ x.T >= 0.999) & ~np.eye(60, dtype=bool)
    assert dict(zip(who.tolist(), n.tolist())) == {i: k for i, k in enumerate(full.sum(1).tolist()) if k} and len(forest) <= 120
    who, n, _ = V.link_block(x[:20], ids[:20], 2 * one[:20], np.ones(20, bool), x[20:], ids[20:], one[20:], 0.999)
    assert dict(zip(who.tolist(), n.tolist())) == {i: k for i, k in enumerate([*full[:20, 20:].sum(1).tolist(), *(2 * full[20:, :20].sum(1)).tolist()]) if k}
    lab = ids.copy()
    for _ in range(60):
        lab = np.minimum(lab, np.where(full, lab[None], 99).min(1))
    own = ids.copy()
    for _ in range(60):
        for a, b in forest:
            own[a] = own[b] = min(own[a], own[b])
    assert (own == lab).all()
