"""Dual-tree search against all pairs."""

import os
import random

import duckdb
import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from wardwright.llm import cover_tree, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def brute(rows, k, every, scale=256):
    """Each query's best among distinct other rows."""
    usable = sorted({(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows
                     if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, q in usable:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if (j, v) != (i, q))
            out += [(i, rank, j, -score) for rank, (score, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def clustered(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dims))
    return (centers[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def found(spark, rows, k=5, every=50, dims="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{dims}>, rank int, score string")
    return rows_of(cover_tree.top_k(df, F.col("vec_id") % every == 0, k), "query_id", "rank", "vec_id", "score")


def test_tree_invariants():
    points = np.floor(256 * clustered(900, 6, 1)).astype(np.int64)
    tree = cover_tree.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(900)) and (tree.points == points[tree.order]).all()
    parents = 0
    for node in range(len(tree.center)):
        inside = tree.points[tree.start[node] : tree.end[node]]
        gaps = np.sqrt(((inside - tree.points[tree.center[node]]) ** 2).sum(1))
        assert abs(gaps.max() - tree.radius[node]) < 1e-6 * (1 + gaps.max())
        assert tree.start[node] <= tree.center[node] < tree.end[node] or node and tree.kids[node] == 0
        kids = list(tree.children(node))
        if kids:
            parents += 1
            assert [tree.start[k] for k in kids] == [tree.start[node], *(tree.end[k] for k in kids[:-1])] and tree.end[kids[-1]] == tree.end[node]
            # Children with a point of their own stand further apart than they cover.
            own = list(dict.fromkeys(tree.center[k] for k in kids))
            gaps = [np.linalg.norm(tree.points[a] - tree.points[b]) for x, a in enumerate(own) for b in own[:x]]
            assert not gaps or min(gaps) > tree.radius[node] / cover_tree.STEP - 1e-6
    assert parents > 10
    again = cover_tree._unpacked(cover_tree._packed([(p.tolist(), [k], k) for k, p in enumerate(points)], "data", 0, 0))
    assert (again.points == tree.points).all() and again.radius == tree.radius and again.kids == tree.kids


def test_search_is_exact_and_prunes(monkeypatch):
    points = np.floor(256 * clustered(2000, 8, 2)).astype(np.int64)
    data, asked = cover_tree.CoverTree(points), cover_tree.CoverTree(points[::40])
    best = cover_tree.Best(6, np.full(len(asked.points), -np.inf))
    seen = cover_tree.search(asked, data, np.array(data.order), 0, best)
    scores = asked.points @ data.points.T
    for q in range(len(asked.points)):
        want = sorted(((int(s), -int(i)) for s, i in zip(scores[q], data.order)), reverse=True)[:6]
        assert [c[:2] for c in best.found[q]] == want
    # Pairs of leaves that were compared, of all: nodes whose points cannot be among the best are left out.
    compared = []
    monkeypatch.setattr(cover_tree, "product", lambda a, b: compared.append(len(a) * len(b)) or a @ b.T)
    again = cover_tree.Best(6, best.bounds)
    cover_tree.search(asked, data, np.array(data.order), 0, again)
    assert [b[:6] for b in again.found] == best.found and sum(compared) < len(asked.points) * len(data.points) / 3 and seen > 0


@pytest.mark.parametrize("seed, n, dims", [(1, 900, 5), (2, 3000, 12), (3, 400, 2)])
def test_equals_all_pairs(spark, monkeypatch, seed, n, dims):
    monkeypatch.setattr(cover_tree, "TREE", 150)  # several cells, parts and bundles
    monkeypatch.setattr(cover_tree, "BUNDLE", 2)
    vectors = clustered(n, dims, seed).round(1)  # rounded, so that scores tie
    rows = [(k, v.tolist(), 1, "clash") for k, v in enumerate(vectors)]
    assert found(spark, rows, every=25) == brute([r[:2] for r in rows], 5, 25)


def test_odd_rows(spark):
    rng = random.Random(4)
    vector = lambda: [rng.choice([-0.5, 0.25, 1.0]) for _ in range(3)]
    rows = [(k, vector()) for k in range(60)] + [(k, [9.0, 9.0, 9.0]) for k in range(100, 400)]  # a vector many rows have, queries among them
    rows += [(0, vector()), (50, [1.0, 0.25, 1.0]), (7, rows[7][1]), (7, rows[7][1])]  # ids and rows that repeat
    rows += [(None, vector()), (450, None), (500, [1.0, None, 1.0]), (550, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0])]
    assert found(spark, [(*r, 1, "x") for r in rows]) == brute(rows, 5, 50)


def test_few_rows_lengths_large_numbers_and_nothing(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, []), (50, [0.5, 0.5, 4.0])]
    padded = [(i, v + [0.0] * (3 - len(v))) for i, v in rows]
    assert found(spark, [(*r, 1, "x") for r in rows]) == brute(padded, 5, 50)
    # Beyond double precision scores stay exact; what cannot fit 64 bits takes no part.
    rows = [(0, [3e6 + 1, 2.0**-8]), (1, [3e6 + 1, 3 * 2.0**-8]), (2, [3e6, 5.0]), (3, [-3e6, 1.0]), (100, [1e12, 1.0])]
    assert found(spark, [(*r, 1, "x") for r in rows], dims="double") == brute(rows[:-1], 5, 50)
    assert found(spark, [(50, [1.0], 1, "x")]) == [] and found(spark, []) == [] and found(spark, [(1, [1.0], 1, "x")]) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    columns = ("query_id", "rank", "vec_id", "score")
    want = sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({cover_tree.SQL})").fetchall())
    assert rows_of(queries.QUERIES["op12_cover_tree_topk"](spark, SF), *columns) == want
