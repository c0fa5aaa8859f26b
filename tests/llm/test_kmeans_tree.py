from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orogena.llm.kmeans_tree import fitted, nearest


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = x @ np.array(v, float)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def check(got, want, least):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, truth in want.items():
        found = by.get(q, [])
        assert [r for r, _, _ in found] == list(range(1, len(truth) + 1))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & {v for v, _ in truth})
        total += len(truth)
    assert set(by) == set(want)
    assert hit / max(1, total) >= least


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(nearest(df, F.col("vec_id") % 20 == 0).collect(), brute(rows, 20), 0.9)


def test_copies_ties_and_unequal_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8) * rng.uniform(0.1, 3)) for i in range(600)] + [(600 + i, np.ones(8)) for i in range(3_000)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0, target=1.0).collect()
    check(got, brute(rows, 20), 0.97)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (40, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, leaf string, v string")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)}
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_files_and_walks_every_leaf():
    x = np.random.default_rng(1).normal(size=(3_000, 6))
    tree = fitted(x)
    assert set(tree.file(x)) == set(range(tree.leaves))
    assert sorted(tree.walk(x[0])) == list(range(tree.leaves))
    same = fitted(np.ones((500, 4)))
    assert same.leaves == 1 and (same.file(np.ones((3, 4))) == 0).all()


def test_a_query_meets_few_leaves(spark):
    """Where vectors lie in clusters the walk ends early, and what it has met holds the neighbours."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.normal(size=16) * 0.3]) for i in range(6_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(nearest(df, F.col("vec_id") % 20 == 0).collect(), brute(rows, 20), 0.9)
    x = np.array([v for _, v in rows])
    tree = fitted(x)
    sizes = np.bincount(tree.file(x), minlength=tree.leaves)
    walked = [tree.walk(q, 8, sizes, 21) for q in x[::200]]
    assert all(sizes[w].sum() >= 21 and sizes[w].sum() < 0.5 * len(x) for w in walked)
    assert all((tree.walk(q)[: len(w)] == w).all() for q, w in zip(x[::200], walked))


def test_another_length_takes_no_part(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(100, [1.0]), (120, [1.0, 2.0, 3.0]), (7, [])], "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(0, 1), (0, 2), (0, 3), (20, 29), (20, 28), (20, 27)]
