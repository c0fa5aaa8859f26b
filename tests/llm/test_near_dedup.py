from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from conftest import make_text

from orogena.llm.common import components
from orogena.llm.near_dedup import NearParams, _shingles, near_duplicates, shingle_hashes, signature


def brute(rows, k, percent=80):
    """doc_id -> (set size, smallest id reachable), by all pairs."""
    sets = {i: _shingles((t or "").encode(), k) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i in sets if sets[i]]
    for a, b in combinations(ids, 2):
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_matches_all_pairs(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, NearParams(words=k)).collect()}
    assert got == brute(rows, k)


def test_large_group_of_near_copies(spark):
    """Copies of one text that each differ in some words, many of them not alike pairwise but through others."""
    rng = np.random.default_rng(4)
    base = make_text(5, 100).split()
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(100, rng.integers(0, 9), replace=False):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1_000 + i, make_text(50 + i, 80)) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), NearParams(words=2)).collect()}
    assert got == brute(rows, 2)


def test_odd_rows(odd, odd_rows, none, clashing):
    found = near_duplicates(odd, NearParams(words=2)).collect()
    assert len(found) == len(odd_rows)
    want = brute([(r[0], r[1]) for r in odd_rows], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    assert near_duplicates(none).count() == 0
    assert {r.doc_id: r.component_id for r in near_duplicates(clashing).collect()} == {i: i % 3 for i in range(6)}


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1_200, dtype=np.uint64)
    a, b = pool[:1_000], pool[200:]
    same = (signature(a, 512) == signature(b, 512)).mean()
    assert abs(same - 800 / 1_200) < 0.08
    assert (signature(a[::-1].copy(), 64) == signature(a, 64)).all()
    assert len(shingle_hashes(np.arange(3, dtype=np.uint64), 5)) == 1 and len(shingle_hashes(np.zeros(0, np.uint64), 5)) == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [(int(a), int(b)) for a, b in rng.integers(100, 160, (40, 2))] + [(None, 3), (7, None), (500, 500)]
    up = {i: i for e in edges for i in e if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {i for a, b in edges if a is not None and b is not None and a != b for i in (a, b)}
    assert got == {i: root(i) for i in linked}


def test_block_by_block_finds_what_pairs_find(spark, monkeypatch):
    """With one pivot and tiny blocks, every link of a large group comes from the blocks."""
    import orogena.llm.common as common

    monkeypatch.setattr(common, "SMALL_BUCKET", 2)
    monkeypatch.setattr(common, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(6)
    base = make_text(5, 60).split()
    rows = []
    for i in range(40):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 6), replace=False):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), NearParams(words=2, pivots=1)).collect()}
    assert got == brute(rows, 2)
