from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import orogena.llm.suffix_tree as st
from orogena.llm.suffix_tree import DEPTH, grams, learned, retained, stream, suffix_tree_scores


def unigram(rows):
    """doc_id -> (n_tokens, n_known, N, base), in plain Python."""
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    trained = [w for i, x in tokens if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in x]
    c, n = Counter(trained), len(trained)
    whole = n + 0.5 * (len(c) + 1)
    return Counter((i, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / whole) for w in x), 6)) for i, x in tokens)


@pytest.mark.parametrize("common", [1 << 18, 50])
def test_base_matches_plain_python(spark, odd, odd_rows, monkeypatch, common):
    monkeypatch.setattr(st, "COMMON", common)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for frame, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [r[:2] for r in odd_rows])):
        got = suffix_tree_scores(frame).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == unigram(rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
        assert all(r.score < 0 for r in got)


def plain_score(tree, text):
    """Symbol by symbol: the longest retained suffix of all that was read."""
    states = {c: i for i, c in enumerate(tree.contexts)}
    read, total = b"\n" * DEPTH, 0.0
    for b in stream(text):
        k = next(k for k in range(DEPTH, -1, -1) if read[len(read) - k :] in states)
        total += float(tree.log10[states[read[len(read) - k :]], tree.symbol[b]])
        read += bytes([b])
    return total


def test_automaton_finds_the_longest_suffix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tree = learned(retained(st.counts(docs.where("doc_id < 400"))))
    assert max(map(len, tree.contexts)) >= 3
    texts = [r.text.encode() for r in docs.where("doc_id BETWEEN 400 AND 412").collect()] + [b"", b"  ", b"\xff\x00 odd", b"word " * 3_000]
    got = tree.scores(texts)[0]
    assert np.allclose(got, [plain_score(tree, t) for t in texts], rtol=1e-5)


def test_distributions_sum_to_one(spark):
    tree = learned(retained(st.counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))))
    p = 10.0 ** tree.log10.astype(float)
    unseen = 256 - (p.shape[1] - 1)
    assert np.allclose(p[:, :-1].sum(axis=1) + unseen * p[:, -1], 1, atol=1e-3)


def test_better_than_the_base_on_held_out_texts(spark):
    """On 10,000 documents; on a tenth of that the base, whose chances of unseen words don't sum to one, is ahead."""
    got = suffix_tree_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_counts_are_those_of_plain_python():
    texts = [b"Ab  c", b"", b"ab"]
    want = Counter()
    for t in texts:
        s = b"\n" * DEPTH + stream(t)
        want.update(s[i - DEPTH : i + 1] for i in range(DEPTH, len(s)))
    got = Counter(int(c).to_bytes(DEPTH + 1, "big") for c in grams(texts))
    assert got == want


def test_empty_and_clashing(none, clashing):
    assert suffix_tree_scores(none).count() == 0
    assert suffix_tree_scores(clashing).count() == 6


@pytest.mark.parametrize("head", [1, 60, 700])
def test_the_automaton_decides_no_score(spark, monkeypatch, odd, head):
    """Contexts beyond the automaton give by the join what they give inside it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id > 4").select(F.col("doc_id") + 10**9, "text").toDF("doc_id", "text"))
    scores = lambda: {r.doc_id: r for r in suffix_tree_scores(docs).collect()}
    whole = scores()
    monkeypatch.setattr(st, "HEAD", head)
    got = scores()
    assert got.keys() == whole.keys()
    for i, r in got.items():
        assert (r.n_tokens, r.n_known) == (whole[i].n_tokens, whole[i].n_known)
        assert math.isclose(r.score, whole[i].score, rel_tol=1e-5) and math.isclose(r.base_score, whole[i].base_score, rel_tol=1e-9)


def test_the_tree_grows_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    size = lambda frame: retained(st.counts(frame)).select("d", "context").distinct().count()
    assert size(docs) > 1.5 * size(docs.where("doc_id % 10 = 0"))


@pytest.mark.parametrize("met", [1 << 18, 40])
def test_a_text_has_as_many_rows_as_parts(spark, monkeypatch, met):
    """However many rare words and symbols a text has, it meets their figures in PARTS rows at most, dealt into chunks of texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = lambda: {r.doc_id: r for r in suffix_tree_scores(docs).collect()}
    whole = scores()
    seen = []
    of_parts = st._met
    monkeypatch.setattr(st, "_met", lambda scored, *rest: seen.append(scored.select(F.size("parts").alias("n"), F.aggregate(F.flatten("parts.codes"), F.lit(0), lambda n, _: n + 1).alias("codes")).agg(F.max("n"), F.max("codes")).first()) or of_parts(scored, *rest))
    for name, value in (("HEAD", 60), ("COMMON", 50), ("MET", met)):
        monkeypatch.setattr(st, name, value)
    got = scores()
    assert got.keys() == whole.keys() and seen[0][0] <= st.PARTS < seen[0][1]
    for i, r in got.items():
        assert (r.n_tokens, r.n_known) == (whole[i].n_tokens, whole[i].n_known)
        assert math.isclose(r.score, whole[i].score, rel_tol=1e-5) and math.isclose(r.base_score, whole[i].base_score, rel_tol=1e-9)
