from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from orogena.llm.bpe import ByteBpe, bpe_round_trip, decode, encode, loaded
from orogena.llm.queries import vocabulary
from orogena.llm.token_counts import length_histogram, quantiles, truncated_totals

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_matches_the_library(odd, odd_rows, library):
    got = Counter(tuple(r) for r in bpe_round_trip(odd, vocabulary()).collect())
    assert got == Counter((r[0], *expected(library, r[1])) for r in odd_rows)


def test_matches_the_library_on_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert {r[0]: tuple(r)[1:] for r in bpe_round_trip(docs, vocabulary()).collect()} == {r.doc_id: expected(library, r.text) for r in rows}


def test_every_character(library):
    bpe = loaded(vocabulary())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for at in range(0, len(chars), 5_000):
        text = "".join(f"a{c}1 {c}{c} b" for c in chars[at : at + 5_000])
        assert bpe.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_and_runs(library):
    random.seed(3)
    bpe = ByteBpe(vocabulary())
    for text in ["a" * 5_000, "ab" * 400 + " " * 900, "the" * 17, "é" * 100, "".join(random.choices("abcdefgh", k=3_000)), "x" * 47, "x" * 48, "x" * 49]:
        assert bpe.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.encode_batch(["x " * 600_000])[0].tolist() == library.encode("x " * 600_000, add_special_tokens=False).ids


def test_memo_is_bounded(monkeypatch, library):
    monkeypatch.setattr("orogena.llm.bpe.MEMO", 5)
    bpe = ByteBpe(vocabulary())
    for text in ["one two three four", "five six seven eight", "one nine ten eleven twelve"]:
        assert bpe.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_then_decode(odd, odd_rows):
    got = Counter((r.doc_id, r.text) for r in decode(encode(odd, vocabulary()), vocabulary()).collect())
    assert got == Counter((r[0], r[1] or "") for r in odd_rows)


def test_empty_and_clashing(none, clashing):
    assert bpe_round_trip(none, vocabulary()).count() == 0 == length_histogram(none, vocabulary()).count()
    assert bpe_round_trip(clashing, vocabulary()).count() == 6


def test_length_histogram(spark, odd, odd_rows, library):
    sizes = [expected(library, r[1])[0] for r in odd_rows]
    sums = length_histogram(odd, vocabulary())
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.docs for k, r in rows.items()} == Counter(sizes)
    for k, r in rows.items():
        assert r.docs_at_least == sum(n >= k for n in sizes)
        assert r.tokens_at_least == sum(n for n in sizes if n >= k)
        assert r.truncated_tokens == sum(min(n, k) for n in sizes)
        assert (r.all_docs, r.all_tokens) == (len(sizes), sum(sizes))
    limits = [0, 1, 5, 100, 129, 10**9]
    got = {r.context_limit: (r.tokens_kept, r.tokens_cut) for r in truncated_totals(sums, spark.createDataFrame([(x,) for x in limits], "context_limit long")).collect()}
    assert got == {x: (sum(min(n, x) for n in sizes), sum(max(0, n - x) for n in sizes)) for x in limits}
    assert {r.share: r.n_tokens for r in quantiles(sums, [0.0, 0.5, 1.0]).collect()} == {0.0: min(sizes), 0.5: sorted(sizes)[7], 1.0: max(sizes)}
