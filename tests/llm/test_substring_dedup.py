from __future__ import annotations

import numpy as np
from conftest import make_text

from orogena.llm.kernels import mix, span_hashes, word_spans
from orogena.llm.substring_dedup import LEAST, SPREAD, WINDOW, chunked, grown, repeated_spans, without_repeats


def boundary_words(text: str) -> set[tuple[int, int]]:
    """(first word, word after the last) of each chunk, by looking at each stretch of words by itself."""
    words = text.split()
    buf = text.encode()
    starts, ends = word_spans(np.frombuffer(buf, np.uint8))
    value = span_hashes(np.frombuffer(buf, np.uint8), starts, ends).tolist()
    h = [None if i < WINDOW - 1 else int(mix(np.array([sum(value[i - k] << k for k in range(WINDOW)) & (1 << 64) - 1], np.uint64))[0]) for i in range(len(words))]
    peak = {s: max(range(s, s + SPREAD), key=lambda i: (h[i], -i)) for s in range(WINDOW - 1, len(words) - SPREAD + 1)}
    return {(i, peak[i + LEAST]) for i in peak.values() if i + LEAST in peak}


def chunk_words(text: str) -> set[tuple[int, int]]:
    c = chunked([text.encode()])
    return set(zip(c.chunk.tolist(), c.until.tolist()))


def test_boundaries_are_those_of_the_rolling_hash():
    for text in (make_text(1, 400), "é— 数字 " * 60, "orre " * 70, "", "a"):
        assert chunk_words(text) == boundary_words(text)
    both = chunked([make_text(1, 60).encode(), make_text(2, 60).encode()])
    assert set(zip(both.chunk.tolist(), both.until.tolist())) == chunk_words(make_text(1, 60)) | {(i + 60, j + 60) for i, j in chunk_words(make_text(2, 60))}


def test_insertion_moves_no_other_boundary():
    words = make_text(3, 500).split()
    a, b = chunk_words(" ".join(words)), chunk_words(" ".join([*words[:200], "inserted", *words[200:]]))
    assert {x for x in a if x[1] < 180} <= b and {(i + 1, j + 1) for i, j in a if i > 225} <= b


def test_every_passage_of_48_words_holds_a_chunk():
    for seed in range(40):
        passage = make_text(seed, 48)
        texts = [f"{make_text(100 + seed, 60)} {passage} {make_text(200 + seed, 60)}", f"{make_text(300 + seed, 30)} {passage} {make_text(400 + seed, 90)}"]
        (x, y) = ({(i - n, j - n) for i, j in chunk_words(t) if i >= n and j <= n + 48} for t, n in zip(texts, (60, 30)))
        assert x & y


def test_planted_passages_are_found_and_others_left_alone(spark):
    """Passages of 51 words in texts of their own; shorter ones and texts without one stay out."""
    rows, want = [], set()
    for k in range(60):
        passage = make_text(5_000 + k, 51)
        for j in range(2 + k % 3):
            i = k * 10 + j
            rows.append((i, f"{make_text(i, 30 + j * 7)} {passage} {make_text(9_000 + i, 20)}"))
            want.add(i)
    short = make_text(7_777, 40)
    rows += [(10_000 + i, f"{make_text(20_000 + i, 40)} {short} {make_text(30_000 + i, 40)}") for i in range(30)]
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == want
    texts = dict(rows)
    for r in got:
        assert r.n_words > 50 and len(texts[r.doc_id].encode()[r.start : r.end].split()) >= 51 - 1
        assert r.kept == (r.doc_id == r.first_doc_id)


def test_copies_lose_their_text_and_first_places_stay(spark):
    rows = [(i, make_text(i % 2, 200)) for i in range(6)] + [(7, make_text(70, 90))]
    out = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(out[i] == texts[i] for i in (0, 1, 7))
    assert all(len(out[i]) < 120 for i in (2, 3, 4, 5))


def test_grown():
    assert grown(b"xxabcdyy", 3, b"zabcdyq", 2, 2) == (1, 2)
    assert grown(b"abc", 0, b"abd", 0, 3) is None


def test_odd_rows(odd, none, clashing):
    got = repeated_spans(odd).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, None, 8, 9}
    assert repeated_spans(none).count() == 0
    assert repeated_spans(clashing, words=8).count() >= 3
    assert sorted(str(r.doc_id) for r in without_repeats(odd).collect()) == sorted(str(r.doc_id) for r in odd.collect())


def windows_brute(rows, words=50):
    """(row, byte) pairs that a repeat covers, and those of repeats that stand elsewhere first, by all windows of words."""
    import re
    from collections import defaultdict

    places = defaultdict(list)
    for i, text in sorted(rows):
        spans = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text.encode())]
        for k in range(len(spans) - words):
            s, e = spans[k][0], spans[k + words][1]
            places[text.encode()[s:e]].append((i, s, e))
    covered, gone = set(), set()
    for found in places.values():
        for i, s, e in found if len(found) > 1 else []:
            if (i, s) == found[0][:2] or i != found[0][0] or s >= found[0][2]:
                covered |= {(i, x) for x in range(s, e)}
                if (i, s) != found[0][:2]:
                    gone |= {(i, x) for x in range(s, e)}
    return covered, gone


def test_phrases_of_other_texts_hide_no_passage_and_make_none(spark):
    """Every phrase of a passage stands in an earlier text; texts chained from such phrases repeat nothing."""
    passage = [make_text(500 + k, 12) for k in range(8)]
    rows = [(k, f"{make_text(100 + k, 30)} {p} {make_text(200 + k, 30)}") for k, p in enumerate(passage)]
    rows += [(20 + j, f"{make_text(300 + j, 40)} {' '.join(passage)} {make_text(400 + j, 40)}") for j in range(3)]
    rows += [(30 + j, " ".join(p + f" x{j}y" for p in passage[:: 1 - 2 * (j % 2)])) for j in range(4)]
    rows += [(40, " ".join([make_text(600, 70), make_text(601, 30), make_text(600, 70)])), (41, make_text(602, 50) + " " + make_text(600, 51))]
    rows += [(50 + j, " ".join("abcdefghijklmnopqrstuvwxyz"[(k * k + k // 7) % 26] for k in range(60)) + f" {j}") for j in range(2)]
    rows += [(60, "orre " * 2_000), (61, "orre " * 300 + make_text(603, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeated_spans(docs).collect()
    assert sum(r.doc_id in (60, 61) for r in got) < 6
    covered, gone = windows_brute(rows)
    texts = {i: t.encode() for i, t in rows}
    assert {(r.doc_id, x) for r in got for x in range(r.start, r.end)} == covered
    assert {(r.doc_id, x) for r in got if not r.kept for x in range(r.start, r.end)} == gone
    for r in got:
        assert texts[r.doc_id][r.start : r.end] == texts[r.first_doc_id][r.first_start : r.first_start + r.end - r.start]
        assert r.n_words == len(texts[r.doc_id][r.start : r.end].split()) > 50
    left = " ".join(r.text for r in without_repeats(docs).collect())
    assert " ".join(passage) in left
