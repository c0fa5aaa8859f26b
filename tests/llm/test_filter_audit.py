from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash

from orogena.llm.filter_audit import byte_classes, distinct_words, filter_audit, scanned, text_facts
from orogena.llm.kernels import span_array, span_classes, word_spans, xxh64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    """The letters of the filters that each row (doc_id, text, part) fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = WORD.findall(t)
        checks = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i)
        out.append("".join(x for x, c in zip("ABCDE", checks) if c))
    return out


def brute(rows, labels):
    """Every order applied to the rows one by one."""
    fails, out = failing(rows), []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for row, f in zip(rows, fails):
        parts[row[2] or ""].append((row[0], f))
    for part, members in parts.items():
        shares, lines = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = members
            for k, x in enumerate(order):
                gone = [m for m in left if x in m[1]]
                redundant = sum(x in m[1] for m in members) - len(gone)
                left = [m for m in left if x not in m[1]]
                shares[x] += len(gone)
                alone = sum(m[1] == x for m in members)
                lines.append((x, part, order, k + 1, len(left), len(gone), redundant, alone, sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)))
        out += [(*line[1:], shares[line[0]]) for line in lines]
    return Counter(out)


def ask(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return Counter(tuple(r) for r in filter_audit(docs, said).collect())


def rows_of_all_kinds():
    plain = " ".join(f"w{i}" for i in range(250))
    texts = [plain, plain, "few words", None, "", "SHOUTED words", "a # b", plain + " A B C " * 40, "same " * 300, "same " * 299 + "&", plain + " x", "é " * 200 + "É", " \n\t ", "x" * 70_000 + " #", plain]
    return [(k, t, ["a", "b", None][k % 3]) for k, t in enumerate(texts)] + [(3, plain, "a"), (3, plain, "a"), (None, plain, "b"), (None, None, None)]


LABELS = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, 1, None), (3, 0, 1), (5, None, None), (None, 1, 1), (77, 1, 1), (14, 1, 0)]


def test_matches_the_filters_one_by_one(spark):
    rows = rows_of_all_kinds()
    assert ask(spark, rows, LABELS) == brute(rows, LABELS)


def test_odd_tables(spark, odd, odd_rows, none, clashing):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit(none, labels).count() == 0
    got = Counter(tuple(r) for r in filter_audit(odd, labels).collect())
    assert got == brute([(r[0], r[1], r[3]) for r in odd_rows], LABELS)
    assert filter_audit(clashing, labels.limit(0)).where("step = 1").agg({"kept": "sum"}).collect()[0][0] is not None
    more = labels.selectExpr("*", "'x' AS mask", "'y' AS digest", "'z' AS part")
    assert Counter(tuple(r) for r in filter_audit(odd, more).collect()) == got


def test_counts_of_a_text(spark):
    texts = ["", "one", "A bB\u0085C \x0b d", "naïve 数字 数字 A", "x" * 40 + " " + "x" * 40 + " " + "x" * 39 + "y", "a " * 70_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.n_distinct, r.n_capitals, r.n_symbols, r.n_points) for r in text_facts(docs).collect()}
    want = {i: (len(w := WORD.findall(t)), len(set(w)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t)) for i, t in enumerate(texts)}
    assert got == want


def test_scan_of_random_texts():
    rng = np.random.default_rng(5)
    pool = [b"a", b"b", b" ", b"\n", b"#", b"Z", "é".encode(), "字".encode()]
    run = [b"".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 60))) for _ in range(500)]
    found = scanned(run, byte_classes("#$%&*|"))
    for k, x in enumerate(run):
        t = x.decode()
        w = WORD.findall(t)
        assert [found[c][k] for c in ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")] == [len(w), len(set(w)), t.count("Z"), t.count("#"), len(t)]


@pytest.mark.parametrize("weak", [lambda b, s, e: np.zeros(len(s), np.uint64), lambda b, s, e: ((e - s).astype(np.uint64) % np.uint64(3)) << np.uint64(60)])
def test_collisions_are_settled_by_bytes(weak):
    run = [b"aa bb aa cc", b"", b"bb bb bb", b"aa ab aa ba ccc"]
    buf = np.frombuffer(b"\n".join([*run, b""]), np.uint8)
    starts, ends = word_spans(buf)
    edges = np.cumsum([0] + [len(x) + 1 for x in run])
    owner = np.searchsorted(edges, starts, side="right") - 1
    assert distinct_words(buf, starts, ends, owner, 4, weak).tolist() == [3, 0, 1, 4]


def test_xxh64_is_the_published_hash():
    rng = np.random.default_rng(7)
    buf = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4800, 800)
    ends = starts + rng.integers(0, 200, 800)
    assert xxh64(buf, starts, ends).tolist() == [xxhash.xxh64_intdigest(buf[s:e].tobytes()) for s, e in zip(starts, ends)]
    assert xxh64(buf, np.array([5000]), np.array([5000])).tolist() == [xxhash.xxh64_intdigest(b"")]


def test_classes_of_spans():
    buf = np.frombuffer(b"abcdefgh-abcdefgh-abcdefgx-abcdefghabcdefgh-", np.uint8)
    starts, ends = np.array([0, 9, 18, 27, 0]), np.array([8, 17, 26, 43, 0])
    order, first = span_classes(buf, starts, ends, np.zeros(5, np.uint64))
    groups = [sorted(order[a:b].tolist()) for a, b in zip(first, [*first[1:], 5])]
    assert sorted(groups) == [[0, 1], [2], [3], [4]]
    assert span_array(buf, starts, ends).to_pylist() == ["abcdefgh", "abcdefgh", "abcdefgx", "abcdefghabcdefgh", ""]
