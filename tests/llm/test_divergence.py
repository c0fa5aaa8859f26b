from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orogena.llm.divergence import counted_terms, source_divergence, term_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(text or "")]


def brute(rows, least=30, top=50):
    """All shares of all sources, term by term."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        n[g].update(terms_of(text))
        docs[g[0]].update(set(terms_of(text)))
    out = []
    for lang in {g[0] for g in groups}:
        own = sorted(g for g in groups if g[0] == lang)
        kept = [t for t, d in docs[lang].items() if d >= least]
        v = len(kept)

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * v) for t in kept}

        p = {g: share(n[g]) for g in own}
        q = share(sum((n[g] for g in own), Counter()))
        for g in own:
            pairs = [(sum(abs(p[g][t] - p[o][t]) for t in kept), o[1]) for o in own if o != g]
            lead = [(p[g][t] - q[t], t) for t in kept if n[g][t] and p[g][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", lead, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(*g, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return Counter(out)


def found(docs, **options):
    return Counter(tuple(r) for r in source_divergence(docs, **options).collect())


def random_rows(n, langs, sources, seed):
    rng = random.Random(seed)
    pool = ["Alpha", "beta", "GAMMA", "délta", "Épsilon", "字", "zeta-eta", "x_y", "theta9iota", "q"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    return [(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))), rng.choice(langs), rng.choice(sources)) for _ in range(n)]


@pytest.mark.parametrize("shape", [{}, {"block": 40}, {"block": 25, "tile": 3}, {"tile": 1}])
def test_matches_brute_force(spark, shape):
    rows = random_rows(500, ["en", "de", None], ["a", "b", "c", "d", "é", "", None, "h", "i"], 3)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert found(docs, least_docs=12, top=9, **shape) == brute(rows, 12, 9)


def test_groups_without_terms(spark):
    rows = [("a b", "en", "s")] * 31 + [(None, "en", "t"), ("1 2", "en", None), ("", "fr", "s"), (None, "fr", "t"), ("rare", None, "s"), ("a " * 90_000, "en", "t")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = found(docs)
    assert got == brute(rows)
    assert got["fr", "s", "pair", "t", 0, 1] == 1


def test_odd_tables(spark, odd, odd_rows, none, clashing):
    assert source_divergence(none).count() == 0
    assert found(odd, least_docs=2) == brute([(r[1], r[2], r[3]) for r in odd_rows], 2)
    rows = [(r.text, r.lang, r.source) for r in clashing.collect()]
    more = clashing.selectExpr("*", "'x' AS term", "'y' AS tile", "'z' AS p")
    assert found(more, least_docs=1) == brute(rows, 1)


def test_counts_of_a_slice():
    run = [b"One two-ONE", b"", "naïve One 9".encode(), b"two"]
    g, term, n, docs = counted_terms(run, np.array([0, 0, 1, 1]), hashes=lambda b, s, e: np.zeros(len(s), np.uint64))
    assert sorted(zip(g.tolist(), term.to_pylist(), n.tolist(), docs.tolist())) == [(0, "one", 2, 1), (0, "two", 1, 1), (1, "naïve", 1, 1), (1, "one", 1, 1), (1, "two", 1, 1)]
    assert [len(x) for x in counted_terms([b"", b"12"], np.array([0, 1]))] == [0, 0, 0, 0]


def test_counts_over_tasks(spark):
    rows = random_rows(3000, ["en"], ["a", "b"], 9)
    got = {(r.source, r.term): (r.n, r.docs) for r in term_counts(spark.createDataFrame(rows, "text string, lang string, source string")).collect()}
    want = defaultdict(lambda: [0, 0])
    for text, _, source in rows:
        for t, k in Counter(terms_of(text)).items():
            want[source, t][0] += k
            want[source, t][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
