from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orogena.llm import line_dedup
from orogena.llm.common import dealt_pairs
from orogena.llm.line_dedup import BANDS, LEAST, TAKEN, bands_of, least_in_common, line_duplicates, may_be_like, may_be_near, met_under_one_key, parities, shingles, signature, signatures, without_line_copies


def set_of(line):
    """All runs of seven characters; a shorter line is one."""
    return {line[i : i + 7] for i in range(max(1, len(line) - 6))}


def brute(rows):
    """(doc_id, line_no) -> place that stays, by all pairs of distinct lines."""
    lines = {}
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            lines.setdefault(x, []).append((d, k))
    names = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    s = {x: set_of(x) for x in names}
    up = {x: x for x in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for x in names:
        for g in s[x]:
            by.setdefault(g, []).append(x)
    seen = set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    n = len(s[a] & s[b])
                    if 100 * n >= 80 * (len(s[a]) + len(s[b]) - n):
                        up[root(a)] = root(b)
    first = {}
    for x in names:
        first[root(x)] = min(first.get(root(x), (float("inf"), 0)), min(lines[x]))
    return {p: first[root(x)] if x in up else p for x, at in lines.items() for p in at}


def test_matches_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_duplicates(docs).collect()}
    assert got == want


def test_fuzzy_groups(spark):
    random.seed(8)
    base = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen and jack"
    rows = []
    for i in range(80):
        line = list(base)
        for at in random.sample(range(len(base)), random.choice([0, 1, 1, 2])):
            line[at] = random.choice("XYZQ")
        rows.append((i, "\n".join(["", "".join(line), f"own line {i * 7919} {random.random()}"])))
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, odd, odd_rows, none, clashing):
    got = line_duplicates(odd).collect()
    assert len(got) == sum((r[1] or "").count("\n") + 1 for r in odd_rows)
    stays = {(r.doc_id, r.line_no) for r in got if r.kept}
    assert (1, 0) in stays and (3, 0) not in stays and (4, 0) in stays and (6, 0) in stays and (7, 0) in stays
    assert sum(not r.kept for r in got if r.doc_id == 2) == 2
    assert line_duplicates(none).count() == 0
    assert {(r.doc_id, r.keep_doc_id) for r in line_duplicates(clashing).collect()} == {(i, i % 3) for i in range(6)}
    out = {r.doc_id: r.text for r in without_line_copies(clashing).collect()}
    assert out[0] and not out[3]
    assert without_line_copies(odd).count() == len(odd_rows)


def pair_rows(pairs):
    return [(2 * i + k, f"{text}") for i, pair in enumerate(pairs) for k, text in enumerate(pair)]


def linked(spark, pairs):
    """Of pairs of lines, how many are linked."""
    got = {r.doc_id: r.keep_doc_id for r in line_duplicates(spark.createDataFrame(pair_rows(pairs), "doc_id long, text string")).collect()}
    return sum(got[2 * i] == got[2 * i + 1] for i in range(len(pairs)))


def test_lines_of_few_long_words_and_of_more_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(13))
    pairs = [(x, x + " a b c") for x in (" ".join(word() for _ in range(7)) for _ in range(20))]
    assert linked(spark, pairs) == 20


def test_short_lines_that_share_four_of_five_runs(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 1)) + "z"
    pairs = [(x, x + rng.choice("abc")) for x in (text(10) for _ in range(300))]
    assert linked(spark, pairs) == 300


@pytest.mark.parametrize("sizes", [range(2, 23), (24, 26, 30, 32, 33, 40), (60, 100, 200, 400)])
def test_bands_meet_at_every_size(spark, sizes):
    """Sets of any sizes at a similarity of just 0.8 share a band."""
    rng = random.Random(5)
    rows = []
    for u in sizes:
        for k in range(120):
            union = sorted(rng.randrange(-(1 << 63), 1 << 63) for _ in range(u))
            rng.shuffle(union)
            apart = u // 5
            left = rng.randint(0, apart)
            a, b = union[: u - left], union[: u - apart] + union[u - left :]
            rows.append((u, k, sorted(a), sorted(b)))
    frame = spark.createDataFrame(rows, "u int, k int, a array<long>, b array<long>")
    met = frame.select("u", (F.size(F.array_intersect(bands_of(F.col("a")), bands_of(F.col("b")))) > 0).alias("met")).groupBy("u").agg(F.avg(F.col("met").cast("int")).alias("recall")).collect()
    for r in met:
        assert r.recall == 1 if r.u <= BANDS + 2 else r.recall >= 0.98, (r.u, r.recall)


def test_runs_of_characters(spark):
    rng = random.Random(6)
    lines = ["", "a", "abcdef", "abcdefg", "é字" * 40, "x" * 300, *["".join(rng.choice("ab字é ") for _ in range(n)) for n in (69, 70, 71, 134, 135, 5000)]]
    own = spark.createDataFrame([(i, x, sorted(set_of(x))) for i, x in enumerate(lines)], "i int, line string, runs array<string>")
    want = F.array_sort(F.transform("runs", lambda x: F.xxhash64(x)))
    assert own.where(shingles(F.col("line")) != want).count() == 0


def test_rows_are_numbered_once(spark):
    docs = spark.createDataFrame([(i % 50, f"own line {i} {i * 7919}\nthe same long line of many words here") for i in range(400)], "doc_id long, text string").repartition(7, "text").repartition(5)
    out = [r.text for r in without_line_copies(docs).collect()]
    assert sum("the same" in x for x in out) == 1 and sum("own line" in x for x in out) == 400


def test_runs_of_wide_characters(spark):
    rng = random.Random(7)
    lines = ["é" * 7, "a😀b😀cdefgh😀", "😀" * 40, *["".join(rng.choice(abc) for _ in range(n)) for abc in ("abc", "abé", "ab字😀") for n in (6, 7, 8, 262, 263, 600)]]
    own = spark.createDataFrame([(i, x, sorted(set_of(x))) for i, x in enumerate(lines)], "i int, line string, runs array<string>")
    assert own.where(shingles(F.col("line")) != F.array_sort(F.transform("runs", lambda x: F.xxhash64(x)))).count() == 0


def test_parities_rule_out_unlike_lines_alone(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        line = [rng.choice("abcdefgh ijklé") for _ in range(rng.choice([8, 12, 40, 200, 900]))]
        other = [rng.choice("xyz") if rng.random() < rng.choice([0, 0.01, 0.03, 0.2]) else c for c in line]
        rows += [(2 * i, "".join(line)), (2 * i + 1, "".join(other))]
    own = {r.id: r.bits for r in parities(spark.createDataFrame(rows, "id long, line string")).collect()}
    sets = {i: set_of(x) for i, x in rows}
    pairs = [(a, b, own[a], own[b], len(sets[a]), len(sets[b])) for a, b in [(2 * i, 2 * i + 1) for i in range(300)] + [(2 * i, 2 * i + 2) for i in range(299)]]
    frame = spark.createDataFrame(pairs, "a long, b long, x array<long>, y array<long>, an long, bn long")
    may = {(r.a, r.b) for r in frame.where(may_be_like(F.col("x"), F.col("y"), F.col("an"), F.col("bn"), 80)).collect()}
    like = {(a, b) for a, b, *_ in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert like <= may and len(may) < len(like) + 60 and len(like) > 30


def test_texts_travel_only_where_signatures_call_for_them(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    lines = [" ".join(word() for _ in range(30)) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"{x}\n{x}" + " tail" * (i < 10)) for i, x in enumerate(lines)], "doc_id long, text string")
    written, stash = [], line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df, name, **options: written.append((name, stash(df, name, **options))) or written[-1][1])
    assert line_duplicates(docs).where("NOT kept").count() == 300
    assert sum(df.count() for _, df in written if "line" in df.columns) < 60


def test_signatures_are_the_least_of_all_runs(spark):
    rng = random.Random(10)
    lines = ["a", "abcdefgh", "ab" * 60, "-" * 500, "é字😀" * 9, *["".join(rng.choice(abc) for _ in range(n)) for n in (8, 20, 38, 39, 200, 3000) for abc in ("abcdefghijkl ", "abé字 ", "a😀bcdef")]]
    hexed = [x.encode().hex() for x in lines] + [bytes(rng.choice(b"abc\xff\xc3\xe5\xf0 ") for _ in range(n)).hex() for n in (8, 60, 400)]
    named = spark.createDataFrame([(i, x) for i, x in enumerate(hexed)], "h1 long, x string").select("h1", F.col("h1").alias("h2"), F.unhex("x").cast("string").alias("line"))
    want = {r.h1: (r.h, r.n) for r in named.select("h1", signature(F.col("line")).alias("h"), F.size(shingles(F.col("line"))).alias("n")).collect()}
    got = {r.h1: r for r in signatures(named).collect()}
    assert set(got) == set(want) == set(range(len(hexed)))
    assert all(got[i].h == want[i][0] and len(got[i].h) == min(LEAST, want[i][1]) for i in got if got[i].whole)
    assert not got[2].whole and not got[3].whole and sum(r.whole for r in got.values()) > len(hexed) // 2 and TAKEN > LEAST


def test_odd_lines_are_linked(spark):
    rows = [(0, b"-" * 80), (1, b"-" * 95), (2, b"ab" * 90), (3, b"ba" * 100), (4, "naïve ".encode() * 3 + b"one broken \xff byte in a line of many words here"), (5, "naïve ".encode() * 3 + b"one broken \xff byte in a line of many words here.")]
    rows += [(6, "😀 an emoji in front of a line that says the same".encode()), (7, b"- an emoji in front of a line that says the same")]
    docs = spark.createDataFrame([(i, x.hex()) for i, x in rows], "doc_id long, x string").select("doc_id", F.unhex("x").cast("string").alias("text"))
    assert {r.doc_id: r.keep_doc_id for r in line_duplicates(docs).collect()} == {i: i // 2 * 2 for i in range(8)}


@pytest.mark.parametrize("sizes", [range(1, 23), (30, 60, 200, 400)])
def test_signatures_rule_out_no_like_sets(spark, sizes):
    rng = random.Random(11)
    assert least_in_common(80) == 5
    rows = []
    for u in sizes:
        for _ in range(150):
            union = [rng.randrange(-(1 << 31), 1 << 31) for _ in range(u)]
            left = rng.randint(0, u // 5)
            rows.append((sorted(union[: u - left])[:LEAST], sorted(union[: u - u // 5] + union[u - left :])[:LEAST]))
    frame = spark.createDataFrame(rows, "a array<int>, b array<int>")
    assert frame.where(may_be_near(F.col("a"), F.col("b"), 80)).count() == len(rows)
    unlike = spark.createDataFrame([([rng.randrange(100) for _ in range(LEAST)], [100 + rng.randrange(100) for _ in range(LEAST)])], "a array<int>, b array<int>")
    assert unlike.where(may_be_near(F.col("a"), F.col("b"), 80)).isEmpty()


def families(rng, groups, copies):
    """Lines of groups of copies, of which each has some words of its own."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = []
    for _ in range(groups):
        base = [word() for _ in range(40)]
        for _ in range(copies):
            own = list(base)
            for at in rng.sample(range(40), rng.randint(1, 5)):
                own[at] = word()
            lines.append(" ".join(own))
    return lines


def test_lines_are_cut_again_only_where_parities_allow(spark, monkeypatch):
    rng = random.Random(12)
    rows = list(enumerate(families(rng, 4, 30)))
    sets = [set_of(x) for _, x in rows]
    like = {(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    written, stash = [], line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df, name, **options: written.append((name, stash(df, name, **options))) or written[-1][1])
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    compared = sum(df.count() for name, df in written if name == "likely")
    assert len(like) > 60 and compared < 1.5 * len(like)


def test_a_pair_of_a_block_meets_under_one_key(spark):
    lines = spark.createDataFrame(list(enumerate(families(random.Random(13), 1, 30))), "id long, line string")
    keys = lines.select("id", F.explode(bands_of(signature(F.col("line")))).alias("key"))
    members = parities(lines).join(keys.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    rows = keys.join(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key").select("key", "id", F.col("id").alias("own"))
    few, all_ = dealt_pairs(rows)
    met = met_under_one_key(few.join(members, "id"), all_.join(members, "id"), 80).groupBy("a", "b").count().collect()
    like = may_be_like(F.col("x.bits"), F.col("y.bits"), F.col("x.n"), F.col("y.n"), 80) & (F.size(F.array_intersect("x.keys", "y.keys")) > 0)
    want = members.alias("x").join(members.alias("y"), (F.col("x.id") < F.col("y.id")) & like).select("x.id", "y.id").collect()
    assert {(r.a, r.b) for r in met} == {tuple(r) for r in want} and len(want) >= 20
    assert max(r["count"] for r in met) <= 2
