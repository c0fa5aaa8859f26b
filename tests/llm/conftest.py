from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch marsh north otter plume quartz ridge stone tarn".split()


def make_text(seed: int, n: int) -> str:
    """n words from a small linear generator; no two seeds give like texts."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % 20] + WORDS[(x >> 16) % 20])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, blanks, ties, repeats, a very long text."""
    long = make_text(99, 40_000)
    base = make_text(1, 60)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base + " extra", "en", None, 1),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "b", 3),
        (7, "one", "en", "b", 3),
        (None, base, "en", "c", 1),
        (None, None, None, None, None),
        (8, long, "en", "a", len(long)),
        (9, long + " tail", "en", "a", len(long)),
        (10, make_text(2, 30).upper(), "en", "a", 1),
        (11, make_text(2, 30), "en", "a", 1),
        (12, "naïve café — 数字 １２ <|endoftext|> don't\x85stop", "fr", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns named like those that operators return or use."""
    names = "doc_id text lang source n_chars id n keep_id kept key row digest score component_id position slot turn __word".split()
    rows = [(i, make_text(i % 3, 20), "en", "s", 5, *["x"] * (len(names) - 5)) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names[5:]))
