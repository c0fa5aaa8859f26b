"""Every query with an oracle gives the oracle's rows on the smallest tables."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path

import pytest

from orogena import catalogue

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_the_oracle(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = oracle.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_without_an_oracle_is_tested_elsewhere():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"balanced_areas", "contour_lines", "repair_verdicts"}
