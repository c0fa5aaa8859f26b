from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orogena.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        stays = 1
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            kept = i == best and stays > 0
            stays -= kept
            out[i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_matches_brute_force(odd, odd_rows, keep):
    assert Counter(tuple(r) for r in exact_dedup(odd, keep=keep).collect()) == brute(odd_rows, keep)


def test_weak_digest_is_verified_by_bytes(odd, odd_rows):
    got = exact_dedup(odd, keep="largest", digest=lambda t: (F.crc32(t) % 3).cast("string"))
    assert Counter(tuple(r) for r in got.collect()) == brute(odd_rows, "largest")


def test_empty_and_clashing(none, clashing):
    assert exact_dedup(none).count() == 0
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(clashing).collect()}
    assert got == {i: (i % 3, 2) for i in range(6)}
    assert sorted(r.doc_id for r in drop_exact_copies(clashing).collect()) == [0, 1, 2]
    assert drop_exact_copies(clashing).columns == clashing.columns


def test_rows_repeated_whole_leave_one(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (2, "other"), (None, "n"), (None, "n"), (None, "m"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text or "") for r in drop_exact_copies(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "a b"), (1, "other"), (None, "n"), (None, "m"), (3, "")], key=str)
    assert sorted((r.doc_id for r in drop_exact_copies(docs.where("doc_id < 3"), keep="largest").collect())) == [1, 2]


def test_normalise(odd):
    got = exact_dedup(odd, normalise=F.lower).where("doc_id IN (10, 11)").select("keep_id").distinct().collect()
    assert [r.keep_id for r in got] == [10]


def test_matches_sql(spark):
    import duckdb

    from orogena.llm.queries import ORACLES, op1_exact_dedup

    duckdb_rows = duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'") or duckdb.sql(ORACLES["op1_exact_dedup"]).fetchall()
    assert Counter(tuple(r) for r in op1_exact_dedup(spark, "/root/testdata/sf0.001").collect()) == Counter(duckdb_rows)
