from __future__ import annotations

import zlib

from conftest import SCHEMA

from orogena.llm.quality import score, train, training_rows


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score(docs, train(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    told = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(told) > 40
    assert sum(q == x.predicted for q, x in told) / len(told) >= 0.95


def test_learns_from_the_other_rows_only(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = training_rows(docs, labels, "quality", 20, "doc_id", "text").collect()
    assert rows and all(zlib.crc32(str(r.id).encode()) % 5 for r in rows)
    assert max(sum(r.y == y for r in rows) for y in (0, 1)) <= 20


def test_odd_rows(spark, odd, odd_rows, none, clashing):
    labels = spark.createDataFrame([(1, 1), (3, 1), (10, 0), (11, 0), (None, 1), (2, None), (4, 0), (5, 1)], "doc_id long, quality int")
    model = train(odd, labels)
    got = score(odd, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert score(none, model).count() == 0
    assert score(clashing, model).count() == 6
    blank = train(none, labels.limit(0))
    assert [r.score for r in score(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), blank).collect()] == [0.5]


def test_long_texts_score_as_their_parts(spark, odd):
    from orogena.llm.kernels import SLICE

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    text = b"some plain words " * 100_000
    assert len(text) > SLICE
    assert abs(model.scores([text])[0] - model.scores([b"some plain words " * 50_000])[0]) < 1e-3
