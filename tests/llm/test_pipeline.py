from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest import SCHEMA, make_text
from test_near_dedup import brute

import corpus_pipeline
import orogena.llm.common as common
from orogena.llm.quality import score, train
from orogena.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


def after(rows):
    """What the stages after the classifier leave of (doc_id, text), in plain Python: doc_id -> n_tokens and digests."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t or "", i)
    alone = [(i, t) for i, t in rows if first[t or ""] == i]
    links = brute(alone, 5)
    library = tokenizers.Tokenizer.from_file(vocabulary())
    out = {}
    for i, t in alone:
        if links[i][1] == i:
            ids = library.encode(t or "", add_special_tokens=False).ids
            out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    return out


def test_run_matches_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in score(docs, train(docs, labels)).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    assert 0 < len(rows) < docs.count()
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == after(rows)


def test_labelled_good_documents_stay(spark):
    """Held-out documents that are labelled good pass the classifier."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, data).select("doc_id").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & kept) / len(good) >= 0.99


def test_stages_keep_the_columns(spark, none):
    odd = spark.createDataFrame([(1, make_text(1, 50), "en", "a", 1), (2, None, None, None, None), (3, make_text(1, 50), "en", "a", 1), (None, "x", "en", "a", 1)], SCHEMA)
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
    kept = corpus_pipeline.near_copies(spark, corpus_pipeline.exact_copies(spark, odd, DATA), DATA)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]


def test_the_mix_is_the_order_of_the_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sources = [r.source for r in corpus_pipeline.mixing(spark, docs, DATA).collect()]
    assert len(sources) == docs.count()
    assert sources[:10] == [sources[0]] * 10  # 200 documents of 20 sources: a block holds a whole source


def test_near_copies_leave_one_row_whatever_ids_repeat(spark):
    base = make_text(1, 80)
    rows = [(5, base + " one"), (5, base + " two"), (None, base + " three"), (5, make_text(2, 80)), (None, make_text(3, 80)), (None, make_text(3, 80) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_copies(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "None"] and len({r.text[:60] for r in got}) == 3


def test_the_classifier_judges_rows_and_not_ids(spark):
    """Of rows that share an id, or have none, only those rejected go."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    marks = score(docs, train(docs, labels)).select("doc_id", "predicted").collect()
    told = {p: [m.doc_id for m in marks if m.predicted == p][:3] for p in (0, 1)}
    text = {r.doc_id: r.text for r in docs.collect()}
    more = [(i, text[k], "en", "a", 1) for i in (1_000_007, None) for p in (0, 1) for k in told[p]]
    every = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    out = corpus_pipeline.quality(spark, every, DATA)
    kept = {r.doc_id for r in out.collect()} - {None, 1_000_007}
    assert kept >= set(told[1]) and not kept & set(told[0])
    assert out.where("doc_id IS NULL").count() == out.where("doc_id = 1000007").count() == 3


@pytest.mark.parametrize("stage", range(5))
def test_odd_tables_in_every_stage(spark, odd, none, clashing, stage):
    name, run = corpus_pipeline.STAGES[stage]
    for docs in (odd, none, clashing):
        out = run(spark, docs, DATA)
        n = out.count()
        assert n <= docs.count(), name
        if stage in (3, 4):
            assert n == docs.count()
        if stage < 4:
            assert out.columns == docs.columns


def test_the_result_is_in_the_order_of_the_mix(spark, monkeypatch):
    """What the mixing stage gives first is encoded and given out first, however the files in between are read."""
    seen = []

    def mix(session, docs, sf_dir):
        rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
        seen.extend(r.doc_id for r in rows)
        return session.createDataFrame(session.sparkContext.parallelize(rows, 7), docs.schema)

    monkeypatch.setattr(corpus_pipeline, "mixing", mix)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, mix if n.startswith("mixing") else f) for n, f in corpus_pipeline.STAGES])
    got = [r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()]
    assert len(got) > 50 and got == seen


def test_documents_are_written_again_only_where_ids_do_not_tell_them_apart(spark, monkeypatch):
    written, stash = [], common.stash
    monkeypatch.setattr(common, "stash", lambda df, name, **options: written.append(name) or stash(df, name, **options))
    base = make_text(1, 80)
    texts = [base, base, base + " tail", make_text(2, 80), None, None]

    def left(ids, kind="long"):
        written.clear()
        docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in zip(ids, texts)], SCHEMA.replace("doc_id long", f"doc_id {kind}"))
        out = corpus_pipeline.near_copies(spark, corpus_pipeline.exact_copies(spark, docs, DATA), DATA)
        assert out.dtypes == docs.dtypes
        return sorted((str(r.doc_id), r.text or "") for r in out.collect()), "keyed" in written

    want = [("1", base), ("4", texts[3]), ("5", "")]
    assert left([1, 2, 3, 4, 5, 6]) == (want, False)
    assert left([1, 2, 3, 4, 5, 6], "int") == (want, True)
    assert left([1, 1, 2, 4, 5, 5]) == (want, True)
    assert left([1, None, None, 4, 5, None]) == (want, True)
