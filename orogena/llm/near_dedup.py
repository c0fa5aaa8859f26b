"""Near duplicates by circulant MinHash.

A document's shingles are placed on a ring of 2^32 by one permutation.  A second one ranks the places, and circular
shifts of it give every coordinate of the signature.  Bands of coordinates propose candidates: documents of equal shingle
sets are one class first, so copies cost one row each, and in a bucket each class meets a pivot, not every other.
Candidates are confirmed on their full shingle sets.  Components of the links so far tell which members of a
bucket are still apart; those meet further pivots and at last, in blocks, each member of another component, so no link
is lost for a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogena.llm.common import dealt_pairs, filter_bits, in_small_batches, key_filter, linked_components, shared_buckets, stash, through_filter
from orogena.llm.kernels import STEP, U, mix, slices, word_hashes

M = np.uint32
_RING = M(0x7FEB352D), M(0x846CA68B)  # fixed odd multipliers of the second permutation
#: Shingles that are worked on at a time.
_BLOCK = 2_048


@dataclass(frozen=True)
class NearParams:
    """Words in a shingle, least similarity in percent, and the banding.

    28 bands of 4 rows miss a pair at similarity 0.8 with a chance below 1 in 2 million.
    """

    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    pivots: int = 3


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of k consecutive words; fewer words are one shingle, none have none."""
    if not len(words):
        return words
    m = max(1, len(words) - k + 1)
    h = np.full(m, U(min(k, len(words))), np.uint64)
    for i in range(min(k, len(words))):
        h = mix(h * STEP + words[i : i + m])
    return np.unique(h)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least rank of the shingles' places, moved k places round the ring."""
    place = (mix(shingles) >> U(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), _BLOCK):
        x = place[None, at : at + _BLOCK] - shift
        x *= _RING[0]
        x ^= x >> M(15)
        x *= _RING[1]
        x ^= x >> M(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, p: NearParams, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set_a, set_b, bands): the number of shingles, two digests of their set, and a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for _, part in slices(batch.column(1)):
                for words in word_hashes(part):
                    s = shingle_hashes(words, p.words)
                    n.append(len(s))
                    a.append(int(np.add.reduce(s, dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    b.append(int(np.bitwise_xor.reduce(mix(s * STEP)).astype(np.int64)) if len(s) else 0)
                    if len(s):
                        sig = signature(s, p.bands * p.rows).astype(np.uint64).reshape(p.bands, p.rows)
                        h = np.arange(p.bands, dtype=np.uint64)
                        for r in range(p.rows):
                            h = mix(h * STEP + sig[:, r])
                        keys.append(h.astype(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "set_a", "set_b", "bands"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, set_a long, set_b long, bands array<long>")


def _shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def confirmed(pairs: DataFrame, docs: DataFrame, p: NearParams, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough.

    Texts of documents in no pair are left out by a bitmap before any exchange.  The pairs of one ``b`` are
    neighbours, so its set is made once for a run of them.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bits = filter_bits(ids.count())
    bitmap = stash(key_filter(ids, "id", bits), "filter")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    own = through_filter(texts, texts["id"], bitmap, bits)
    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, set()
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                b = batch.column(1)[i].as_py()
                if b != last:
                    last, of_last = b, _shingles(batch.column(3)[i].as_py().encode(), p.words)
                own = _shingles(batch.column(2)[i].as_py().encode(), p.words)
                both = len(own & of_last)
                keep.append(100 * both >= p.percent * (len(own) + len(of_last) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def confirmed_in_blocks(rows: DataFrame, docs: DataFrame, p: NearParams, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between members (key, id, n, own) of one bucket that are in different components.

    Of a bucket, the members outside its largest component meet all members.  Both sides are dealt into blocks, and a task compares a block with a block and returns the links alone.
    """
    few, all_ = dealt_pairs(rows)
    ids = rows.select("id").distinct()
    bits = filter_bits(ids.count())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    texts = through_filter(texts, texts["id"], stash(key_filter(ids, "id", bits), "filter"), bits)

    def meet(table: pa.Table) -> pa.Table:
        ids, own, few = (table[c].to_numpy() for c in ("id", "own", "few"))
        raw = [x.as_py().encode() for x in table["text"]]
        sets = [shingle_hashes(np.concatenate(word_hashes([x])), p.words) for x in raw]
        n = np.array([len(s) for s in sets])
        right = np.flatnonzero(~few)
        links: set[tuple[int, int]] = set()
        if len(right) and few.any():
            flat, starts = np.concatenate([sets[j] for j in right]), np.cumsum(n[right]) - n[right]
            for i in np.flatnonzero(few):
                x = sets[i]
                at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                both = np.add.reduceat((x[at] == flat).astype(np.int64), starts)
                for k in np.flatnonzero((100 * both >= p.percent * (n[i] + n[right] - both)) & (own[right] != own[i])):
                    j = right[k]
                    a, b = _shingles(raw[i], p.words), _shingles(raw[j], p.words)
                    m = len(a & b)
                    if 100 * m >= p.percent * (len(a) + len(b) - m):
                        links.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        pairs = sorted(links)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return few.withColumn("few", F.lit(True)).unionByName(all_.withColumn("few", F.lit(False))).join(texts, "id").groupBy("key", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, p: NearParams = NearParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable), kept, class_id.

    Documents of equal shingle sets share a class, named by its smallest id.  Documents without words are linked with
    nothing.  A null text counts as an empty one; a row with a null id is linked with nothing, keeps its null and
    is kept; rows that repeat an id belong to the same component; other columns are ignored; an empty table gives
    an empty result.
    """
    in_small_batches(docs)
    sigs = stash(signatures(docs, p, id_col, text_col), "signatures")
    full = sigs.where("n > 0 AND id IS NOT NULL")
    classes = stash(full.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("members")), "classes")
    first = full.join(classes, ["set_a", "set_b", "n"]).where("id = class_id").select(F.col("id"), F.col("n"), F.explode("bands").alias("key")).distinct()
    buckets = shared_buckets(stash(first, "buckets"))
    owner = linked_components(
        buckets, lambda pairs: confirmed(pairs, docs, p, id_col, text_col), lambda rows: confirmed_in_blocks(rows, docs, p, id_col, text_col), p.percent, p.pivots
    )
    got = classes if owner is None else classes.join(owner, classes["class_id"] == owner["node"], "left").select("set_a", "set_b", "n", "class_id", F.coalesce("component", "class_id").alias("component"))
    if owner is None:
        got = got.withColumn("component", F.col("class_id"))
    got = stash(got.select("set_a", "set_b", F.col("n").alias("size"), "class_id", "component"), "components")
    s = sigs.select("id", "n", "set_a", "set_b")
    linked = s.join(got, (s["set_a"] == got["set_a"]) & (s["set_b"] == got["set_b"]) & (s["n"] == got["size"]) & s["id"].isNotNull(), "left")
    component = F.coalesce("component", "id")
    return linked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.coalesce("class_id", "id").alias("class_id"))
