"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its features: its words and the n-grams of characters inside them, with a
word's ends marked, each hashed to one of 2^17 learned vectors, and a feature of its own for a word said twice running.
A softmax layer over that mean gives the score.  Training is stochastic gradient descent in numpy over a bounded sample
of the labelled rows; everything else runs over all rows in tasks.  As the layer is linear, a trained feature comes
down to one number, so tasks carry 2^17 numbers and scoring is a hash, a look-up and a mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogena.llm.common import in_small_batches
from orogena.llm.kernels import MIX2, STEP, U, cut, mix, slices

BUCKETS = 1 << 17
DIM = 12
NGRAMS = (3, 4)
#: Bound of the training sample: this many rows of each label.
SAMPLE = 2_000
EPOCHS = 6
RATE = 0.4
_TWICE = 0


def held_out(id_col: Column, remainder: int = 0) -> Column:
    """Whether crc32 of the id's text leaves the remainder modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == remainder, F.lit(False))


def features(run: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of all features of some texts, and for each the index of its text."""
    chars = np.frombuffer("\n".join(x.decode() for x in run).encode("utf-32-le"), np.uint32)
    sizes = [len(x.decode()) + 1 for x in run]
    own = np.repeat(np.arange(len(run)), sizes)[: len(chars)]
    blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
    c = np.concatenate([[0], np.where(blank, 0, chars), [0]]).astype(np.uint64)  # a blank before and after all
    inner = np.concatenate([[False], ~blank, [False]])
    for n in NGRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h, ok = np.full(m, n, np.uint64), np.ones(m, bool)
        for k in range(n):
            h = h * STEP + c[k : k + m]
            if 0 < k < n - 1:
                ok &= inner[k : k + m]
        at = np.flatnonzero(ok)
        yield (mix(h[at]) >> U(47)).astype(np.int64), own[at]
    edge = np.diff(inner.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if len(starts):
        h = np.add.reduceat(mix(c + STEP) * inner * mix(_within(len(c), starts)), starts)
        h = mix(h + (ends - starts).astype(np.uint64) * MIX2)
        yield (h >> U(47)).astype(np.int64), own[starts - 1]
        again = np.flatnonzero((h[1:] == h[:-1]) & (own[starts[1:] - 1] == own[starts[:-1] - 1])) + 1
        yield np.full(len(again), _TWICE), own[starts[again] - 1]


def _within(n: int, starts: np.ndarray) -> np.ndarray:
    """Each place's distance from the last start at or before it; places before the first count from 0."""
    at = np.arange(n, dtype=np.uint64)
    base = np.zeros(n, np.uint64)
    base[starts] = np.diff(starts, prepend=0).astype(np.uint64)
    return at - np.cumsum(base)


@dataclass
class Model:
    """What training leaves: a number for each bucket, the log odds of label 1 being their mean plus a bias."""

    weight: np.ndarray
    bias: float
    rows: int

    def scores(self, run: list[bytes]) -> np.ndarray:
        """A score for each text; one without features gets the bias alone."""
        parts, owner = [], []
        for i, x in enumerate(run):
            for part in cut(x):
                parts.append(part)
                owner.append(i)
        total, count = np.zeros(len(run)), np.zeros(len(run))
        at = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to]) <= 1 << 20):
                size += len(parts[to])
                to += 1
            for bucket, own in features(parts[at:to]):
                own = np.asarray(owner[at:to])[own]
                total += np.bincount(own, self.weight[bucket], len(run))
                count += np.bincount(own, minlength=len(run))
            at = to
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """A bounded sample, ``sample`` rows of each label by the order of a hash, of labelled rows that aren't held out.

    A document with several labels takes the least; null ids and labels are left out.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("y").alias("y"))
    )
    order = [F.xxhash64("id"), F.col("id")]
    some = known.where("y = 0").orderBy(*order).limit(sample).unionByName(known.where("y = 1").orderBy(*order).limit(sample))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most 2 * ``sample`` whole texts; the tasks count their features, the driver descends.

    Without any labelled row the model scores all texts 0.5; with one label only it learns that label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                for k, text in enumerate(texts):
                    count = np.zeros(BUCKETS, np.float32)
                    for part in cut(text):
                        for bucket, _ in features([part]):
                            count += np.bincount(bucket, minlength=BUCKETS)
                    at_ = np.flatnonzero(count).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at + k, 1), batch.column(2).slice(at + k, 1), pa.array([at_], pa.list_(pa.int32())), pa.array([count[at_]], pa.list_(pa.float32()))], ["id", "y", "at", "n"]
                    )

    in_small_batches(docs)
    rows = training_rows(docs, labels, label, sample, id_col, text_col)
    got = rows.select(F.col("id").cast("long"), "text", "y").mapInArrow(run, "id long, y int, at array<int>, n array<float>").toArrow()
    data = sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), range(len(got))))
    columns = got["at"].combine_chunks(), got["n"].combine_chunks()
    return descend([(columns[0][i].values.to_numpy(), columns[1][i].values.to_numpy(), y) for _, y, i in data])


def descend(data: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Gradient descent over (buckets, counts, label) rows; both labels weigh the same."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    ones = sum(y for _, _, y in data)
    weigh = [len(data) / max(1, 2 * (len(data) - ones)), len(data) / max(1, 2 * ones)]
    steps, done = max(1, EPOCHS * len(data)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            at, n, y = data[i]
            rate = np.float32(RATE * (1 - done / steps) * weigh[y])
            done += 1
            if not len(at):
                continue
            share = n / n.sum()
            mean = share @ vectors[at]
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p * np.float32(0.1)
            # rare features carry as much of the mean as their share, so the step is by the row's own size
            vectors[at] -= (rate * np.sqrt(share * len(at)) / np.float32(np.sqrt(len(at))))[:, None] * back * np.float32(8)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]), len(data))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from the text alone.

    Null and empty texts are scored like any other; null ids and repeated rows are carried as they are; other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.scores(texts) for _, texts in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    in_small_batches(docs)
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns; each is judged where it is read.

    A null text is judged as an empty one; null and repeated ids make no difference; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.scores(texts) for _, texts in slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(out) >= least if out else [], pa.bool_()))

    in_small_batches(docs)
    return docs.mapInArrow(run, docs.schema)
