"""Nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then filed under its leaf.  A query walks the tree best bin
first: a priority queue holds the branches not taken, by the inner product of the query with their centre plus what the
branch's spread may add, and gives the leaves in the order of their promise.  How many leaves a query visits is
calibrated: on a bounded sample of queries, whose true neighbours come from a full scan in blocks, the visits widen
until recall reaches the target.  A query meets the leaves that it visits and no others: a leaf's vectors lie in blocks of
bounded size, its queries in chunks of bounded size, and each block returns its best for each query of a chunk; the
bests are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogena.llm.common import stash

#: Bounds of the samples that fit the tree and calibrate the visits.
FIT, CALIBRATE = 8_192, 128
BRANCH, LEAF = 8, 64
#: Vectors in a block of a leaf, and queries in a chunk of those that visit it.
BLOCK = CHUNK = 2_048
#: Recall that the calibration sample reaches before visits stop widening.
TARGET = 0.95


@dataclass
class Tree:
    """Inner and leaf nodes: centre, radius, children; leaf number or -1."""

    centre: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre, level by level."""
        at = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                kids = self.children[node]
                if kids:
                    c = self.centre[kids]
                    at[rows] = np.asarray(kids)[(x[rows] @ c.T - (c * c).sum(1) / 2).argmax(1)]
            open_ = open_[[bool(self.children[i]) for i in at[open_]]]
        return self.leaf[at]

    def walk(self, q: np.ndarray, visits: int | None = None, sizes: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """The first leaves, or all, best bin first: by the largest inner product that a branch's centre and spread promise.

        It goes on beyond ``visits`` until the leaves hold ``least`` vectors by their ``sizes``.
        """
        held = 0
        size = float(np.sqrt(q @ q))
        queue = [(0.0, 0)]
        out: list[int] = []
        while queue and (visits is None or len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            while kids := self.children[node]:
                promise = self.centre[kids] @ q + 0.5 * size * self.radius[kids]
                order = np.argsort(-promise, kind="stable")
                for k in order[1:]:
                    heapq.heappush(queue, (-float(promise[k]), kids[k]))
                node = kids[order[0]]
            out.append(int(self.leaf[node]))
            held += int(sizes[out[-1]]) if sizes is not None else 0
        return np.array(out, np.int32)


def fitted(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, rounds: int = 8) -> Tree:
    """k-means of k-means down to leaves of about ``leaf`` sample vectors."""
    rng = np.random.default_rng(11)
    centre, radius, children, number = [], [], [], []
    count = 0

    def add(rows: np.ndarray) -> int:
        nonlocal count
        node = len(centre)
        c = x[rows].mean(0) if len(rows) else np.zeros(x.shape[1])
        centre.append(c)
        radius.append(float(np.sqrt(((x[rows] - c) ** 2).sum(1).mean())) if len(rows) else 0.0)
        children.append([])
        number.append(-1)
        if len(rows) > leaf:
            seeds = np.unique(x[rng.choice(rows, min(4 * branch, len(rows)), replace=False)], axis=0)
            cs = seeds[rng.permutation(len(seeds))[:branch]].copy()
            for _ in range(rounds):
                own = (x[rows] @ cs.T - (cs * cs).sum(1) / 2).argmax(1)
                for k in np.unique(own):
                    cs[k] = x[rows[own == k]].mean(0)
            own = (x[rows] @ cs.T - (cs * cs).sum(1) / 2).argmax(1)
            parts = [rows[own == k] for k in np.unique(own)]
            if len(parts) > 1:
                children[node] = [add(p) for p in parts]
                return node
        number[node] = count
        count += 1
        return node

    add(np.arange(len(x)))
    return Tree(np.array(centre), np.array(radius), children, np.array(number))


def _best(query: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of some vectors for each query, ties to the smaller id, a query's own row left out."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    out = []
    for at in range(0, len(query), 512):
        own = query[at : at + 512]
        s = q[at : at + 512] @ x.T
        place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        for i in np.flatnonzero(ids[place] == own):
            s[i, ids == own[i]] = -np.inf
        if s.shape[1] > k:
            some = np.argpartition(-s, k - 1, axis=1)[:, :k]
            floor = np.take_along_axis(s, some, 1).min(1)
            for i in np.flatnonzero((s >= floor[:, None]).sum(1) > k):  # ties at the end: the smaller ids, which come first
                some[i] = np.argsort(-s[i], kind="stable")[:k]
        else:
            some = np.broadcast_to(np.arange(s.shape[1]), s.shape)
        good = np.isfinite(np.take_along_axis(s, some, 1))
        # in one order of terms, so that equal vectors have equal scores in whatever block they lie
        top = np.zeros(some.shape)
        for d in range(x.shape[1]):
            top += q[at : at + 512, d, None] * x[some, d]
        out.append((np.broadcast_to(own[:, None], some.shape)[good], ids[some][good], top[good]))
    return tuple(map(np.concatenate, zip(*out))) if out else (ids[:0], ids[:0], np.zeros(0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): vectors in double precision without those that are null, zero or not finite, and without null ids."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


RESULT = "query_id long, vec_id long, score double"


def _scan(blocks: DataFrame, queries: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Each task's best for a bounded set of queries, over all vectors it reads."""
    width = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = _best(queries, q, batch.column(0).to_numpy(), _matrix(batch.column(1), width), k)
                yield pa.RecordBatch.from_arrays([*map(pa.array, got)], ["query_id", "vec_id", "score"])

    return blocks.select("vec_id", "v").mapInArrow(run, RESULT)


def ranked(best: DataFrame, k: int) -> DataFrame:
    """The k best of each query from its blocks' bests: query_id, rank, vec_id, score. Tasks pass on k a query at most."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """The ``k`` nearest vectors found for each query: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller id.  ``is_query`` is a condition on
    vec_id.  Vectors that are null, zero or hold a null or a component that isn't finite take no part, nor do rows with a
    null id, nor vectors of another length than the most frequent one (of several, the longest).  Of rows that repeat an id each is a candidate of its own for other ids, and the least vector is that id's query.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = stash(usable(vectors, id_col, vec_col).withColumn("width", F.size("v")), "vectors")
    widths = good.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if not widths:
        return empty
    good = good.where(F.col("width") == widths["width"]).select("vec_id", "v")
    order = F.xxhash64("vec_id")
    fit = good.orderBy(order, "vec_id").limit(FIT).toArrow()
    width = len(fit["v"][0])
    tree = fitted(_matrix(fit["v"], width))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tree.file(_matrix(batch.column(1), width)).astype(np.int32))], ["vec_id", "v", "leaf"])

    filed = stash(good.mapInArrow(file, "vec_id long, v array<double>, leaf int"), "filed")
    sizes = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    queries = good.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    sample = queries.orderBy(order, "vec_id").limit(CALIBRATE).toArrow()
    if not len(sample):
        return empty
    ids, q = sample["vec_id"].to_numpy(), _matrix(sample["v"], width)
    ids, at = np.unique(ids, return_index=True)
    q = q[at]
    truth = ranked(_scan(good, ids, q, k), k)
    leaf_of = truth.join(filed.select("vec_id", "leaf").groupBy("vec_id").agg(F.min("leaf").alias("leaf")), "vec_id").select("query_id", "leaf").toArrow()
    visits = calibrated(tree, dict(zip(ids.tolist(), q)), leaf_of["query_id"].to_pylist(), leaf_of["leaf"].to_pylist(), target)

    held = np.array([sizes.get(leaf, 0) for leaf in range(tree.leaves)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [tree.walk(v, visits, held, k + 1).astype(np.int32) for v in _matrix(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["query_id", "q", "leaves"])

    asked = stash(queries.repartition("vec_id").mapInArrow(walk, "query_id long, q array<double>, leaves array<int>"), "asked")
    # a leaf's vectors are dealt into blocks and its queries into chunks, both by a hash of the id; each block meets each chunk
    called = {r["leaf"]: r["n"] for r in asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    deal = [(leaf, max(1, -(-sizes.get(leaf, 0) // BLOCK)), max(1, -(-called.get(leaf, 0) // CHUNK))) for leaf in range(tree.leaves)]
    deal = F.broadcast(spark.createDataFrame(deal, "leaf int, blocks int, chunks int"))
    part = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.select("query_id", "q", F.explode("leaves").alias("leaf")).join(deal, "leaf").select("leaf", part("query_id", "chunks").alias("chunk"), upto("blocks").alias("block"), "query_id", "q")
    dealt = filed.join(deal, "leaf").select("leaf", upto("chunks").alias("chunk"), part("vec_id", "blocks").alias("block"), "vec_id", "v")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        got = _best(a["query_id"].to_numpy(), _matrix(a["q"], width), b["vec_id"].to_numpy(), _matrix(b["v"], width), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got))))

    key = ["leaf", "chunk", "block"]
    best = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(search, RESULT)
    return ranked(best, k)


def calibrated(tree: Tree, queries: dict[int, np.ndarray], query: list[int], leaf: list[int], target: float) -> int:
    """The least number of leaves, doubled from 4 and then halved into place, whose recall on the sample reaches the target."""
    place = {i: {int(x): p for p, x in enumerate(tree.walk(v))} for i, v in queries.items()}
    reached = np.sort([place[i][x] + 1 for i, x in zip(query, leaf)]) if len(query) else np.array([1])
    recall = lambda v: np.searchsorted(reached, v, side="right") / len(reached)
    visits = 4
    while visits < tree.leaves and recall(visits) < target:
        visits *= 2
    low, visits = visits // 2, min(visits, tree.leaves)
    while visits - low > 1:
        mid = (low + visits) // 2
        low, visits = (low, mid) if recall(mid) >= target else (mid, visits)
    return visits
