"""How far the sources of a language are from one another in their terms.

Tasks cut whole texts into terms on byte level: a numpy table over the concatenated UTF-8 buffers maps each byte to its
lower-cased self or to nothing, which gives the boundaries; xxHash groups the slices, and slices of one group are compared
byte by byte.  Counts are added up before and after the shuffle.  Of each language the kept terms are dealt into blocks of
bounded size, sources by terms, as CSR matrices; ``reduceat`` over their rows sums the differences of each pair of
sources, and the blocks' sums are added.  Shares are whole billionths, so that every sum is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogena.llm.common import in_small_batches, stash
from orogena.llm.kernels import gathered, span_array, span_classes, xxh64

#: Bytes of text that a pass takes at a time.
PASS = 1 << 22
#: Entries of a block's matrix, about, and sources of a tile of it.
BLOCK_ENTRIES, TILE = 1 << 15, 256

_TERM = np.zeros(256, np.uint8)
_TERM[65:91] = np.arange(97, 123)
_TERM[97:123] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


def counted_terms(run: list[bytes], group: np.ndarray, hashes=xxh64) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Terms of at most 65,536 texts by group of texts: group, term, occurrences, texts with the term."""
    edges = np.concatenate([[0], np.cumsum([len(x) + 1 for x in run])]).astype(np.int64)
    buf = _TERM[np.frombuffer(b" ".join([*run, b""]), np.uint8)]
    edge = np.diff((buf != 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(edges, starts, side="right") - 1
    h = hashes(buf, starts, ends)
    # once each text and term: how often
    order, first = span_classes(buf, starts, ends, (owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)), owner)
    times, lead = np.diff(np.append(first, len(order))), order[first]
    # once each term: its class
    order, first = span_classes(buf, starts[lead], ends[lead], h[lead])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    cell, at = np.unique(group[owner[lead]] * max(1, len(first)) + kind, return_inverse=True)
    of_cell = lead[order[first]][cell % max(1, len(first))]
    # sums of whole numbers below 2^53 are exact in bincount's doubles
    n = np.bincount(at, weights=times, minlength=len(cell)).astype(np.int64)
    return cell // max(1, len(first)), span_array(buf, starts[of_cell], ends[of_cell]), n, np.bincount(at, minlength=len(cell))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and the rows that have it; nulls count as empty."""
    in_small_batches(docs)
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(own(lang_col).alias("lang"), own(source_col).alias("source"), own(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for told, texts in gathered(batches, 2, PASS):
            groups: dict[tuple[str, str], int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(told["lang"].to_pylist(), told["source"].to_pylist())], np.int64)
            g, term, n, n_docs = counted_terms(texts, group)
            names = pa.array([x for x, _ in groups], pa.string()), pa.array([x for _, x in groups], pa.string())
            yield pa.RecordBatch.from_arrays([names[0].take(pa.array(g)), names[1].take(pa.array(g)), term.cast(pa.string()), pa.array(n), pa.array(n_docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)) in whole numbers of any size; null without terms."""
    up = F.lit(10**9).cast("decimal(10,0)") * (F.col(count) if isinstance(count, str) else count).cast("decimal(19,0)") + F.lit(5 * 10**9).cast("decimal(10,0)")
    down = F.col(total) + 5 * F.col(terms)
    return F.lit(1) + F.call_function("div", up, F.nullif(down, F.lit(0)).cast("decimal(20,0)"))


_SUMS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("d", pa.int64())])


def _differences(block: pa.Table) -> pa.Table:
    """Of a block of terms: for each pair of its sources the sum over terms of |p - q| - |p0 - q0|.

    Rows (source, tile, term, p) have the shares of terms that occur, and p0, the share of one that doesn't, where term is null.
    """
    rows = block.select(["source", "tile", "term", "p"]).to_pandas()
    lang, ti, tj = (block[c][0].as_py() for c in ("lang", "ti", "tj"))
    base = rows[rows["term"].isna()].sort_values("source", kind="stable")
    names, tiles, p0 = base["source"].to_numpy(object), base["tile"].to_numpy(), base["p"].to_numpy(np.int64)
    cells = rows[rows["term"].notna()]
    at = np.searchsorted(names, cells["source"].to_numpy(object))
    col = pd.factorize(cells["term"])[0].astype(np.int64)
    order = np.lexsort((col, at))
    col, p = col[order], cells["p"].to_numpy(np.int64)[order]
    edges = np.searchsorted(at[order], np.arange(len(names) + 1))
    n_cols = int(col.max()) + 1 if len(col) else 0
    full = np.flatnonzero(np.diff(edges))  # reduceat has no empty rows
    owner = np.repeat(np.arange(len(names)), np.diff(edges))
    ones, others, found = [], [], []
    for i in np.flatnonzero(tiles == ti):
        dense = np.full(n_cols, p0[i])
        own = p[edges[i] : edges[i + 1]]
        dense[col[edges[i] : edges[i + 1]]] = own
        sums = np.zeros(len(names), np.int64)
        if len(full):
            sums[full] = np.add.reduceat(np.abs(p - dense[col]) - np.abs(p0[owner] - dense[col]), edges[full])
        # where the other source has nothing: sum over own shares of |p0 of the other - p|
        ordered, k = np.sort(own), np.searchsorted(np.sort(own), p0)
        below = np.concatenate([[0], np.cumsum(ordered)])
        sums += p0 * k - below[k] + below[-1] - below[k] - p0 * (len(own) - k) - len(own) * np.abs(p0 - p0[i])
        other = np.flatnonzero((tiles == tj) & (np.arange(len(names)) > i if ti == tj else True))
        ones += [names[i]] * len(other)
        others += names[other].tolist()
        found += sums[other].tolist()
    return pa.table([[lang] * len(found), ones, others, found], schema=_SUMS)


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block: int = BLOCK_ENTRIES, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) for each pair of sources of a language and each source's leading terms.

    A language keeps the terms that at least ``least_docs`` of its rows have.  Part "pair": item is another source of
    the language, value the sum of the differences of shares over all kept terms (0 without any).  Part "term": item is a
    kept term that the source has and uses more than the language does, value by how much; the ``top`` first.  Nulls in
    text, language and source count as empty strings, which are a language and a source of their own; a text without terms
    counts for its group's existence alone; repeated rows count each; other columns are ignored; an empty table gives an empty result.
    """
    terms = stash(term_counts(docs, text_col, lang_col, source_col), "terms")
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(own(lang_col).alias("lang"), own(source_col).alias("source")).distinct()

    kept = stash(terms.groupBy("lang", "term").agg(F.sum("n").alias("of_all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    cells = stash(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "of_all"), "cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_all").alias("n_lang"))
    sizes = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("entries")), ["lang", "source"], "left")
    sizes = sizes.join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_group", "entries", "v", "n_lang")])
    sizes = stash(sizes, "sizes")
    shape = sizes.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.sum("entries") / block)).cast("int").alias("blocks"))
    told = stash(
        sizes.join(shape, "lang").select("*", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"), _share(F.lit(0), "n_group", "v").alias("p0")),
        "groups",
    )

    shares = stash(cells.join(told, ["lang", "source"]).select("lang", "source", "term", "tile", "tiles", "blocks", _share("n", "n_group", "v").alias("p"), _share("of_all", "n_lang", "v").alias("q")), "shares")
    held = shares.select("lang", "source", "term", "tile", "tiles", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "p")
    bases = told.where("v > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("p0").alias("p"))
    met = held.unionByName(bases).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("lang", F.least("tile", "to").alias("ti"), F.greatest("tile", "to").alias("tj"), "block", "source", "tile", "term", "p")
    parts = met.groupBy("lang", "ti", "tj", "block").applyInArrow(_differences, "lang string, a string, b string, d long")

    one, other = told.alias("one"), told.alias("other")
    pairs = one.join(other, F.col("one.lang") == F.col("other.lang")).where(F.col("one.source") < F.col("other.source"))
    bare = pairs.select("one.lang", F.col("one.source").alias("a"), F.col("other.source").alias("b"), F.coalesce(F.col("one.v") * F.abs(F.col("one.p0") - F.col("other.p0")), F.lit(0)).alias("d"))
    whole = parts.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").unionByName(bare).groupBy("lang", "a", "b").agg(F.sum("d").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    by_pair = whole.select("lang", "value", sides.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", place)
    by_term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return by_pair.unionByName(by_term.withColumn("rank", place).where(F.col("rank") <= top))
