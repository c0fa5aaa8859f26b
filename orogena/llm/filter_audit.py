"""How filters of documents interact, by scanning Arrow buffers.

Tasks scan the buffers of whole texts: a table gives each byte its classes, prefix sums over the classes count words,
capitals, symbols and code points of each document, and a document's word hashes, sorted and verified byte by byte, give
its distinct words.  What five filters say of a document is a mask of five bits.  Only numbers of documents by part and
mask are shuffled, at most 32 a part; all orders of the filters are answered from these masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogena.llm.common import in_small_batches, stash
from orogena.llm.kernels import gathered, span_classes, word_spans, xxh64

#: Bytes of text that a pass takes at a time.
PASS = 1 << 21
WORD, CAPITAL, SYMBOL, FOLLOWS = 1, 2, 4, 8


@dataclass(frozen=True)
class Limits:
    """When a text fails: under ``words`` words; distinct words under a share; capitals over a share; any of ``symbols``."""

    words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2
    symbols: str = "#$%&*|"


def byte_classes(symbols: str) -> np.ndarray:
    """The classes of each byte: of a word, capital, symbol, within a code point."""
    table = np.full(256, WORD, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[65:91] |= CAPITAL
    table[list(symbols.encode("ascii"))] |= SYMBOL
    table[128:192] |= FOLLOWS
    return table


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int, hashes=xxh64) -> np.ndarray:
    """The number of distinct words of each of n owners."""
    # 16 bits of the owner and 48 of the hash: a collision costs a comparison and no more
    key = (owner.astype(np.uint64) << np.uint64(48)) | (hashes(buf, starts, ends) >> np.uint64(16))
    order, first = span_classes(buf, starts, ends, key, owner)
    return np.bincount(owner[order[first]], minlength=n)


def scanned(run: list[bytes], table: np.ndarray) -> dict[str, np.ndarray]:
    """For each of at most 65,536 texts: n_words, n_distinct, n_capitals, n_symbols and n_points."""
    size = np.array([len(x) + 1 for x in run], np.int64)
    edges = np.concatenate([[0], np.cumsum(size)])
    buf = np.frombuffer(b"\n".join([*run, b""]), np.uint8)  # each text with a line feed behind it
    kind = table[buf]

    def counted(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return sums[edges[1:]] - sums[edges[:-1]]

    starts, ends = word_spans(buf)
    owner = np.searchsorted(edges, starts, side="right") - 1
    first = np.zeros(len(buf), bool)
    first[starts] = True
    return {
        "n_words": counted(first),
        "n_distinct": distinct_words(buf, starts, ends, owner, len(run)),
        "n_capitals": counted((kind & CAPITAL) != 0),
        "n_symbols": counted((kind & SYMBOL) != 0),
        "n_points": counted((kind & FOLLOWS) == 0) - 1,
    }


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", symbols: str = "#$%&*|") -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, n_capitals, n_symbols, n_points) of each row; ``digest`` is the text's SHA-256.

    Words are runs of anything but six ASCII blanks, told apart by case.  A null text counts as an empty one, a null part
    as the empty string; other columns are ignored.
    """
    in_small_batches(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_classes(symbols)
        for told, texts in gathered(batches, 3, PASS):
            out, found = told.select(["doc_id", "part", "digest"]), scanned(texts, table)
            for c in COUNTS:
                out = out.append_column(c, pa.array(found[c], pa.int64()))
            yield from out.to_batches()

    return rows.mapInArrow(run, "doc_id long, part string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS))


def failed_filters(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of each row of ``docs``: bit k of ``mask`` is set if the row fails the k-th filter of A to E.

    A: too few words; B: too few distinct words; C: too many capitals; D: a symbol; E: the text of a smaller id, anywhere in the
    table (by SHA-256).  A null id is smaller than none, and none is smaller than it; rows that repeat an id don't fail E by each
    other.  An empty text has no words and no code points, so that it fails A and neither B, C nor D.
    """
    facts = stash(text_facts(docs, id_col, text_col, part_col, limits.symbols), "facts")
    failed = [
        F.col("n_words") < limits.words,
        100 * F.col("n_distinct") < limits.distinct_percent * F.col("n_words"),
        100 * F.col("n_capitals") > limits.capital_percent * F.col("n_points"),
        F.col("n_symbols") > 0,
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    ]
    # a row for each digest that different ids share; written, so that the join below can split a digest with many rows
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    mask = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0))
    return facts.join(stash(firsts, "firsts"), "digest", "left").select("doc_id", "part", mask.cast("int").alias("mask"))


def _answers() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All (order, step), and for each of them the masks kept, removed, redundant and failing its filter alone."""
    steps, tables = [], ([], [], [], [])
    masks = np.arange(32)
    for order in permutations("ABCDE"):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << "ABCDE".index(name)
            fails, gone = (masks & bit) != 0, (masks & before) != 0
            for table, hit in zip(tables, (~fails & ~gone, fails & ~gone, fails & gone, masks == bit)):
                table.append(hit)
            steps.append(("".join(order), k + 1))
            before |= bit
    return steps, *(np.array(t).astype(np.int64) for t in tables)


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """600 rows a part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``labels`` has (doc_id, quality, toxic); a document is good or toxic if any of its labels says 1, and a row whose id
    is null or has no label is neither.  Repeated rows count each for itself; an empty table has no part.  See :func:`failed_filters`
    for the filters and for nulls.
    """
    masks = failed_filters(docs, limits, id_col, text_col, part_col)
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = masks.join(said, "doc_id", "left")
    counts = told.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, kept, removed, redundant, alone = _answers()
        orders, places = pa.array([o for o, _ in steps]), pa.array([k for _, k in steps], pa.int32())
        which = np.array([ord(o[k - 1]) - 65 for o, k in steps])
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = np.zeros((3, 32), np.int64)
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                gone = removed @ n
                shares = np.zeros(5, np.int64)
                np.add.at(shares, which, gone)
                found = (kept @ n, gone, redundant @ n, alone @ n, removed @ good, removed @ toxic, shares[which])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), orders, places, *map(pa.array, found)], ["part", "filter_order", "step", *COLUMNS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))
