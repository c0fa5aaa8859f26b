"""Substring deduplication by content-defined chunking.

A gear hash rolls over the words of a text.  A word is a boundary if its hash is the largest of some SPREAD words in a row, so
boundaries depend on the words around them alone, an insertion moves no other, and no stretch lacks one.  A chunk reaches
from a boundary to the one that is the largest LEAST to LEAST + SPREAD words on; every passage of 48 words holds one.  Chunks
are counted by digest; one that occurs twice is compared byte by byte with its first place, the least by (id, row,
offset), and grows as far as the bytes agree.  Grown passages of more than ``words`` words are repeats.

What the first place of a chunk can't tell, because a phrase of a passage stands alone in an earlier text, is found by
windows of ``words`` + 1 words: those in which every chunk occurs twice and none has led to a repeat over the whole window.
They are looked up by digest and compared alike, so that no repeat is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogena.llm.common import filter_bits, in_small_batches, key_filter, stash, through_filter
from orogena.llm.kernels import mix, slices, span_hashes, texts, word_spans

#: Words of the rolling window, words that a boundary stands out among, and the fewest words of a chunk.
WINDOW, SPREAD, LEAST = 8, 16, 10
OCCURRENCES = "doc_id long, row long, at int, size int, digest long"
WINDOWS = "doc_id long, row long, word int, at int, size int, digest long"
SEEDS = "doc_id long, row long, first_doc_id long, first_row long, start long, end long, first_start long"
RUNS = "doc_id long, row long, start long, end long, n_words long, first_doc_id long, first_row long, first_start long, kept boolean"
_RUNS = pa.schema([(k, pa.int64()) for k in ("doc_id", "row", "start", "end", "n_words", "first_doc_id", "first_row", "first_start")] + [("kept", pa.bool_())])
_BLANK = b" \t\n\x0b\x0c\r"


@dataclass
class Chunked:
    """Words and chunks of some texts laid end to end; ``held`` are the first and last word that decide a chunk."""

    buf: np.ndarray
    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    own: np.ndarray
    chunk: np.ndarray
    until: np.ndarray
    held: tuple[np.ndarray, np.ndarray]


def rolled(words: np.ndarray) -> np.ndarray:
    """The gear hash at each word: the sum of the WINDOW last words' values, each shifted once a step."""
    h = words.copy()
    for k in (1, 2, 4):  # by doubling
        h[k:] += h[:-k] << np.uint64(k)
    return mix(h)


def chunked(run: list[bytes]) -> Chunked:
    buf = np.frombuffer(b"\n".join(run), np.uint8)
    begins = np.append(0, np.cumsum([len(x) + 1 for x in run]))[:-1]
    starts, ends = word_spans(buf)
    own = np.searchsorted(begins, starts, side="right") - 1
    none = np.zeros(0, np.int64)
    n = len(starts)
    if n < WINDOW + SPREAD:
        return Chunked(buf, begins, starts, ends, own, none, none, (none, none))
    x = rolled(span_hashes(buf, starts, ends))
    peak = np.lib.stride_tricks.sliding_window_view(x, SPREAD).argmax(1) + np.arange(n - SPREAD + 1)
    m = len(peak)
    in_text = np.arange(n) - np.searchsorted(own, own)
    fit = (own[:m] == own[SPREAD - 1 :]) & (in_text[:m] >= WINDOW - 1)
    at = np.flatnonzero(fit)
    last = np.flatnonzero(np.append(peak[at][1:] != peak[at][:-1], True)) if len(at) else none
    chunk, decides = peak[at][last], at[last]
    ahead = np.minimum(chunk + LEAST, m - 1)
    good = (chunk + LEAST < m) & fit[ahead] & (own[ahead] == own[chunk])
    chunk, decides, ahead = chunk[good], decides[good], ahead[good]
    return Chunked(buf, begins, starts, ends, own, chunk, peak[ahead], (decides - WINDOW + 1, ahead + SPREAD - 1))


def occurrences(rows: DataFrame) -> DataFrame:
    """A row for each chunk of rows (doc_id, row, text): its text, place and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2)):
                c = chunked(part)
                starts, ends, own = c.starts[c.chunk], c.ends[c.until - 1], c.own[c.chunk]
                text = pa.array(first + own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(text),
                        batch.column(1).take(text),
                        pa.array((starts - c.begins[own]).astype(np.int32)),
                        pa.array((ends - starts).astype(np.int32)),
                        pa.array(span_hashes(c.buf, starts, ends).view(np.int64)),
                    ],
                    ["doc_id", "row", "at", "size", "digest"],
                )

    return rows.select("doc_id", "row", "text").mapInArrow(run, OCCURRENCES)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))


def grown(a: bytes, at: int, b: bytes, first: int, size: int) -> tuple[int, int] | None:
    """How far a[at:at+size] == b[first:first+size] grows to the left and right; None if they differ."""
    if a[at : at + size] != b[first : first + size]:
        return None
    left, most, step = 0, min(at, first), 64
    while left < most:
        n = min(step, most - left)
        same = _agree(a[at - left - n : at - left], b[first - left - n : first - left], "big")
        left += same
        if same < n:
            break
        step = 4096
    a_end, b_end = at + size, first + size
    right, most, step = 0, min(len(a) - a_end, len(b) - b_end), 64
    while right < most:
        n = min(step, most - right)
        same = _agree(a[a_end + right : a_end + right + n], b[b_end + right : b_end + right + n], "little")
        right += same
        if same < n:
            break
        step = 4096
    return left, right


def _agree(a: bytes, b: bytes, order: Literal["big", "little"]) -> int:
    """How many bytes of two strings of one length agree, from the start ("little") or the end ("big")."""
    x = int.from_bytes(a, order) ^ int.from_bytes(b, order)
    return (x & -x).bit_length() - 1 >> 3 if x else len(a)


def windows(rows: DataFrame, words: int) -> DataFrame:
    """A row for each window of ``words`` + 1 words that is still open: doc_id, row, its first word, place, digest.

    ``rows`` are (doc_id, row, text, seeds, spans): the places (at, first_row, first_at) of chunks found twice, and the
    repeats (start, end, first_row, away) found so far.  A chunk closes the windows that hold all that decides it: all of
    them if it was found once or is its own first place, else those inside its repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.asarray(batch.column(1))
            for first, part in slices(batch.column(2)):
                c = chunked(part)
                n = len(c.starts)
                if n <= words:
                    continue
                own = c.own[c.chunk]
                at = c.starts[c.chunk] - c.begins[own]
                low, high = c.held[1] - words, c.held[0]  # first words of the windows that a chunk closes
                edges = np.searchsorted(own, np.arange(len(part) + 1))
                for t in range(len(part)):
                    seeds = batch.column(3)[first + t]
                    if not seeds.is_valid or edges[t] == edges[t + 1]:
                        continue
                    seeds = seeds.values
                    seed_at, first_row, first_at = (np.asarray(seeds.field(k)).astype(np.int64) for k in range(3))
                    k = edges[t] + np.minimum(np.searchsorted(at[edges[t] : edges[t + 1]], seed_at), edges[t + 1] - edges[t] - 1)
                    other = (first_row != numbers[first + t]) | (first_at != seed_at)
                    k, seed_at, first_row, away = k[other], seed_at[other], first_row[other], (first_at - seed_at)[other]
                    a, z = np.full(len(k), n), np.full(len(k), -1)
                    spans = batch.column(4)[first + t]
                    if spans.is_valid:
                        start, end, of_row, of_away = (np.asarray(spans.values.field(k)).astype(np.int64) for k in range(4))
                        low_of = np.searchsorted(c.starts, start + c.begins[t])
                        high_of = np.searchsorted(c.ends, end + c.begins[t], side="right") - 1 - words
                        for x in range(len(start)):
                            mine = (first_row == of_row[x]) & (away == of_away[x]) & (seed_at >= start[x]) & (seed_at < end[x])
                            a[mine], z[mine] = low_of[x], high_of[x]
                    low[k], high[k] = np.maximum(low[k], a), np.minimum(high[k], z)
                closes = low <= high
                shut = np.zeros(n + 1, np.int64)
                np.add.at(shut, np.maximum(low[closes], 0), 1)
                np.subtract.at(shut, high[closes] + 1, 1)
                here = np.flatnonzero((np.cumsum(shut)[: n - words] == 0) & (c.own[words:] == c.own[: n - words]))
                ws, we, text = c.starts[here], c.ends[here + words], c.own[here]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + text)),
                        batch.column(1).take(pa.array(first + text)),
                        pa.array((here - np.searchsorted(c.own, text)).astype(np.int32)),
                        pa.array((ws - c.begins[text]).astype(np.int32)),
                        pa.array((we - ws).astype(np.int32)),
                        pa.array(span_hashes(c.buf, ws, we).view(np.int64)),
                    ],
                    ["doc_id", "row", "word", "at", "size", "digest"],
                )

    return rows.select("doc_id", "row", "text", "seeds", "spans").mapInArrow(run, WINDOWS)


def _firsts(places: DataFrame) -> DataFrame:
    """Places (doc_id, row, at, size, digest) of digests that occur twice or more, with the first place of their digest."""
    again = stash(places.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "again")
    bits = filter_bits(again.count())
    maybe = through_filter(places, places["digest"], stash(key_filter(again, "digest", bits), "filter"), bits)
    twice = stash(maybe.join(again, "digest"), "twice")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at")
    first = twice.groupBy("digest").agg(F.min(place).alias("first"))
    return twice.join(first, "digest").select(*[c for c in twice.columns if c != "digest"], F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"))


def repeated_spans(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each repeat: doc_id, row, start, end, n_words, first_doc_id, first_row, first_start, kept.

    start and end are byte offsets in the UTF-8 text, ``row`` numbers the input rows.  A repeat is a passage of more than
    ``words`` whole words, blanks between them included, that stands at two places or more; ``kept`` marks a place that
    others repeat.  A passage whose parts have different first places gives a row for each of these.  A window of
    ``words`` + 1 words isn't repeated by one that it overlaps.  A null text has none; null and repeated ids are fine, as
    places are rows; other columns are ignored; an empty table gives an empty result.  ``words`` must be 47 or more for
    chunks to find all; below that, windows find what chunks don't.
    """
    return _repeats(stash(_rows(docs, id_col, text_col).where(F.length("text") > 2 * words), "rows"), words)


def _repeats(rows: DataFrame, words: int) -> DataFrame:
    """The repeats of written rows (doc_id, row, text)."""
    in_small_batches(rows)
    seeds = stash(_firsts(stash(occurrences(rows), "chunks")), "seeds")
    apart = seeds.where((F.col("row") != F.col("first_row")) | (F.col("at") != F.col("first_at")))
    places = apart.groupBy("row", "first_row").agg(F.first("doc_id").alias("doc_id"), F.first("first_doc_id").alias("first_doc_id"), F.collect_list(F.struct("at", "size", "first_at")).alias("places"))
    told = stash(_compared(stash(_joined(places), "runs"), rows, words), "told")

    known = seeds.groupBy("row").agg(F.collect_list(F.struct("at", "first_row", "first_at")).alias("seeds"))
    spans = told.groupBy("row").agg(F.collect_list(F.struct("start", "end", "first_row", (F.col("first_start") - F.col("start")).alias("away"))).alias("spans"))
    bits = filter_bits(seeds.select("row").distinct().count())
    some = through_filter(rows, rows["row"], stash(key_filter(seeds, "row", bits), "filter"), bits) if words >= 47 else rows
    open_ = stash(windows(some.join(known, "row", "inner" if words >= 47 else "left").join(spans, "row", "left"), words), "windows")
    found = _firsts(open_)
    overlaps = (F.col("row") == F.col("first_row")) & (F.col("at") < F.col("first_at") + F.col("size"))
    places = found.where(~overlaps).groupBy("row", "first_row").agg(F.first("doc_id").alias("doc_id"), F.first("first_doc_id").alias("first_doc_id"), F.collect_list(F.struct("at", "size", "first_at")).alias("places"))
    told = told.unionByName(stash(_compared(stash(_joined(places), "runs"), rows, words), "told"))

    told = told.distinct()
    return told.unionByName(_kept(told, rows, words))


def _kept(told: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The first places that repeats name; of windows that stand there more than once, the first."""
    spans = told.select(F.col("first_doc_id").alias("doc_id"), F.col("first_row").alias("row"), F.col("first_start").alias("start"), (F.col("first_start") + F.col("end") - F.col("start")).alias("end")).distinct()
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    longest = spans.withColumn("reach", F.max("end").over(before)).where(F.col("reach").isNull() | (F.col("end") > F.col("reach")))
    lists = stash(longest.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "firsts")
    bits = filter_bits(lists.count())
    some = through_filter(rows, rows["row"], stash(key_filter(lists, "row", bits), "filter"), bits).select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                text, seen = r["text"].encode(), 0
                for x in r["spans"]:
                    for s, e in _first_ones(text[x["start"] : x["end"]], words):
                        s, e = s + x["start"], e + x["start"]
                        if e > seen:
                            seen = e
                            out.append((r["doc_id"], r["row"], s, e, len(text[s:e].split()), r["doc_id"], r["row"], s, True))
            yield pa.RecordBatch.from_pylist([dict(zip(_RUNS.names, x)) for x in out], _RUNS)

    return lists.join(some, "row").select("row", "doc_id", "spans", "text").mapInArrow(run, RUNS)


def _joined(places: DataFrame) -> DataFrame:
    """Places of a pair of rows joined into runs: those at the same distance from their first places that touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(4).flatten()
            if not len(flat):
                continue
            pair = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(4).value_lengths()))
            at, size, first_at = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
            order = np.lexsort((at, first_at - at, pair))
            pair, at, size, first_at = (x[order] for x in (pair, at, size, first_at))
            away, end = first_at - at, at + size
            new = np.append(True, (np.diff(pair) != 0) | (np.diff(away) != 0) | (at[1:] > end[:-1] + 1))
            a = np.flatnonzero(new)
            doc, row, first_doc, first_row = (batch.column(k).take(pa.array(pair[a])) for k in range(4))
            yield pa.RecordBatch.from_arrays([doc, row, first_doc, first_row, pa.array(at[a]), pa.array(np.maximum.reduceat(end, a)), pa.array(first_at[a])], ["doc_id", "row", "first_doc_id", "first_row", "start", "end", "first_start"])

    return places.select("doc_id", "row", "first_doc_id", "first_row", "places").mapInArrow(run, SEEDS)


def _whole(a: bytes, start: int, end: int, b: bytes, first: int) -> tuple[int, int]:
    """start and end moved inwards to whole words of both texts, ``first`` being start's place in the other."""
    edge = lambda x, i: i in (0, len(x)) or x[i - 1] in _BLANK or x[i] in _BLANK
    if not (edge(a, start) and edge(b, first)):
        while start < end and a[start] not in _BLANK:
            start, first = start + 1, first + 1
    while start < end and a[start] in _BLANK:
        start, first = start + 1, first + 1
    stop = first + end - start
    if not (edge(a, end) and edge(b, stop)):
        while end > start and a[end - 1] not in _BLANK:
            end -= 1
    while end > start and a[end - 1] in _BLANK:
        end -= 1
    return start, end


def _window_spans(text: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all windows of ``words`` + 1 words."""
    starts, ends = word_spans(np.frombuffer(text, np.uint8))
    return starts[: max(0, len(starts) - words)], ends[words:]


def _covered(ws: np.ndarray, we: np.ndarray, which: np.ndarray) -> list[tuple[int, int]]:
    """What the windows of these numbers, in order, cover."""
    if not len(which):
        return []
    cut = np.flatnonzero(np.diff(which) > 1)
    return [(int(ws[x]), int(we[y])) for x, y in zip(which[np.append(0, cut + 1)], which[np.append(cut, len(which) - 1)])]


def _apart(ws: np.ndarray, we: np.ndarray, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """What the windows from start to end of at most ``most`` bytes cover: those that don't overlap their first places."""
    a, z = np.searchsorted(ws, start), np.searchsorted(we, end, side="right")
    return _covered(ws, we, a + np.flatnonzero(we[a:z] - ws[a:z] <= most)) if a < z else []


def _first_ones(text: bytes, words: int) -> list[tuple[int, int]]:
    """What the windows cover whose bytes stand nowhere before."""
    ws, we = _window_spans(text, words)
    first = np.unique(span_hashes(np.frombuffer(text, np.uint8), ws, we), return_index=True)[1] if len(ws) else ws
    return _covered(ws, we, np.sort(first))


def _compared(runs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Repeats of more than ``words`` words that runs grow to, byte for byte; each pair of texts meets once."""
    named = runs.select(F.explode(F.array("row", "first_row")).alias("row")).distinct()
    bits = filter_bits(named.count())
    own = through_filter(rows, rows["row"], stash(key_filter(named, "row", bits), "filter"), bits).select("row", "text")
    pairs = runs.groupBy("row", "first_row").agg(F.first("doc_id").alias("doc_id"), F.first("first_doc_id").alias("first_doc_id"), F.collect_list(F.struct("start", "end", "first_start")).alias("runs"))
    pairs = pairs.join(own.withColumnRenamed("text", "a"), "row").join(own.select(F.col("row").alias("first_row"), F.col("text").alias("b")), "first_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            row, first_row, doc, first_doc = (batch.column(k).to_pylist() for k in ("row", "first_row", "doc_id", "first_doc_id"))
            flat, edges = batch.column("runs").flatten(), [0, *np.cumsum(np.asarray(batch.column("runs").value_lengths())).tolist()]
            runs = list(zip(*(np.asarray(flat.field(k)).tolist() for k in range(3))))
            for i, (a, b) in enumerate(zip(texts(batch.column("a")), texts(batch.column("b")))):
                reach: dict[int, int] = {}
                done: list[tuple[int, int, int]] = []
                spans = None
                for start, end, first in sorted(runs[edges[i] : edges[i + 1]]):
                    away = first - start
                    # what the same bytes go on to at the same distance is part of that repeat
                    sides = grown(a, start, b, first, end - start) if end > reach.get(away, -1) else None
                    if sides is None:
                        continue
                    reach[away] = end + sides[1]
                    if end + sides[1] - start + sides[0] <= 2 * words:
                        continue
                    whole = _whole(a, start - sides[0], end + sides[1], b, first - sides[0])
                    # a text of one word again and again tells the same of many distances
                    if any(s <= whole[0] and whole[1] <= e and s + x <= whole[0] + away and whole[1] + away <= e + x for s, e, x in done):
                        continue
                    if whole[1] - whole[0] <= 2 * words:
                        continue
                    if row[i] != first_row[i]:
                        found = [whole]
                    else:
                        spans = spans or _window_spans(a, words)
                        found = _apart(*spans, *whole, -away)
                    for s, e in found:
                        n = len(a[s:e].split())
                        if n > words:
                            done.append((s, e, away))
                            out.append((doc[i], row[i], s, e, n, first_doc[i], first_row[i], s + away, False))
            columns = zip(*out) if out else [()] * len(_RUNS)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _RUNS)], schema=_RUNS)

    return pairs.mapInArrow(run, RUNS)


def without_repeats(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): each text without the repeats whose first place is elsewhere. Null texts stay null."""
    rows = stash(_rows(docs, id_col, text_col), "numbered")
    spans = stash(_repeats(rows, words).where("NOT kept"), "spans")
    cuts = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["text"] is None or not r["cuts"]:
                    out.append(r["text"])
                    continue
                raw, kept, at = r["text"].encode(), [], 0
                for c in r["cuts"]:
                    kept.append(raw[at : max(at, c["start"])])
                    at = max(at, c["end"])
                out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    joined = rows.join(cuts, "row", "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(run, "doc_id long, text string")
