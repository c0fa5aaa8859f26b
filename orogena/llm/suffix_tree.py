"""Scoring texts by a probabilistic suffix tree.

A text is its words, A-Z lowered, with one blank between them and one end; the tree's symbols are the bytes of that.
Tasks count every run of DEPTH + 1 symbols of the training texts.  A context of up to DEPTH symbols that occurs LEAST times is a
candidate, whatever the corpus, and is retained, with all runs inside it, if its next-symbol distribution diverges from its parent's.
Distributions are smoothed towards the parent's by as much weight as there are distinct next symbols.  The tree is a written
table that grows with the corpus.  Its most frequent contexts, HEAD at most, are the states of an automaton that every task has, so
that the longest suffix of what was read is found by one look-up a symbol, in many segments of text side by side.  Where a filter
can't rule out that a longer suffix is retained, the symbol and its context meet the tree in a join, so HEAD decides no score.

Unigram counts of words come from the same pass.  Of those, the most frequent ones, COMMON at most, go to every task; other
words meet their counts like symbols.  For that a text's words and symbols are dealt by their keys into PARTS rows at most, however
many they are, and a task has the figures of one part and the like parts of a bounded number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogena.llm.common import filter_bits, stash
from orogena.llm.kernels import slices, word_hashes
from orogena.llm.quality import held_out

DEPTH = 5
#: Least occurrences of a context, and the contexts that every task has.
LEAST, HEAD = 64, 1 << 16
#: Least divergence of a context from its parent, in nats a symbol, and in nats over all its places.
DIVERGENCE, EVIDENCE = 0.02, 20.0
#: Words whose counts every task has.
COMMON = 1 << 18
END = 10
END_HASH = 0x5E17_0F7E_27A1_1E5D
#: Places of text that a segment scores, and entries that a task gathers before it passes them on.
SEGMENT, GATHERED = 1_024, 2_000_000
SYMBOL, WORD = 0, 1
#: Parts that a text's rare words and symbols are dealt into by their keys, and texts whose like parts meet their figures in a task.
PARTS, MET = 31, 1 << 18


def stream(text: bytes) -> bytes:
    """The symbols of a text: words with a blank between, and the end."""
    return b" ".join(text.lower().split()) + b"\n"


def _padded(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols with DEPTH ends before each text, and where each text's own symbols start and end."""
    streams = [stream(x) for x in run]
    sizes = np.array([len(x) for x in streams], np.int64)
    ends = np.cumsum(sizes + DEPTH)
    pad = bytes([END]) * DEPTH
    return np.frombuffer(pad + pad.join(streams), np.uint8), ends - sizes, ends


def _codes(s: np.ndarray) -> np.ndarray:
    """The code of each symbol, from the one at DEPTH on, with the DEPTH symbols before it, eight bits each."""
    m = len(s) - DEPTH
    code = np.zeros(m, np.uint64)
    for k in range(DEPTH + 1):
        code = code << np.uint64(8) | s[k : k + m].astype(np.uint64)
    return code


def grams(run: list[bytes]) -> np.ndarray:
    """The codes of the texts' own symbols."""
    s, starts, ends = _padded(run)
    told = np.zeros(len(s) - DEPTH + 1, np.int8)
    told[starts - DEPTH] += 1
    np.subtract.at(told, ends - DEPTH, 1)
    return _codes(s)[np.cumsum(told[:-1]) > 0]


class _Tally:
    """Counts of codes, merged in runs of like size."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray) -> None:
        if len(codes):
            self.runs.append(np.unique(codes, return_counts=True))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            b, a = self.runs.pop(), self.runs.pop()
            self.runs.append(_merged([a, b]))

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.runs)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        runs, self.runs = self.runs, []
        return _merged(runs) if runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in runs]), np.concatenate([n for _, n in runs])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, n) over all rows: codes of symbol runs, and hashes of words and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {SYMBOL: _Tally(), WORD: _Tally()}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, tally in tallies.items():
                keys, n = tally.take()
                for at in range(0, len(keys), 100_000):
                    k = keys[at : at + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 100_000].astype(np.int64))], ["kind", "key", "n"])

        for batch in batches:
            for _, part in slices(batch.column(0)):
                tallies[SYMBOL].add(grams(part))
                tallies[WORD].add(np.concatenate([*word_hashes(part), np.full(len(part), END_HASH, np.uint64)]))
                if sum(map(len, tallies.values())) > GATHERED:
                    yield from out()
        yield from out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class SuffixTree:
    """The automaton: symbol of each byte, next state and log10 probability by state and symbol; a filter over contexts beyond it."""

    symbol: np.ndarray
    to: np.ndarray
    log10: np.ndarray
    contexts: list[bytes]
    beyond: np.ndarray | None = None

    def scores(self, run: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The log10 probability of each text, without the symbols whose codes and times follow: those that may have a longer context."""
        raw, starts, ends = _padded(run)
        s = self.symbol[raw]
        width = self.to.shape[1]
        to, log10 = self.to.ravel(), self.log10.ravel()
        per = -(-(ends - starts) // SEGMENT)
        own = np.repeat(np.arange(len(run)), per)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
        at = starts[own] + nth * SEGMENT
        size = np.minimum(SEGMENT, ends[own] - at)
        order = np.argsort(-size, kind="stable")
        at, own, size = at[order] - DEPTH, own[order], size[order]
        live = np.searchsorted(-size, -np.arange(SEGMENT) - 0.5)  # segments longer than each number
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at))
        before = None if self.beyond is None else np.full(len(s), -1, np.int32)
        for t in range(DEPTH + (int(size[0]) if len(size) else 0)):
            m = len(at) if t < DEPTH else live[t - DEPTH]
            cell = state[:m] * width + s[at[:m] + t]
            if t >= DEPTH:
                total[:m] += log10[cell]
                if before is not None:
                    before[at[:m] + t] = state[:m]
            state[:m] = to[cell]
        score, none = np.bincount(own, total, len(run)), np.zeros(0, np.int64)
        if before is None:
            return score, [none] * len(run), [none] * len(run)
        depth = np.array([len(c) for c in self.contexts], np.uint64)
        place = np.flatnonzero((before >= 0) & (depth < DEPTH)[before])
        longer = depth[before[place]] + np.uint64(1)
        code = _codes(raw)[place - DEPTH]
        suffix = (code >> np.uint64(8)) & ((np.uint64(1) << np.uint64(8) * longer) - np.uint64(1))
        slot = _slot(suffix, longer) & np.uint64(64 * len(self.beyond) - 1)
        may = self.beyond[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0
        place, code = place[may], code[may].astype(np.int64)
        text = np.searchsorted(ends, place, side="right")
        score -= np.bincount(text, log10[before[place] * np.int64(width) + s[place]], len(run))
        got = [np.unique(x, return_counts=True) for x in np.split(code, np.searchsorted(text, np.arange(1, len(run))))]
        return score, [x for x, _ in got], [n for _, n in got]


def _slot(context, length):
    """A number that spreads contexts, for columns and arrays alike; nothing overflows."""
    low, high = (context % 1048576, F.shiftright(context, 20)) if not isinstance(context, np.ndarray) else (context & np.uint64((1 << 20) - 1), context >> np.uint64(20))
    own = (lambda x: x) if not isinstance(context, np.ndarray) else np.uint64
    return low * own(1048573) + high * own(40503) + length * own(7919)


def grown(context: np.ndarray, length: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> SuffixTree:
    """The automaton of contexts: rows (context code, its length, next symbol, count), the empty one and all runs inside one included."""
    seen = np.unique(np.concatenate([symbol[length == 0], [END]]))
    code_of = np.full(256, len(seen), np.int64)  # bytes never seen share the last symbol, each as one byte of its chance
    code_of[seen] = np.arange(len(seen))
    width = len(seen) + 1
    root = np.zeros(width)
    root[code_of[symbol[length == 0]]] = n[length == 0]
    root = (root + 0.5) / (root.sum() + 0.5 * 256)
    rows = np.lexsort((symbol, context, length))
    context, length, symbol, n = context[rows], length[rows], symbol[rows], n[rows]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (length[1:] != length[:-1])])) if len(n) else np.zeros(0, int)
    smooth: dict[tuple[int, int], np.ndarray] = {(0, 0): root}
    for a, b in zip(first, [*first[1:], len(n)]):
        d, c = int(length[a]), int(context[a])
        if d:
            at, x = code_of[symbol[a:b]], n[a:b]
            p = smooth[d - 1, c & ((1 << 8 * (d - 1)) - 1)] * (len(at) / (x.sum() + len(at)))
            p[at] += x / (x.sum() + len(at))
            smooth[d, c] = p
    number = {s: i for i, s in enumerate(smooth)}
    to, log10 = np.zeros((len(smooth), width), np.int32), np.zeros((len(smooth), width), np.float32)
    for i, ((d, c), p) in enumerate(smooth.items()):
        log10[i] = np.log10(p)
        if d:
            to[i] = to[number[d - 1, c & ((1 << 8 * (d - 1)) - 1)]]
        for b in seen if d < DEPTH else ():
            if (j := number.get((d + 1, c << 8 | int(b)))) is not None:
                to[i, code_of[b]] = j
    return SuffixTree(code_of.astype(np.int64), to, log10, [c.to_bytes(d, "big") for d, c in smooth])


def retained(tallied: DataFrame) -> DataFrame:
    """The tree, a written table (d, context, symbol, n, total, p, b) of the symbols seen after each context that is retained.

    p is the log10 probability of the symbol, b the log10 weight that the context and its suffixes leave to the root.
    """
    symbols = tallied.where(F.col("kind") == SYMBOL)
    lengths = F.array(*[F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("run")) for d in range(DEPTH + 1)])
    runs = symbols.select(F.explode(lengths).alias("x"), "n").groupBy("x.d", "x.run").agg(F.sum("n").alias("n"))
    runs = runs.select("d", F.shiftright("run", 8).alias("context"), F.col("run").bitwiseAND(255).cast("int").alias("symbol"), "n")
    totals = runs.groupBy("d", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.collect_list(F.struct("symbol", "n")).alias("next"))
    runs = stash(totals.where((F.col("d") == 0) | (F.col("total") >= LEAST)).select("d", "context", "total", "kinds", F.inline("next")), "runs")
    root = F.log10((F.col("n") + 0.5) / (F.col("total") + 0.5 * 256))
    levels = [stash(runs.where("d = 0").select("d", "context", "symbol", "n", "total", root.alias("p"), F.lit(0.0).alias("b"), F.lit(0.0).alias("up")), "level")]
    for d in range(1, DEPTH + 1):
        up = levels[-1].select(F.col("context").alias("parent"), F.col("symbol").alias("s"), F.col("p").alias("up"), F.col("b").alias("up_b"))
        here = runs.where(F.col("d") == d).withColumn("parent", F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1))
        met = here.join(up, (here["parent"] == up["parent"]) & (here["symbol"] == up["s"]))
        p = F.log10((F.col("n") + F.col("kinds") * F.pow(F.lit(10.0), "up")) / (F.col("total") + F.col("kinds")))
        b = F.col("up_b") + F.log10(F.col("kinds") / (F.col("total") + F.col("kinds")))
        levels.append(stash(met.select("d", "context", "symbol", "n", "total", p.alias("p"), b.alias("b"), "up"), "level"))
    told = levels[0]
    for level in levels[1:]:
        told = told.unionByName(level)
    share = F.col("n") / F.col("total")
    gain = F.sum(share * (F.ln(share) - F.col("up") * F.ln(F.lit(10.0))))
    apart = told.where("d > 0").groupBy("d", "context").agg(gain.alias("gain"), F.max("total").alias("total")).where((F.col("gain") >= DIVERGENCE) & (F.col("gain") * F.col("total") >= EVIDENCE))
    # with the runs inside a context, which are at least as frequent
    inside = F.flatten(F.transform(F.sequence(F.lit(1), "d"), lambda k: F.transform(F.sequence(F.lit(0), F.col("d") - k), lambda x: F.struct(k.alias("d"), _part("context", k, x).alias("context")))))
    kept = apart.select(F.explode(inside).alias("x")).select("x.d", "x.context").distinct()
    return stash(told.where("d = 0").unionByName(told.join(kept, ["d", "context"], "left_semi")).drop("up"), "tree")


def _part(context: str, length, shift):
    """The symbols of a context before its last ``shift`` ones, as many as ``length``."""
    right, low = (F.call_function(f, F.col(context) if f == "shiftright" else F.lit(1).cast("long"), n) for f, n in (("shiftright", shift * 8), ("shiftleft", length * 8)))
    return right.bitwiseAND(low - 1)


def learned(tree: DataFrame) -> SuffixTree:
    """The automaton of the most frequent contexts of a written tree, and the filter over the others."""
    contexts = tree.groupBy("d", "context").agg(F.max("total").alias("n"))
    least = least_common(contexts, HEAD)
    got = tree.where((F.col("d") == 0) | (F.col("total") >= least)).select("context", "d", "symbol", "n").toArrow()
    column = lambda k: got[k].to_numpy().astype(np.int64)
    out = grown(column("context"), column("d"), column("symbol"), column("n"))
    others = contexts.where((F.col("d") > 0) & (F.col("n") < least))
    count = others.count()
    if count:
        bits = filter_bits(count)
        slot = _slot(F.col("context"), F.col("d")) % (1 << bits)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
        words = others.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("mask")).toArrow()  # 2^19 at most
        out.beyond = np.zeros(1 << bits - 6, np.uint64)
        out.beyond[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def resolved(codes: DataFrame, tree: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of each distinct symbol with its context, a column key of codes, by the longest suffix that the tree has."""
    keys = F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("key", 8).bitwiseAND((1 << 8 * d) - 1).alias("context"), s.alias("symbol")) for d in range(DEPTH + 1) for s in (F.col("key").bitwiseAND(255).cast("int"), F.lit(-1))])
    wanted = codes.select("key", F.explode(keys).alias("x")).select("key", "x.d", "x.context", "x.symbol")
    seen = tree.select("d", "context", "symbol", (F.col("p") - F.col("b")).alias("v"))
    left = tree.groupBy("d", "context").agg(F.lit(-1).alias("symbol"), F.max("b").alias("v"))
    total = tree.where("d = 0").agg(F.max("total")).first()[0]
    found = wanted.join(seen.unionByName(left), ["d", "context", "symbol"])
    own = F.max_by(F.when(F.col("symbol") >= 0, F.col("v")), F.when(F.col("symbol") >= 0, F.col("d")))
    weight = F.max_by(F.when(F.col("symbol") < 0, F.col("v")), F.when(F.col("symbol") < 0, F.col("d")))
    # a byte never seen has half a count
    return found.groupBy("key").agg((F.coalesce(own, F.log10(F.lit(0.5 / (total + 0.5 * 256)))) + weight).alias("value"))


_DEALT = "part int, words array<long>, times array<long>, codes array<long>, often array<long>"


def _dealt(words: list[np.ndarray], times: list[np.ndarray], codes: list[np.ndarray], often: list[np.ndarray]) -> pa.ListArray:
    """For each text its parts that hold anything: the part's number, words and how often they come, symbols and how often they come."""

    def cells(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate(keys).astype(np.int64)
        cell = np.repeat(np.arange(len(keys)), [len(k) for k in keys]) * PARTS + flat % PARTS
        order = np.argsort(cell, kind="stable")
        return np.bincount(cell, minlength=len(keys) * PARTS), flat[order], np.concatenate(counts).astype(np.int64)[order]

    (n_words, *of_words), (n_codes, *of_codes) = cells(words, times), cells(codes, often)
    used = np.flatnonzero(n_words + n_codes)
    lists = []
    for n, flat in ((n_words, of_words), (n_codes, of_codes)):
        ends = pa.array(np.concatenate([[0], np.cumsum(n[used])]).astype(np.int32))
        lists += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]
    parts = pa.StructArray.from_arrays([pa.array((used % PARTS).astype(np.int32)), *lists], ["part", "words", "times", "codes", "often"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(used, np.arange(len(words) + 1) * PARTS).astype(np.int32)), parts)


def _distinct_codes(scored: DataFrame) -> DataFrame:
    """The distinct symbols of rare contexts; a task passes on those that it gathers once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(tally.take()[0].view(np.int64))], ["key"])
        for batch in batches:
            tally.add(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if len(tally) > GATHERED:
                yield out()
        yield out()

    return scored.select(F.flatten("parts.codes").alias("codes")).mapInArrow(run, "key long").distinct()


def _met(scored: DataFrame, figures: DataFrame, unseen: float) -> DataFrame:
    """(row, known, base, score): for each part of a text the sums of the figures (kind, key, value) of its words and symbols."""
    chunks = max(1, -(-scored.count() // MET))
    parts = scored.select("row", F.explode("parts").alias("x")).select("row", "x.*").withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    told = figures.withColumn("part", F.pmod("key", F.lit(PARTS)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def meet(texts: pa.Table, values: pa.Table) -> pa.Table:
        kind, key, value = (values[c].to_numpy() for c in ("kind", "key", "value"))

        def of(which: int, keys: str, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            lists = texts[keys].combine_chunks()
            text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat, n = lists.flatten().to_numpy(zero_copy_only=False), texts[counts].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            own = np.flatnonzero(kind == which)
            own = own[np.argsort(key[own])]
            if not len(own):
                return text, n, np.zeros(len(flat), bool), np.zeros(len(flat))
            at = np.minimum(np.searchsorted(key[own], flat), len(own) - 1)
            return text, n, key[own][at] == flat, value[own][at]

        sums = lambda text, x: np.bincount(text, x, len(texts)).astype(float)
        text, n, found, x = of(WORD, "words", "times")
        known, base = sums(text, n * found), sums(text, n * np.where(found, x, unseen))
        text, n, found, x = of(SYMBOL, "codes", "often")
        return pa.table({"row": texts["row"], "known": pa.array(known.astype(np.int64)), "base": pa.array(base), "score": pa.array(sums(text, n * np.where(found, x, 0.0)))})

    return parts.groupBy("part", "chunk").cogroup(told.groupBy("part", "chunk")).applyInArrow(meet, "row long, known long, base double, score double")


def least_common(counted: DataFrame, most: int) -> int:
    """The least count n such that at most ``most`` rows of ``counted`` have it or more, to a quarter of a power of two."""
    steps = counted.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    least, held = 1 << 62, 0
    for r in steps:  # a few hundred at most
        held += r["rows"]
        if held > most:
            break
        least = r["n"]
    return least


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remainder: int = 1) -> DataFrame:
    """A row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that :func:`held_out` doesn't name; a null id is never held out.  A null text counts as an
    empty one, whose only token is its end.  Repeated rows are learned from and scored as often as they come; other columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tallied = stash(counts(rows.where(~held_out(F.col("doc_id"), remainder))), "counts")
    contexts = retained(tallied)
    tree = learned(contexts)
    words = tallied.where(F.col("kind") == WORD).select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = least_common(words, COMMON)
    common = words.where(F.col("n") >= least).toArrow()
    order = np.argsort(common["key"].to_numpy())
    keys, of_key = common["key"].to_numpy()[order], common["n"].to_numpy()[order]
    whole = total + 0.5 * (distinct + 1)
    # words outside this table are looked up only if it doesn't hold all words
    complete = len(keys) == distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                scores, codes, often = tree.scores(part)
                n, base, known, rare, times = [], [], [], [], []
                for h in word_hashes(part):
                    word, x = np.unique(np.append(h, np.uint64(END_HASH)).view(np.int64), return_counts=True)
                    place = np.minimum(np.searchsorted(keys, word), max(0, len(keys) - 1))
                    found = keys[place] == word if len(keys) else np.zeros(len(word), bool)
                    c = np.where(found, of_key[place], 0) if len(keys) else np.zeros(len(word))
                    done = found | complete
                    n.append(len(h) + 1)
                    known.append(int(x[found].sum()))
                    base.append(float((x[done] * np.log10((c[done] + 0.5) / whole)).sum()))
                    rare.append(word[~done])
                    times.append(x[~done])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(scores), _dealt(rare, times, codes, often)],
                    ["doc_id", "row", "n_tokens", "known", "base", "score", "parts"],
                )

    scored = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, f"doc_id long, row long, n_tokens long, known long, base double, score double, parts array<struct<{_DEALT.replace(' ', ': ').replace(',:', ',')}>>"
    )
    if not complete or tree.beyond is not None:
        # rare words and symbols of rare contexts meet their figures part by part
        scored = stash(scored, "scored")
        figures = words.where(F.col("n") < least).select(F.lit(WORD).alias("kind"), "key", F.log10((F.col("n") + 0.5) / F.lit(whole)).alias("value"))
        figures = figures.unionByName(resolved(_distinct_codes(scored), contexts).select(F.lit(SYMBOL).alias("kind"), "key", "value"))
        met = _met(scored, figures, float(np.log10(0.5 / whole)))
        sums = scored.drop("parts").unionByName(met, allowMissingColumns=True).groupBy("row")
        scored = sums.agg(*[F.max(c).alias(c) for c in ("doc_id", "n_tokens")], *[F.sum(c).alias(c) for c in ("known", "base", "score")])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), remainder).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
