"""Byte-level BPE encoding and decoding with a published vocabulary.

Text is split into short words by the vocabulary's pattern.  A word is a row of a contiguous array: the tokens between
its part boundaries and the rank of each adjacent pair.  The least rank is found by a scan, its boundary is deleted
by moving the rest of the row one place down, and the two neighbouring ranks are looked up anew, until no pair has
a rank.  All new words of a slice of texts are worked on side by side; words seen before come from a bounded memo.
Words too long for an array row take their merges from a heap of (rank, place), with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogena.llm.common import in_small_batches
from orogena.llm.kernels import slices

#: The blanks that the published split pattern means by \\s.
_S = r"\t-\r \x85\xa0  -     　"


#: Words of up to this many bytes are rows of arrays.
ROW = 48
#: Words that a task remembers at most.
MEMO = 150_000
NO_RANK = np.int32(2**31 - 1)


def _pattern(letter: str, number: str) -> str:
    """The published split pattern, with its classes spelled out."""
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{_S}{letter}{number}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def _latin(kind: str) -> str:
    return "".join(regex.escape(c) for c in map(chr, range(256)) if regex.match(rf"\p{{{kind}}}", c))


#: The standard library's engine is the faster one where it can hold a class as a bitmap.
SPLIT, SPLIT_LATIN = regex.compile(_pattern(r"\p{L}", r"\p{N}")), re.compile(_pattern(_latin("L"), _latin("N")))


def split(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return SPLIT.findall(text)
    return SPLIT_LATIN.findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in set(plain) else next(spare)): b for b in range(256)}


class ByteBpe:
    """Encoder and decoder for a vocabulary in the ``tokenizers`` library's JSON form (byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        vocab = file["model"]["vocab"]
        by_id = {i: bytes(letters[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.piece = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.piece_size = np.array([len(x) for x in self.piece], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.pieces = np.frombuffer(b"".join(self.piece), np.uint8)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed([*enumerate(merges)])}
        keys = sorted((a << 32 | b, r, to) for (a, b), (r, to) in self.pairs.items())
        self.pair_key, self.pair_rank = np.array([k for k, _, _ in keys], np.int64), np.array([r for _, r, _ in keys], np.int32)
        self.rank_to = np.full(len(merges), -1, np.int32)
        for r, to in self.pairs.values():
            self.rank_to[r] = to
        pair = np.arange(1 << 16)
        self.byte_rank = self._ranks(self.of_byte[pair >> 8], self.of_byte[pair & 255]).astype(np.int32)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        """Forget the words seen: slot by word, and the tokens of all slots in one array."""
        self.slot: dict[str, int] = {}
        self.flat, self.at, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.filled = 0

    # -- words ------------------------------------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (right >= 0), self.pair_rank[at], NO_RANK)

    def _rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Tokens of words of at most ``width`` bytes, all in one contiguous array."""
        n, sizes = len(words), np.array([len(w) for w in words])
        inside = np.arange(width) < sizes[:, None]
        tokens = np.full((n, width + 1), -1, np.int32)
        raw = np.frombuffer(b"".join(words), np.uint8)
        tokens[:, :width][inside] = self.of_byte[raw]
        ranks = np.full((n, width + 1), NO_RANK, np.int32)
        pairs = np.full(len(raw), NO_RANK, np.int32)
        pairs[:-1] = self.byte_rank[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        pairs[np.cumsum(sizes) - 1] = NO_RANK
        ranks[:, :width][inside] = pairs
        live, done = np.arange(n), np.full((n, width + 1), -1, np.int32)
        cols = np.arange(width)
        while len(live):
            j = ranks.argmin(axis=1)
            i = np.arange(len(live))
            r = ranks[i, j]
            over = r == NO_RANK
            if over.any():
                done[live[over]] = tokens[over]
                going = ~over
                live, tokens, ranks, j, r = live[going], tokens[going], ranks[going], j[going], r[going]
                i = np.arange(len(live))
                if not len(live):
                    break
            tokens[i, j] = self.rank_to[r]
            # the boundary after place j goes: what follows moves down one place
            tokens[:, 1:-1] = np.where(cols[1:] > j[:, None], tokens[:, 2:], tokens[:, 1:-1])
            tokens[:, -1] = -1
            ranks[:, :-1] = np.where(cols >= j[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            ranks[i, j] = self._ranks(tokens[i, j], tokens[i, np.minimum(j + 1, width)])
            before = j > 0
            k, jb = i[before], j[before] - 1
            ranks[k, jb] = self._ranks(tokens[k, jb], tokens[k, jb + 1])
        return [row[:m] for row, m in zip(done, (done >= 0).sum(axis=1))]

    def _long(self, word: bytes) -> np.ndarray:
        """Tokens of one long word, in n log n."""
        tok: list[int] = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(*x, i, tok[i], tok[i + 1]) for i in range(n - 1) if (x := self.pairs.get((tok[i], tok[i + 1])))]
        heap = [(r, i, to, a, b) for r, to, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            r, i, to, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = to, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if x := self.pairs.get((to, tok[k])):
                    heapq.heappush(heap, (x[0], i, x[1], to, tok[k]))
            if (h := before[i]) >= 0 and (x := self.pairs.get((tok[h], to))):
                heapq.heappush(heap, (x[0], h, x[1], tok[h], to))
        return np.array([t for t in tok if t >= 0], np.int32)

    def _learn(self, words: list[str]) -> None:
        """Give each new word a slot and its tokens."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw])
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        low = 0
        for width in (4, 6, 8, 10, 12, 16, 24, ROW):
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            for part in np.array_split(some, max(1, len(some) // 20_000)):
                if len(part):
                    for i, x in zip(part, self._rows([raw[i] for i in part], width)):
                        out[i] = x
            low = width
        for i in np.flatnonzero(sizes > ROW):
            out[i] = self._long(raw[i])
        first, n = len(self.slot), len(words)
        flat = np.concatenate(out)
        counts = np.array([len(x) for x in out], np.int64)
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.size[first : first + n] = counts
        self.at[first : first + n] = self.filled + np.cumsum(counts) - counts
        self.filled += len(flat)
        self.slot.update(zip(words, range(first, first + n)))

    def _tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words in order, and how many each word has."""
        if len(self.slot) > MEMO or self.filled > 8 * MEMO:
            self.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.slot]:
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        return gathered(self.flat, self.at[slots], self.size[slots]), self.size[slots]

    # -- texts ------------------------------------------------------------------------------------------

    def _parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; a special token's own text is that token."""
        if len(texts) == 1 and len(texts[0]) > 1 << 20:
            return [self._encode_long(texts[0])]
        words: list[str] = []
        ends: list[int] = []
        specials: list[tuple[int, int]] = []
        for text in texts:
            parts = self._parts(text)
            for k, part in enumerate(parts):
                if k % 2:
                    specials.append((len(words), self.special[part]))
                    words.append("")
                else:
                    words += split(part)
            ends.append(len(words))
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        flat, sizes = self._tokens(words)
        if specials:
            place = np.cumsum(sizes) - sizes
            at = [p for p, _ in specials]
            flat = np.insert(flat, place[at], [t for _, t in specials])
            sizes = sizes.copy()
            sizes[at] += 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.split(flat, total[ends][:-1])

    def _encode_long(self, text: str) -> np.ndarray:
        out: list[np.ndarray] = [np.zeros(0, np.int32)]
        for k, part in enumerate(self._parts(text)):
            if k % 2:
                out.append(np.array([self.special[part]], np.int32))
                continue
            found = (m.group() for m in SPLIT.finditer(part))
            while words := list(islice(found, 100_000)):
                out.append(self._tokens(words)[0])
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        out = [gathered(self.pieces, self.piece_at[x], self.piece_size[x]).tobytes() for x in np.array_split(ids, max(1, len(ids) // 200_000))]
        return b"".join(out).decode("utf-8", "replace")


def gathered(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[at:at+size], one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """The vocabulary at a path that every machine has; read once in each Python worker."""
    return ByteBpe(path)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """For each document: id, n_tokens, digests of its token ids and of the text decoded from them.

    ``vocabulary`` is the path of the vocabulary file on every machine.  No exchange: each task encodes what it
    reads, a slice of texts at a time; a text longer than a slice is worked on alone, in runs of words.
    A null text counts as an empty one, which has no tokens; null ids and repeated rows are carried as they are;
    columns ``carried`` come behind, others are ignored; an empty table gives an empty result.
    """
    more = docs.select(*(carried or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, part in slices(batch.column(1)):
                for ids in bpe.encode_batch([x.decode() for x in part]):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *batch.columns[2:]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *names])

    names = list(carried or [])
    schema = ", ".join([OUT, *(f"{c} {kind}" for c, kind in more.dtypes)])
    in_small_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *names).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token ids of each document: (doc_id, ids array<int>). Nulls as in :func:`bpe_round_trip`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for at, part in slices(batch.column(1)):
                out = bpe.encode_batch([x.decode() for x in part])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """The text of each row of :func:`encode`'s result: (doc_id, text). Null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            out = [bpe.decode(np.asarray(x.values, np.int32) if x.is_valid else np.zeros(0, np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
