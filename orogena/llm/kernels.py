"""Array kernels over bytes that tasks run on slices of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Fixed odd multipliers of the hashes.
STEP, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: Bytes of text that one pass of array work takes at a time.
SLICE = 1 << 20

_BYTE_VALUE = np.random.default_rng(20_240_117).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP to the powers 0 to n, and their inverses modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        up, down = np.full(size, STEP, np.uint64), np.full(size, U(pow(int(STEP), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> U(33))
    x = x * MIX1
    x ^= x >> U(33)
    x *= MIX2
    x ^= x >> U(33)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span buf[start:end], whatever its place."""
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX2)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~_IS_BLANK[buf]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    for x in column.cast(pa.large_binary()):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts with about ``most`` bytes: the first one's index and the texts. A longer text comes alone."""
    at, run, size = 0, [], 0
    for i, x in enumerate(texts(column)):
        if run and size + len(x) > most:
            yield at, run
            at, run, size = i, [], 0
        run.append(x)
        size += len(x)
    if run:
        yield at, run


def cut(text: bytes, most: int = SLICE) -> Iterator[bytes]:
    """Parts of a text, cut at blanks where possible, that have about ``most`` bytes; no word is cut."""
    at = 0
    while len(text) - at > most:
        to = at + most
        while to < len(text) and text[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def word_hashes(run: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its words, A-Z lowered, in order."""
    if len(run) == 1 and len(run[0]) > 2 * SLICE:
        return [np.concatenate([word_hashes([x])[0] for x in cut(run[0])])]
    buf = lowered(np.frombuffer(b"\n".join(run), np.uint8))
    starts, ends = word_spans(buf)
    h = span_hashes(buf, starts, ends)
    edges = np.cumsum([len(x) + 1 for x in run])
    return np.split(h, np.searchsorted(starts, edges[:-1]))


#: The five primes of the published 64-bit xxHash.
P1, P2, P3, P4, P5 = U(11400714785074694791), U(14029467366897019727), U(1609587929392839161), U(9650029242287828579), U(2870177450012600261)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * P2, 31) * P1


def lanes(buf: np.ndarray, size: int = 8) -> np.ndarray:
    """At each place of a buffer the little-endian number of the ``size`` bytes from there; zeros follow the last byte."""
    padded = np.concatenate([buf, np.zeros(size, np.uint8)])
    return np.ndarray(len(buf) + 1, f"<u{size}", padded, strides=(1,))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit xxHash, seed 0, of each span buf[start:end]: all spans go through a step at once."""
    eight, four = lanes(buf), lanes(buf, 4)
    size = ends - starts
    h, at = np.full(len(starts), P5, np.uint64), starts.copy()
    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 32)
        if len(long):
            acc = [np.full(len(long), x, np.uint64) for x in (P1 + P2, P2, U(0), U(0) - P1)]
            going = np.arange(len(long))
            while len(going):
                which = long[going]
                for k in range(4):
                    acc[k][going] = _round(acc[k][going], eight[at[which] + 8 * k])
                at[which] += 32
                going = going[ends[which] - at[which] >= 32]
            whole = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
            for x in acc:
                whole = (whole ^ _round(np.zeros(len(long), np.uint64), x)) * P1 + P4
            h[long] = whole
        h += size.astype(np.uint64)
        going = np.flatnonzero(ends - at >= 8)
        while len(going):
            h[going] = _rotated(h[going] ^ _rotated(eight[at[going]] * P2, 31) * P1, 27) * P1 + P4
            at[going] += 8
            going = going[ends[going] - at[going] >= 8]
        going = np.flatnonzero(ends - at >= 4)
        h[going] = _rotated(h[going] ^ four[at[going]].astype(np.uint64) * P1, 23) * P2 + P3
        at[going] += 4
        going = np.flatnonzero(at < ends)
        while len(going):
            h[going] = _rotated(h[going] ^ buf[at[going]].astype(np.uint64) * P5, 11) * P1
            at[going] += 1
            going = going[at[going] < ends[going]]
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    return h


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def same_spans(eight: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from a and from b are equal, eight bytes at a time; ``eight`` has the lanes of the buffer."""
    out = np.ones(len(a), bool)
    going, done = np.flatnonzero(size > 0), 0
    while len(going):
        keep = _KEEP[np.minimum(size[going] - done, 8)]
        equal = (eight[a[going] + done] & keep) == (eight[b[going] + done] & keep)
        out[going[~equal]] = False
        done += 8
        going = going[equal]
        going = going[size[going] > done]
    return out


def span_classes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of spans with the same key, owner and bytes: the spans in an order in which classes follow one another, and where each starts.

    Spans are sorted by their key, a hash that may have collisions and in which the owner may have a part; neighbours with
    one key are compared byte by byte, and a key that holds different spans is settled by the bytes themselves.
    """
    order = np.argsort(key, kind="stable")
    if not len(order):
        return order, np.zeros(0, np.int64)
    a, b = order[:-1], order[1:]
    alike = key[a] == key[b]
    size = ends - starts
    pair = np.flatnonzero(alike)
    equal = size[a[pair]] == size[b[pair]]
    if owner is not None:
        equal &= owner[a[pair]] == owner[b[pair]]
    equal[equal] = same_spans(lanes(buf), starts[a[pair[equal]]], starts[b[pair[equal]]], size[a[pair[equal]]])
    new = np.concatenate([[True], ~alike])
    if not equal.all():
        group = np.cumsum(new)
        for g in np.unique(group[1 + pair[~equal]]):
            at = np.flatnonzero(group == g)
            told = [(-1 if owner is None else int(owner[k]), buf[starts[k] : ends[k]].tobytes()) for k in order[at]]
            by = sorted(range(len(at)), key=lambda i: told[i])
            order[at] = order[at][by]
            new[at] = [i == 0 or told[by[i]] != told[by[i - 1]] for i in range(len(at))]
    return order, np.flatnonzero(new)


def span_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    size = ends - starts
    edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = buf[np.arange(edges[-1]) + np.repeat(starts - edges[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int, rows: int = 1 << 16) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows of batches in runs whose texts have about ``most`` bytes, at most ``rows`` of them, with these texts."""
    held, run, size = [], [], 0
    for batch in batches:
        for at, part in slices(batch.column(column), most):
            n = sum(map(len, part))
            if held and (size + n > most or len(run) + len(part) > rows):
                yield pa.Table.from_batches(held), run
                held, run, size = [], [], 0
            held.append(batch.slice(at, len(part)))
            run, size = run + part, size + n
    if held:
        yield pa.Table.from_batches(held), run
