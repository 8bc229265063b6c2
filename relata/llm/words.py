"""Vectorised words, shingles and hashes over a block of texts (numpy, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

BLOCK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice alone."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
    total = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def with_text(batch: pa.RecordBatch, place: int) -> pa.RecordBatch:
    """A batch whose first column is a struct ``row``, with its field at ``place`` as ``text`` (nothing is copied)."""
    text = batch.column(0).field(place).cast(pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])


def by_key(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.Array], int | None]]:
    """Columns of whole keys (the first column, sorted), or the value of a key of more than ``most`` rows."""
    rest, hot = None, None
    for batch in batches:
        key = np.asarray(batch.column(0))
        if hot is not None:
            batch = batch.slice(int(np.searchsorted(key, hot, "right")))
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        key = np.asarray(batch.column(0))
        cut = int(np.searchsorted(key, key[-1]))
        rest, hot = batch.slice(cut), None
        if cut:
            yield batch.slice(0, cut).columns, None
        if rest.num_rows > most:
            hot, rest = int(key[-1]), None
            yield [], hot
    if rest is not None:
        yield rest.columns, None


@dataclass
class Words:
    """Words of n texts: bytes ``buf``, word spans ``start:end`` in it, ``first[i]:first[i+1]`` the words of text i.

    In ``buf`` one byte of white space stands between two words of a text, a space if ``fold``.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its texts (a null is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def split(column: pa.Array, lower: bool = False, fold: bool = True) -> Words:
    buf, off = raw(column)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate(([True], space[:-1])) if n else np.zeros(0, bool)
    if fold and n:
        gone = space & before & ~edge[:-1]
        if gone.any():
            keep = ~gone
            moved = np.concatenate(([0], np.cumsum(keep)))
            buf, space, off = buf[keep], space[keep], moved[off]
            n = len(buf)
            edge = np.zeros(n + 1, bool)
            edge[off] = True
            before = np.concatenate(([True], space[:-1]))
        if space.any():
            buf = np.where(space, np.uint8(32), buf)
    start = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.concatenate((space[1:], [True])) if n else np.zeros(0, bool)
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    return Words(buf, start, end, np.searchsorted(start, off))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all k-word shingles and, for each text, the first one's index.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    n = w.n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    word = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], count)
    last = np.minimum(word + k, np.repeat(w.first[1:], count)) - 1
    return w.start[word], w.end[last], first


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _rotl(acc + x * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte spans ``start:end`` of ``buf``."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    u64 = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    u32 = np.ndarray((len(buf) + 1,), "<u4", padded.data, 0, (1,))
    with np.errstate(over="ignore"):
        for lo in range(0, len(start), 1 << 18):
            hi = lo + (1 << 18)
            out[lo:hi] = _xxh64(padded, u64, u32, start[lo:hi], size[lo:hi], seed)
    return out


def _xxh64(buf, u64, u32, start, size, seed):
    seed64 = np.uint64(seed)
    acc = seed64 + _P5 + size.astype(np.uint64)
    at = start.astype(np.int64, copy=True)
    left = size.astype(np.int64, copy=True)
    huge = np.flatnonzero(size > 512)
    long = np.flatnonzero((size >= 32) & (size <= 512))
    if len(long):
        p, rest = at[long], left[long]
        v = [np.full(len(long), x, np.uint64) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
        live = np.arange(len(long))
        while len(live):
            q = p[live]
            for i in range(4):
                v[i][live] = _round(v[i][live], u64[q + 8 * i])
            p[live] += 32
            rest[live] -= 32
            live = live[rest[live] >= 32]
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        zero = np.uint64(0)
        for x in v:
            h = (h ^ _round(zero, x)) * _P1 + _P4
        acc[long] = h + size[long].astype(np.uint64)
        at[long], left[long] = p, rest
    left[huge] = 0
    for _ in range(3):
        live = np.flatnonzero(left >= 8)
        if not len(live):
            break
        k = _rotl(u64[at[live]] * _P2, 31) * _P1
        acc[live] = _rotl(acc[live] ^ k, 27) * _P1 + _P4
        at[live] += 8
        left[live] -= 8
    live = np.flatnonzero(left >= 4)
    if len(live):
        acc[live] = _rotl(acc[live] ^ (u32[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[live] += 4
        left[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(left >= 1)
        if not len(live):
            break
        acc[live] = _rotl(acc[live] ^ (buf[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
        left[live] -= 1
    acc ^= acc >> np.uint64(33)
    acc *= _P2
    acc ^= acc >> np.uint64(29)
    acc *= _P3
    acc ^= acc >> np.uint64(32)
    for i in huge:
        acc[i] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + size[i]].tobytes(), seed)
    return acc


def word_hashes(w: Words, seed: int = 42) -> np.ndarray:
    return xxh64(w.buf, w.start, w.end, seed)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def gram_hashes(h: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of the words at the given offsets from each position, for all positions with all of them."""
    n = len(h) - max(offsets)
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for j, o in enumerate(offsets):
                out = (out + h[o : o + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
                out ^= out >> np.uint64(29)
    return out
