"""Line dedup: exact and near-equal lines, by a segment-partition edit join.

A line is what stands between line feeds, without the white space at its ends; only lines with a
word count, and only those of ``min_chars`` characters or more. Exact duplicates are found by a
128-bit hash. Lines of ``min_fuzzy`` characters or more are near-equal at an edit distance of
``tau`` or less (shorter ones are too short to be judged by it):

* a line is cut into tau + 1 even segments, of which an edit distance of tau leaves at least one
  untouched, so each goes to an index keyed by its number, the line's length and its hash;
* every line probes the lengths from its own down to tau less, for each segment only at the places
  that the difference in length and the segment's number leave possible (a probe at a line's own
  segments is the index row itself);
* rows of a key meet in sorted order and are paired if the counts of 16 classes of characters allow
  the distance; a pair is then verified on the texts by banded bit-parallel edit distance;
* a crowded key, of more than HOT_ROWS rows or CROWD pairs a line, sends no pairs. Its rows are
  joined with their texts, dealt to a grid of index blocks by probe blocks if they are many, and each
  cell verifies its candidates in place and sends a spanning forest of the links it found.

Links of near-equal lines form groups; of each group the first line by (id, number of the line)
stays and all others go. Segments travel as hashes, texts only for lines of a candidate pair, read
from the first document that has them.

Rows of the same id are one document, a null id is an id, null and empty texts have no line,
repeated rows add nothing. Two lines with the same first 64 bits of their hash and different
others, should there be any, are only matched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import components, join_counted, materialize, packed, table

TAU = 2
MIN_CHARS = 1
MIN_FUZZY = 16
HOT_ROWS = 200_000
HOT_BYTES = 32 << 20
CROWD = 4
BROADCAST_LINES = 1_000_000
BROADCAST_GONE = 2_000_000

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[object, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n + 1 powers, kept for the next block."""
    if base not in _TABLES or len(_TABLES[base]) <= n:
        with np.errstate(over="ignore"):
            _TABLES[base] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 20), base, np.uint64), dtype=np.uint64)))
    return _TABLES[base][: n + 1]


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each code point, and a one in the digit of its class of 16."""
    if "value" not in _TABLES:
        v = _TABLES["value"] = words.mixed(np.arange(1, 0x110001, dtype=np.uint64))
        _TABLES["class"] = np.uint64(1) << ((v >> np.uint64(60)) * np.uint64(4))
    return _TABLES["value"], _TABLES["class"]


def _strip(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Move the ends of spans past white space."""
    for at, step in ((start, 1), (end, -1)):
        live = np.arange(len(start))
        for turn in range(65):
            live = live[start[live] < end[live]]
            live = live[words._SPACE[buf[at[live] if step > 0 else at[live] - 1]]]
            if not len(live):
                break
            if turn == 64:  # long runs of spaces
                for i in live.tolist():
                    solid = np.flatnonzero(~words._SPACE[buf[start[i] : end[i]]])
                    at[i] = (start[i] + (solid[0] if step > 0 else solid[-1] + 1)) if len(solid) else (end[i] if step > 0 else start[i])
                break
            at[live] += step


class Lines:
    """Lines with a word of a block of texts: byte spans, owner, number and size in characters of each."""

    def __init__(self, column: pa.Array, min_chars: int):
        buf, off = words.raw(column)
        breaks = np.flatnonzero(buf == 10)
        text = np.searchsorted(off, breaks, "right") - 1
        many = 1 + np.bincount(text, minlength=len(column))
        first = np.concatenate(([0], np.cumsum(many)))
        start, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
        start[first[:-1]], end[first[1:] - 1] = off[:-1], off[1:]
        nth = np.arange(len(breaks)) + text
        start[nth + 1], end[nth] = breaks + 1, breaks
        _strip(buf, start, end)
        n = end - start
        if len(buf) and buf.max() >= 0x80:
            more = np.concatenate((np.zeros(1, np.int64), np.cumsum((buf & 0xC0) == 0x80)))
            n -= more[end] - more[start]
        ok = np.flatnonzero(n >= max(1, min_chars))
        self.data = buf.tobytes()
        self.start, self.end, self.n = start[ok], end[ok], n[ok]
        owner = np.repeat(np.arange(len(column)), many)
        self.owner, self.number = owner[ok], (np.arange(first[-1]) - first[:-1][owner])[ok]
        hashes = [xxhash.xxh3_128_digest(self.data[a:b]) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]
        self.h1, self.h2 = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2).T.copy()

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].decode("utf-8", "replace")


class Points:
    """Code points of some lines, one after the other: spans, sums of classes, and sums of powers."""

    def __init__(self, lines: Lines, pick: np.ndarray):
        parts = [lines.data[a:b] for a, b in zip(lines.start[pick].tolist(), lines.end[pick].tolist(), strict=True)]
        c = np.frombuffer(b"".join(parts).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        self.n = lines.n[pick]
        if self.n.sum() != len(c):  # bytes that are no UTF-8
            self.n = np.array([len(x.decode("utf-8", "replace")) for x in parts], np.int64)
            c = np.frombuffer("".join(x.decode("utf-8", "replace") for x in parts).encode("utf-32-le"), np.uint32)
        self.start = np.cumsum(self.n) - self.n
        value, kind = _letters()
        zero = np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            self.kinds = np.concatenate((zero, np.cumsum(kind[c], dtype=np.uint64)))
            self.sums = np.concatenate((zero, np.cumsum(value[c] * _powers(_BASE, len(c))[:-1], dtype=np.uint64)))
        self.back = _powers(_INVERSE, len(c))

    def signature(self) -> np.ndarray:
        """Counts of 16 classes of characters of each line, as digits of base 16 modulo 2 ** 64.

        Digits carry into the next, but the difference of two signatures has the differences of the
        counts as its balanced digits as long as these are small, and so they are for near-equal lines.
        """
        with np.errstate(over="ignore"):
            return self.kinds[self.start + self.n] - self.kinds[self.start]

    def key(self, at: np.ndarray, size: np.ndarray, i: int, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[at + size] - self.sums[at]) * self.back[at]
            return words.mixed(h + words.mixed(length.astype(np.uint64) * np.uint64(64) + np.uint64(i + 1)))


def segments(n: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of n characters; the last ones are the longer."""
    k = tau + 1
    short, more = n // k, n % k
    longer = np.maximum(0, i - (k - more))
    return short * i + longer, short + (i >= k - more)


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(difference in length, segment, shift) that a match can have."""
    return [(d, i, s) for d in range(tau + 1) for i in range(tau + 1) for s in range(max(-i, d - (tau - i)), min(i, d + tau - i) + 1)]


def segment_rows(lines: Lines, tau: int, min_fuzzy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, probe's difference in length or -1 for an index row, line, signature).

    An index row is also the probe of its own key, of difference 0.
    """
    _, pick = np.unique(lines.h1, return_index=True)
    pick = pick[lines.n[pick] >= min_fuzzy]
    p = Points(lines, pick)
    n, start, sign = p.n, p.start, p.signature()
    keys, side, who = [], [], []
    for d, i, s in probes(tau):
        at, size = segments(n - d, i, tau)
        ok = np.flatnonzero((at + s >= 0) & (at + s + size <= n) & (n - d >= min_fuzzy))
        keys.append(p.key((start + at + s)[ok], size[ok], i, (n - d)[ok]))
        side.append(np.full(len(ok), d if d or s else -1, np.int8))
        who.append(ok)
    who = np.concatenate(who)
    return np.concatenate(keys).view(np.int64), np.concatenate(side), lines.h1[pick][who], sign[who].view(np.int64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the absolute balanced digits of the difference of two signatures."""
    with np.errstate(over="ignore"):
        d = x - y + np.uint64(0x8888888888888888)
    out = np.zeros(d.shape, np.int16)
    for k in range(16):
        out += np.abs(((d >> np.uint64(4 * k)) & np.uint64(15)).astype(np.int16) - 8)
    return out


INDEX_ONLY = -2


def run_pairs(side: np.ndarray, line: np.ndarray, sign: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among the rows of one key. ``side`` may be INDEX_ONLY for a row that doesn't probe."""
    index = np.flatnonzero(side < 0)
    index = index[np.unique(line[index], return_index=True)[1]]
    probe = np.flatnonzero(side != INDEX_ONLY)
    shorter = np.maximum(side[probe], 0)
    pick = np.unique(np.stack((line[probe], shorter)), axis=1, return_index=True)[1]
    probe, shorter = probe[pick], shorter[pick]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 20) // max(1, len(probe)))
    most = (2 * tau - shorter).astype(np.int16)
    for lo in range(0, len(index), step):
        m = index[lo : lo + step]
        ok = _apart(sign[m][:, None], sign[probe][None, :]) <= most[None, :]
        ok &= (line[m][:, None] < line[probe][None, :]) | ((shorter > 0)[None, :] & (line[m][:, None] != line[probe][None, :]))
        x, y = np.nonzero(ok)
        a.append(np.minimum(line[m[x]], line[probe[y]]))
        b.append(np.maximum(line[m[x]], line[probe[y]]))
    return np.concatenate(a), np.concatenate(b)


def within(a: str, b: str, tau: int) -> bool:
    """Edit distance of at most tau: sets of diagonals reached with each number of edits, as bits."""
    if abs(len(a) - len(b)) > tau:
        return False
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return True
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    full = (1 << (2 * tau + 1)) - 1
    state = [0] * (tau + 1)
    for e in range(tau + 1):
        state[e] = full & (((2 << e) - 1) << tau)  # e characters of a dropped
    for j, c in enumerate(b):
        match = 0
        for d in range(-tau, tau + 1):
            i = j + d
            if 0 <= i < len(a) and a[i] == c:
                match |= 1 << (tau + d)
        before, state[0] = state[0], state[0] & match
        for e in range(1, tau + 1):
            was = state[e]
            state[e] = full & ((was & match) | before | (before >> 1) | (state[e - 1] << 1))
            before = was
        if not state[tau]:
            return False
    return bool(state[tau] >> (tau + len(a) - len(b)) & 1)


def occurrences(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(id, number, h1, h2) of every line that counts."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, "text"):
                x = Lines(b.column("text"), min_chars)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x.owner)), pa.array(x.number), pa.array(x.h1), pa.array(x.h2)], names=["id", "number", "h1", "h2"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, number long, h1 long, h2 long")


def distinct_lines(docs: DataFrame, id_col: str, text: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """All occurrences, and (h1, h2, same, n): each different line with its first place and its number of places."""
    occ = materialize(occurrences(docs, id_col, text, min_chars).distinct(), "lines")
    lines = occ.groupBy("h1", "h2").agg(F.min(F.struct("id", "number")).alias("same"), F.count(F.lit(1)).alias("n"))
    return occ, materialize(lines, "distinct")


def promising(key: np.ndarray, side: np.ndarray, line: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of keys with an index row and more than one line."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    stop = np.append(begin[1:], len(key))
    n_index = np.add.reduceat((side < 0).astype(np.int64), begin)
    several = np.add.reduceat(np.concatenate(([0], (line[1:] != line[:-1]) & (key[1:] == key[:-1]))), begin)
    yield from zip(begin[(several > 0) & (n_index > 0)].tolist(), stop[(several > 0) & (n_index > 0)].tolist(), strict=True)


def forest(side: np.ndarray, line: np.ndarray, sign: np.ndarray, said: list[str], tau: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the lines of a cell that are within ``tau``."""
    place = {}
    for i, x in enumerate(line.tolist()):
        place.setdefault(x, i)
    up = np.arange(len(line))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    a, b = [], []
    index = np.flatnonzero(side < 0)
    probing = np.flatnonzero(side != INDEX_ONLY)
    for lo in range(0, len(index), 256):
        some = index[lo : lo + 256]
        block = np.concatenate((some, probing))
        which = np.concatenate((np.full(len(some), INDEX_ONLY, np.int8), np.maximum(side[probing], 0)))
        x, y = run_pairs(which, line[block], sign[block], tau)
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            i, j = root(place[u]), root(place[v])
            if i != j and within(said[place[u]], said[place[v]], tau):
                up[max(i, j)] = min(i, j)
                a.append(u)
                b.append(v)
    return a, b


def near_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS, min_fuzzy: int = MIN_FUZZY, lines: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): first 64 bits of the hashes of different lines within edit distance tau.

    The links have the components of all such pairs; of a crowded group not every pair is a link.
    """
    if lines is None:
        lines = distinct_lines(docs, id_col, text, min_chars)[1]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, "text", 1 << 20):
                key, side, line, sign = segment_rows(Lines(b.column("text"), min_chars), tau, min_fuzzy)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, side, line, sign)], names=["key", "side", "line", "sign"])

    def sent(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None = None, side: np.ndarray | None = None, sign: np.ndarray | None = None) -> pa.RecordBatch:
        """Pairs (a, b), rows of a crowded key with their line in ``a``, or a key of too many rows."""
        none = lambda x, t: pa.nulls(len(a), t) if x is None else pa.array(x, t)
        cols = [pa.array(a, pa.int64()), none(b, pa.int64()), none(key, pa.int64()), none(side, pa.int8()), none(sign, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "side", "sign"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, hot in words.by_key(batches, hot_rows):
            if hot is not None:
                yield sent(np.array([hot]), None)
                continue
            key, side, line, sign = (np.asarray(x) for x in columns)
            for lo, hi in promising(key, side, line):
                x, y = run_pairs(side[lo:hi], line[lo:hi], sign[lo:hi].view(np.uint64), tau)
                if len(x) > CROWD * (hi - lo):
                    yield sent(line[lo:hi], None, key[lo:hi], side[lo:hi], sign[lo:hi])
                elif len(x):
                    yield sent(x, y)

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(split, "key long, side byte, line long, sign long")
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(pair, "a long, b long, key long, side byte, sign long")
    met = materialize(met, "pairs")
    pairs = met.where("b is not null").select("a", "b").distinct()
    crowd = met.where("key is not null").select("key", "side", F.col("a").alias("line"), "sign")
    hot = met.where("b is null and key is null").select(F.col("a").alias("key"))
    n_hot = hot.count()
    if n_hot:  # rows of keys that no task may hold are made again
        crowd = crowd.unionByName(materialize(rows.join(F.broadcast(hot) if n_hot <= BROADCAST_LINES else hot, "key"), "crowd"))
    needed = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).unionByName(crowd.select(F.col("line").alias("h1")))
    needed = materialize(needed.distinct(), "needed")
    n = needed.count()
    wanted = lines.join(F.broadcast(needed) if n <= BROADCAST_LINES else needed, "h1", "left_semi")
    wanted = wanted.groupBy(F.col("same.id").alias("id")).agg(F.collect_set(F.struct(F.col("same.number").alias("number"), "h1")).alias("wanted"))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text"))
    held = rows.join(F.broadcast(wanted) if n <= BROADCAST_LINES else wanted, F.col("doc").eqNullSafe(F.col("id"))).select("text", "wanted")

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, "text"):
                x = Lines(b.column("text"), min_chars)
                want = {(i, w["number"], w["h1"]) for i, ws in enumerate(b.column("wanted").to_pylist()) for w in ws}
                pick = [k for k, row in enumerate(zip(x.owner.tolist(), x.number.tolist(), x.h1.tolist(), strict=True)) if row in want]
                yield pa.RecordBatch.from_arrays([pa.array(x.h1[pick]), pa.array(x.h2[pick]), pa.array([x.text(i) for i in pick], pa.string())], names=["line", "rest", "said"])

    said = held.mapInArrow(texts_of, "line long, rest long, said string").groupBy("line").agg(F.min("said").alias("said"), F.count_distinct("rest").alias("n"))
    said = materialize(said.where("n = 1").drop("n"), "said")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(x, y, tau) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(said.select(F.col("line").alias("a"), F.col("said").alias("ta")), "a")
    both = both.join(said.select(F.col("line").alias("b"), F.col("said").alias("tb")), "b")
    links = both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")
    return links.unionByName(crowded_links(crowd.join(said, "line"), tau, hot_rows))


def crowded_links(rows: DataFrame, tau: int, hot_rows: int) -> DataFrame:
    """Links among (key, side, line, sign, said) of crowded keys, a forest from each cell of the grid."""
    # blocks so many that a cell has about half of the rows and bytes that a task may hold
    much = F.greatest(F.count(F.lit(1)) / hot_rows, F.sum(F.length("said")) / HOT_BYTES)
    blocks = rows.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(much * 4 - 3)).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key")
    mine = F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    index = rows.where("side < 0").select("key", F.lit(INDEX_ONLY).cast("byte").alias("side"), "line", "sign", "said", mine.alias("i"), every.alias("j"))
    probe = rows.select("key", F.greatest("side", F.lit(0).cast("byte")).alias("side"), "line", "sign", "said", every.alias("i"), mine.alias("j"))
    cells = index.unionByName(probe).select(F.xxhash64("key", "i", "j").alias("cell"), "side", "line", "sign", "said").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _ in words.by_key(batches, 1 << 62):
            key, side, line, sign = (np.asarray(x) for x in columns[:4])
            for lo, hi in promising(key, side, line):
                a, b = forest(side[lo:hi], line[lo:hi], sign[lo:hi].view(np.uint64), columns[4].slice(lo, hi - lo).to_pylist(), tau)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell", "line").mapInArrow(run, "a long, b long")


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS, min_fuzzy: int = MIN_FUZZY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, number, near): the lines that go, ``near`` if no earlier line is exactly equal.

    Of equal and near-equal lines the one of least (id, number) stays, a null id before all others.
    """
    occ, lines = distinct_lines(docs, id_col, text, min_chars)
    label = components(near_links(docs, id_col, text, tau, min_chars, min_fuzzy, lines, hot_rows))
    lines = lines.join(label.withColumnRenamed("node", "h1"), "h1", "left")
    grouped = lines.where("label is not null")
    first = grouped.groupBy("label").agg(F.min("same").alias("first"))
    # most lines have no label; in a join on it they would all be one key
    alone = lines.where("label is null").select("h1", "h2", "same", "n", F.col("same").alias("first"))
    lines = grouped.join(first, "label").select("h1", "h2", "same", "n", "first").unionByName(alone)
    lines = materialize(lines.where("n > 1 or same <> first"), "removed")
    at = F.struct(F.col("id"), F.col("number"))
    gone = join_counted(occ, lines, ["h1", "h2"], "n", occ.count())
    return gone.where(~at.eqNullSafe(F.col("first"))).select("id", "number", at.eqNullSafe(F.col("same")).alias("near"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = "n_chars", tau: int = TAU, min_chars: int = MIN_CHARS, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """``docs`` without the lines that go; a document that has lost its last word goes too.

    ``length``, if there is such a column, follows the text.
    """
    gone = materialize(removals(docs, id_col, text, tau, min_chars, min_fuzzy).groupBy("id").agg(F.collect_set("number").alias("gone")), "gone")
    n = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    frame = packed(docs, F.col(id_col).alias("key")).join(F.broadcast(gone) if n <= BROADCAST_GONE else gone, F.col("key").eqNullSafe(F.col("id")), "left")
    frame = frame.select("row", "gone")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field(place).cast(pa.string()).to_pylist()
            ok, size = np.ones(batch.num_rows, bool), [None] * batch.num_rows
            for i in np.flatnonzero(np.asarray(batch.column("gone").is_valid())):
                out = set(batch.column("gone")[i].as_py())
                texts[i] = "\n".join(x for k, x in enumerate((texts[i] or "").split("\n")) if k not in out)
                size[i] = len(texts[i])
                ok[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
            new = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(size, pa.int64())], names=["row", "text", "size"])
            yield new.filter(pa.array(ok))

    out = frame.mapInArrow(run, frame.select("row", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("size")).schema)

    def column(c: str) -> Column:
        if c == text:
            return F.col("text").cast(docs.schema[c].dataType).alias(c)
        was = F.col("row").getField(c)
        return F.coalesce(F.col("size").cast(docs.schema[c].dataType), was).alias(c) if c == length else was.alias(c)

    return out.select(*map(column, docs.columns))


def linededup_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = removals(docs).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_removed"), F.count(F.when(F.col("near"), 1)).alias("n_removed_near"))
    rows = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(gone, "doc_id", "left").select("doc_id", "n_lines", zero("n_removed"), zero("n_removed_near"))
