"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees.

Fingerprints are computed where the text is (no shuffle) and collapsed to distinct values, so a
group of copies is one point whatever its size. Within ``radius`` bits of each other, two 64-bit
values are within ``radius // 2`` in their upper or in their lower half; so there is a tree for
each half, and only the radius ``radius // 2`` enters its triangle bounds.

* Routing: a tree of vantage points and median distances, fitted on a bounded sample
  (``SAMPLE_PER_LEAF`` points for each of at most ``MAX_LEAVES`` shards). Every point has one home
  shard and also visits each shard that the triangle bound cannot exclude.
* In a shard the tree goes on: homes and visitors are split until few homes are left or the half is
  the same for all of them (then the other half decides, with the full radius). Pairs are verified
  on all 64 bits.
* A shard returns a spanning forest of the links found in it, at most one row for each point.

Components of these links, with the least id of each, are the duplicate groups of ``groups``.

``similar_groups`` finds texts whose sets of k-word shingles have a Jaccard similarity of ``similarity``
or more, in two steps. Two such texts differ in about 15 % of their fingerprint bits at 0.8, too many for
one radius that prunes. So a text has FULL bits in TABLES words of 32; two texts of similarity 0.8 are
within 3 bits in one of the eight words with probability 0.92, at 0.85 with 0.985, at 0.9 with 0.999. Each
word is searched by two trees as above, one for each 16 bits. In a shard the pairs that are near in a word
are held against all FULL bits (three standard deviations beyond the expectation), the near ones
first, and a spanning forest of them goes on; every edge of it is verified on the two shingle sets.

This brings most copies into groups. What it misses is then sought exactly, between different groups
only: two such sets share one of the first fifth of their shingles in any order, so sets meet under
these (``crossing``), pairs that their sizes and places don't exclude are verified, and join their groups.
Under a shingle with over PAIRS such pairs a set no pair is written, but a forest that connects the sets.
Sets so connected are a cluster, all pairs of which are counted (``clustered``): the sets are dealt into
parts, any two parts meet in a task that multiplies them, and a spanning forest of its links goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import components, join_counted, materialize, packed

MAX_LEAVES = 1 << 17
LEAF = 1024
SAMPLE_PER_LEAF = 16
TABLES = 8
FULL = 32 * TABLES
SIMILAR_LEAF = 1 << 16
BROADCAST_IDS = 1_000_000
#: Shingles that more than ORDER_OFTEN of one in ORDER_SHARE nodes have among their first come last.
ORDER_SHARE = 16
ORDER_OFTEN = 8
#: A power of two; the numbers of a set's shingles in so many buckets bound what it shares.
BUCKETS = 256
#: More pairs a set than this under one shingle are not written out; so many sets at most are held against each other.
PAIRS = 16
MEET = 1024
#: Sets and shingles of a part of a cluster, on average.
PART = 1024
PART_SHINGLES = 400_000
#: Shingles of more sets of a task than this are multiplied as a table, of so many columns at once; others are paired.
TABLED = 16
COLUMNS = 2048
_WORDS = tuple(f"f{j}" for j in range(FULL // 64))

_HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))


def fingerprint_block(column: pa.Array, k: int, many: int = 1) -> np.ndarray:
    """``many`` 64-bit majority fingerprints a text, as columns; a text without words has zeros."""
    w = words.split(column, lower=True)
    start, end, first = words.shingles(w, k)
    h = words.xxh64(w.buf, start, end)
    count = np.diff(first)
    # sums of at most 255 hashes fit the eight byte-wide counters of a word
    parts = -(-count // 255)
    owner = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(parts)))[:-1], parts)
    cut = first[:-1][owner] + 255 * nth
    out = np.zeros((len(count), many), np.uint64)
    if not len(owner):
        return out
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    texts = owner[begins]
    for j in range(many):
        x = h if j == 0 else words.mixed(h ^ words.mixed(np.array([j], np.uint64))[0])
        for bit in range(8):
            lanes = np.add.reduceat((x >> np.uint64(bit)) & np.uint64(0x0101010101010101), cut)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begins, axis=0)
            major = (2 * ones > count[texts][:, None]).astype(np.uint64)
            for lane in range(8):
                out[texts, j] |= major[:, lane] << np.uint64(8 * lane + bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", k: int = 3, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """The ``keep`` columns and, as signed longs, a fingerprint for each name. Null texts have zeros."""
    held = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    schema = docs.select(*held, *(F.lit(0).cast("long").alias(x) for x in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, "text"):
                fp = fingerprint_block(b.column("text"), k, len(names)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *map(pa.array, fp.T)], names=[*schema.names])

    out = docs.select(*held, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names)


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _pick(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that split the points best, or None if all are alike."""
    best = None
    for v in (points[0], points[len(points) // 2], ~points[0]):
        d = np.sort(_distance(points, v))
        mid = int(d[len(d) // 2])
        for mu in (mid - 1, mid):
            inside = int(np.searchsorted(d, mu, "right"))
            if 0 < inside < len(d) and (best is None or abs(2 * inside - len(d)) < best[0]):
                best = (abs(2 * inside - len(d)), v, mu)
    return best and best[1:]


def fit_tree(points: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inside child, outside child); a child below zero is leaf -1 - child."""
    nodes: list[list[int]] = []
    n_leaves = 0

    def build(p: np.ndarray, want: int) -> int:
        nonlocal n_leaves
        cut = _pick(p) if want > 1 and len(p) > 1 else None
        if cut is None:
            n_leaves += 1
            return -n_leaves
        v, mu = cut
        near = _distance(p, v) <= mu
        me = len(nodes)
        nodes.append([int(v), mu, 0, 0])
        nodes[me][2] = build(p[near], want // 2)
        nodes[me][3] = build(p[~near], want - want // 2)
        return me

    build(points, leaves)
    return [tuple(x) for x in nodes]


def route(tree: list[tuple[int, int, int, int]], points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of a point, leaf, is it the home) for each leaf within ``r`` of each point."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0 if tree else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, who, home = todo.pop()
        if not len(who):
            continue
        if node < 0:
            out.append((who, -1 - node, home))
            continue
        v, mu, near, far = tree[node]
        d = _distance(points[who], np.uint64(v)).astype(np.int64)
        a, b = d - r <= mu, d + r > mu
        todo.append((near, who[a], home[a] & (d[a] <= mu)))
        todo.append((far, who[b], home[b] & (d[b] > mu)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in out]), np.concatenate([x[2] for x in out])


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.flat(a), self.flat(b)
            differ = a != b
            a, b = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
            if not len(a):
                return
            np.minimum.at(self.up, a, b)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join pairs; the places of those that a spanning forest needs."""
        used = [np.zeros(0, np.int64)]
        todo = np.arange(len(a))
        while len(todo):
            x, y = self.flat(a[todo]), self.flat(b[todo])
            todo, x, y = todo[x != y], x[x != y], y[x != y]
            high, low = np.maximum(x, y), np.minimum(x, y)
            high, first = np.unique(high, return_index=True)
            self.up[high] = low[first]
            used.append(todo[first])
        return np.concatenate(used)

    def flat(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            x = y


def close_pairs(points: np.ndarray, home: np.ndarray, radius: int, masks: tuple[np.uint64, np.uint64]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places of a home and any point within ``radius`` in all; ``radius // 2`` holds in the first mask."""
    parts = [points & m for m in masks]
    todo = [(np.flatnonzero(home), np.arange(len(points)), 0)]
    while todo:
        mine, all_, level = todo.pop()
        if not len(mine) or len(all_) < 2:
            continue
        cut = None
        if len(mine) > 48:
            while level < 2 and (cut := _pick(parts[level][mine])) is None:
                level += 1
        if cut is None:
            step = max(1, (1 << 20) // len(all_))
            for i in range(0, len(mine), step):
                m = mine[i : i + step]
                x, y = np.nonzero(_distance(points[m][:, None], points[all_][None, :]) <= radius)
                yield m[x], all_[y]
            continue
        v, mu = cut
        # equal in the first part once level is 1: then all of the radius may be in the second
        r = radius // 2 if level == 0 else radius
        dm, da = _distance(parts[level][mine], v), _distance(parts[level][all_], v).astype(np.int64)
        todo.append((mine[dm <= mu], all_[da - r <= mu], level))
        todo.append((mine[dm > mu], all_[da + r > mu], level))


def near_links(points: np.ndarray, home: np.ndarray, radius: int, half: int) -> np.ndarray:
    """Root position of each point after joining all pairs of a home and any point within ``radius``."""
    tree = _Forest(len(points))
    for x, y in close_pairs(points, home, radius, (_HALVES[half], _HALVES[1 - half])):
        tree.join(x, y)
    return tree.flat(np.arange(len(points)))


def _sample(points: DataFrame, names: list[str], leaf: int) -> tuple[int, np.ndarray]:
    """Leaves of a tree, and at most 2 * SAMPLE_PER_LEAF * MAX_LEAVES points, picked by a hash, in random order."""
    n = points.count()
    leaves = int(min(MAX_LEAVES, max(1, n // leaf)))
    want = leaves * SAMPLE_PER_LEAF
    # fingerprints are spread like hashes, but copies may crowd: sample by a hash of them
    share = min(1.0, 1.2 * want / max(n, 1))
    whole = 1 << 40
    picked = points.where(F.pmod(F.xxhash64(*names), F.lit(whole)) < F.lit(int(share * whole) + 1)).select(*names).limit(2 * want)
    sample = picked.toPandas().to_numpy(np.int64).reshape(-1, len(names))
    sample = np.ascontiguousarray(sample[np.lexsort(sample.T)]).view(np.uint64)
    np.random.default_rng(7).shuffle(sample)
    return leaves, sample


def links(points: DataFrame, radius: int = 3, name: str = "fp", leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``name`` within ``radius`` bits.

    ``points`` has each fingerprint once. Nothing but the sample of at most
    MAX_LEAVES * SAMPLE_PER_LEAF fingerprints comes to the driver.
    """
    spark = points.sparkSession
    leaves, sample = _sample(points, [name], leaf)
    trees = [fit_tree(np.unique(sample[:, 0] & half), leaves) if leaves > 1 and len(sample) else [] for half in _HALVES]
    sent = spark.sparkContext.broadcast(trees)
    r = radius // 2

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for half, tree in enumerate(sent.value):
                for lo in range(0, len(p), 4096):
                    who, where, home = route(tree, p[lo : lo + 4096] & _HALVES[half], r)
                    yield pa.RecordBatch.from_arrays([pa.array(where * 2 + half, pa.int32()), pa.array(p[lo : lo + 4096][who].view(np.int64)), pa.array(home)], names=["shard", "p", "home"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        p = group["p"].to_numpy(np.int64).view(np.uint64)
        root = near_links(p, group["home"].to_numpy(bool), radius, int(group["shard"].iloc[0]) & 1)
        linked = np.flatnonzero(root != np.arange(len(p)))
        return pd.DataFrame({"a": p[linked].view(np.int64), "b": p[root[linked]].view(np.int64)})

    spread = points.select(name).mapInArrow(routed, "shard int, p long, home boolean")
    return spread.groupBy("shard").applyInPandas(search, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component_id): the duplicate group of every row, named by its least id.

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows
    return repeated rows. An empty table returns no row.
    """
    fps = materialize(fingerprints(docs, text, k, (id_col,)), "fp")
    points = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "points")
    label = components(links(points, radius))
    joined = points.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    whole = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(joined.select("fp", "label", "n").join(whole, "label").select("fp", "component_id", "n"), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    return join_counted(fps, named, "fp", "n", total).select(id_col, "fp", "component_id")


def _word(p: np.ndarray, table: int) -> np.ndarray:
    return (p[:, table // 2] >> np.uint64(32 * (table % 2))) & np.uint64(0xFFFFFFFF)


_PARTS = (np.uint64(0xFFFF0000), np.uint64(0x0000FFFF))


def similar_links(points: DataFrame, similarity: float, leaf: int = SIMILAR_LEAF) -> DataFrame:
    """Edges (a, b) between ``node``s of ``points`` (node, f0, f1, ...) that may have ``similarity``, a forest a shard."""
    spark = points.sparkSession
    leaves, sample = _sample(points, list(_WORDS), leaf)
    trees = [[fit_tree(np.unique(_word(sample, t) & part), leaves) if leaves > 1 and len(sample) else [] for part in _PARTS] for t in range(TABLES)]
    sent = spark.sparkContext.broadcast(trees)
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    expected = FULL * share
    limits = (expected, expected + 3 * math.sqrt(expected * (1 - share)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                p = np.stack([np.asarray(b.column(x)) for x in _WORDS], axis=1).view(np.uint64)
                for t in range(TABLES):
                    for half, tree in enumerate(sent.value[t]):
                        who, where, home = route(tree, _word(p, t) & _PARTS[half], 1)
                        take = pa.array(who)
                        yield pa.RecordBatch.from_arrays([pa.array((where * TABLES + t) * 2 + half, pa.int32()), pa.array(home), *(b.column(x).take(take) for x in ("node", *_WORDS))], names=["shard", "home", "node", *_WORDS])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        half, table = shard % 2, shard // 2 % TABLES
        p = group[list(_WORDS)].to_numpy(np.int64).view(np.uint64)
        node, home, word = group["node"].to_numpy(np.int64), group["home"].to_numpy(bool), _word(p, table)
        tree = _Forest(len(p))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for limit in limits:
            for x, y in close_pairs(word, home, 3, (_PARTS[half], _PARTS[1 - half])):
                ok = x < y if limit == limits[0] else tree.up[x] != tree.up[y]
                x, y = x[ok | ~home[y]], y[ok | ~home[y]]
                near = np.bitwise_count(p[x] ^ p[y]).sum(axis=1) <= limit
                x, y = x[near], y[near]
                used = tree.span(x, y)
                a.append(x[used])
                b.append(y[used])
            tree.up = tree.flat(np.arange(len(p)))
        return pd.DataFrame({"a": node[np.concatenate(a)], "b": node[np.concatenate(b)]})

    spread = points.select("node", *_WORDS).mapInArrow(routed, "shard int, home boolean, node long, " + ", ".join(f"{x} long" for x in _WORDS))
    edges = spread.groupBy("shard").applyInPandas(search, "a long, b long")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(docs: DataFrame, keep: str, text: str, k: int, buckets: int = 0) -> DataFrame:
    """(keep, shingles): the different hashes of k-word shingles of each text, sorted; or their number by bucket."""
    schema = docs.select(F.col(keep).alias("keep"), F.array().cast("array<long>").alias("shingles")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, "text"):
                w = words.split(b.column("text"), lower=True)
                start, end, first = words.shingles(w, k)
                h = words.xxh64(w.buf, start, end).view(np.int64)
                sets = [np.unique(h[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                if buckets:
                    sets = [np.bincount(x & (buckets - 1), minlength=buckets) for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["keep", "shingles"])

    return docs.select(F.col(keep).alias("keep"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _least_texts(docs: DataFrame, held: DataFrame, n: int, id_col: str, text: str) -> DataFrame:
    """(least, ..., text) of the rows whose id is the ``least`` of ``held``, which has ``n`` rows."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(held) if n <= BROADCAST_IDS else held, F.col("id").eqNullSafe(F.col("least"))).drop("id")


def verified(docs: DataFrame, points: DataFrame, edges: DataFrame, id_col: str, text: str, k: int, similarity: float) -> DataFrame:
    """Those ``edges`` whose shingle sets have the similarity."""
    edges = materialize(edges, "edges")
    mine = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    # one document of each point in question; any text of a point has its fingerprint
    n = mine.count()
    held = points.join(F.broadcast(mine) if n <= BROADCAST_IDS else mine, "node", "left_semi").groupBy("least").agg(F.collect_set("node").alias("nodes"))
    texts = _least_texts(docs, held, n, id_col, text).select(F.struct("least", "nodes").alias("held"), "text")
    known = fingerprints(texts, "text", k, ("held", "text"), _WORDS).withColumn("node", F.xxhash64(*_WORDS))
    known = materialize(known.where(F.array_contains("held.nodes", F.col("node"))).dropDuplicates(["node"]).select("node", "text"), "known")

    def beside(edges: DataFrame, values: DataFrame) -> DataFrame:
        """``edges`` with the arrays of both ends as x and y."""
        x, y = (values.select(F.col("keep").alias(end), F.col("shingles").alias(name)) for end, name in (("a", "x"), ("b", "y")))
        return edges.join(x, "a").join(y, "b")

    # sets are large: first the pairs go that can't share enough by the numbers of their shingles in each bucket
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, v: acc + v)
    counted = beside(edges, materialize(shingle_sets(known, "node", "text", k, BUCKETS), "counts"))
    most = total(F.zip_with("x", "y", lambda u, v: F.least(u, v)))
    edges = materialize(counted.where((1 + similarity) * most >= similarity * (total("x") + total("y")) - 1e-6).select("a", "b"), "likely")
    mine = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    n = mine.count()
    known = known.join(F.broadcast(mine) if n <= BROADCAST_IDS else mine, "node", "left_semi")
    both = beside(edges, materialize(shingle_sets(known, "node", "text", k), "sets"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def prefixes(texts: DataFrame, k: int, similarity: float, last: np.ndarray) -> DataFrame:
    """(token, node, label, size, at): the first shingles of each set, those of ``last`` after all others.

    Of two sets of the similarity the first shingle in common is among the first size - need + 1 of each,
    where need is the least number that a set of this size shares with such another; that holds in any order.
    """
    sent = texts.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, "text"):
                w = words.split(b.column("text"), lower=True)
                start, end, first = words.shingles(w, k)
                h = words.xxh64(w.buf, start, end).view(np.int64)
                owner = np.repeat(np.arange(b.num_rows), np.diff(first))
                late = np.isin(h, sent.value)
                order = np.lexsort((h, late, owner))
                h, owner = h[order], owner[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
                h, owner = h[new], owner[new]
                size = np.bincount(owner, minlength=b.num_rows)
                at = np.arange(len(h)) - (np.cumsum(size) - size)[owner]
                keep = at <= size[owner] - np.ceil(similarity * size - 1e-9).astype(np.int64)[owner]
                h, owner, at = h[keep], owner[keep], at[keep]
                rows = pa.array(owner)
                for lo in range(0, len(h), 50_000):
                    part = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h[part]), b.column("node").take(rows[part]), b.column("label").take(rows[part]), pa.array(size[owner[part]]), pa.array(at[part])], names=["token", "node", "label", "size", "at"])

    return texts.select("node", "label", "text").mapInArrow(run, "token long, node long, label long, size long, at long")


def crossing(docs: DataFrame, found: DataFrame, id_col: str, text: str, k: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes of different labels that may have the similarity, and links (a, b) that have it.

    None that has it is left out, but that the links are a forest. ``found`` has (node, least, label). Nodes meet under the first shingles of their sets. Frequent shingles
    come last, so that few sets meet under them; they are known from a part of the nodes, as any order does.
    """
    held = materialize(found.groupBy("least").agg(F.collect_list(F.struct("node", "label")).alias("nodes")), "held")
    texts = _least_texts(docs, held, held.count(), id_col, text)
    one = texts.where(F.size("nodes") == 1).select("nodes.node", "nodes.label", "text").select(F.col("node")[0].alias("node"), F.col("label")[0].alias("label"), "text")
    if not held.where(F.size("nodes") > 1).isEmpty():
        # texts of one id are told apart by their fingerprints
        several = texts.where(F.size("nodes") > 1).select(F.struct("least", "nodes").alias("held"), "text")
        several = fingerprints(several, "text", k, ("held", "text"), _WORDS).withColumn("node", F.xxhash64(*_WORDS))
        mine = several.select("node", F.filter("held.nodes", lambda x: x["node"] == F.col("node"))["label"].alias("labels"), "text")
        one = one.unionByName(mine.where(F.size("labels") > 0).select("node", F.col("labels")[0].alias("label"), "text"))
    texts = one
    some = F.pmod(F.xxhash64("node"), F.lit(ORDER_SHARE)) == 0
    often = prefixes(texts.where(some), k, similarity, np.zeros(0, np.int64)).groupBy("token").count().where(F.col("count") > ORDER_OFTEN)
    last = often.orderBy(F.desc("count"), "token").limit(100_000).select("token").toPandas()["token"].to_numpy(np.int64)

    def may_be(label, size, at, i, j):
        need = np.ceil(similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9)
        return (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9) & (np.minimum(size[i] - at[i], size[j] - at[j]) >= need)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _ in words.by_key(batches, 1 << 62):
            token, node, label, size, at = map(np.asarray, columns)
            new = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            many = np.diff(np.append(new, len(token)))
            small = np.repeat(many <= 2 * PAIRS + 1, many)
            found = []
            i = np.flatnonzero(small)
            for step in range(1, 2 * PAIRS + 1):
                i = i[i < len(token) - step]
                i = i[token[i] == token[i + step]]
                if not len(i):
                    break
                ok = may_be(label, size, at, i, i + step)
                found.append((i[ok], i[ok] + step, False))
            for lo, n in zip(new[many > 2 * PAIRS + 1].tolist(), many[many > 2 * PAIRS + 1].tolist(), strict=True):
                if n > MEET:
                    # in the order of their sizes: whatever may have the similarity is connected
                    order = lo + np.argsort(size[lo : lo + n], kind="stable")
                    i, j = order[:-1], order[1:]
                    ok = size[i] >= similarity * size[j] - 1e-9
                    found.append((i[ok], j[ok], True))
                    continue
                i, j = (lo + x for x in np.triu_indices(n, 1))
                ok = may_be(label, size, at, i, j)
                i, j = i[ok], j[ok]
                if crowded := len(i) > PAIRS * n:
                    used = _Forest(n).span(i - lo, j - lo)
                    i, j = i[used], j[used]
                found.append((i, j, crowded))
            for i, j, crowded in found:
                if len(i):
                    x, y = node[i], node[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(i), crowded))], names=["a", "b", "crowded"])

    rows = prefixes(texts, k, similarity, last).repartition("token").sortWithinPartitions("token")
    met = materialize(rows.mapInArrow(meet, "a long, b long, crowded boolean").distinct(), "met")
    cluster = materialize(components(met.where("crowded")), "cluster")
    few = F.broadcast if cluster.count() <= BROADCAST_IDS else lambda x: x
    # pairs of a cluster are all counted there
    end = lambda x: few(cluster.select(F.col("node").alias(x), F.col("label").alias(f"{x}_in")))
    pairs = met.where("not crowded").join(end("a"), "a", "left").join(end("b"), "b", "left")
    pairs = pairs.where("a_in is null or b_in is null or a_in <> b_in").select("a", "b")
    return pairs, clustered(texts.join(few(cluster.withColumnRenamed("label", "cluster")), "node"), k, similarity)


def shared_counts(left: np.ndarray, right: np.ndarray, token: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Tokens that each of the owners ``left`` has in common with each of ``right``; (token, owner) are distinct."""
    n = int(max(left.max(initial=0), right.max(initial=0))) + 1
    out = np.zeros((n, n), np.int32)
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
    many = np.diff(np.append(np.flatnonzero(new), len(token)))
    count = np.repeat(many, many)
    few = owner[count <= TABLED], (np.cumsum(new) - 1)[count <= TABLED]
    for step in range(TABLED):
        ok = few[1][step:] == few[1][: len(few[1]) - step]
        if not ok.any():
            break
        i, j = few[0][: len(ok)][ok], few[0][step:][ok]
        out += np.bincount(i * n + j, minlength=n * n).reshape(n, n).astype(np.int32)
    out += np.triu(out, 1).T
    out = out[np.ix_(left, right)]
    mine, column = owner[count > TABLED], (np.cumsum(many > TABLED) - 1)[(np.cumsum(new) - 1)[count > TABLED]]
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        table = np.zeros((n, COLUMNS), np.float32)
        table[mine[a:b], column[a:b] - lo] = 1
        out += (table[left] @ table[right].T).astype(np.int32)
    return out


def clustered(texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b): a forest of the links of nodes of one cluster and different labels; ``texts`` has (node, label, text, cluster).

    A cluster of n parts makes n rows of each set: any two parts meet in one task.
    """
    sets = shingle_sets(texts.select(F.struct("node", "label", "cluster").alias("held"), "text"), "held", "text", k)
    sets = materialize(sets.select("keep.*", "shingles"), "clustered")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum(F.size("shingles").cast("long")) / PART_SHINGLES)).cast("long")
    dealt = sets.join(sets.groupBy("cluster").agg(parts.alias("parts")), "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = F.xxhash64("cluster", F.least("part", "other"), F.greatest("part", "other"))
    rows = dealt.select(key.alias("key"), "node", "label", F.signum(F.col("other") - F.col("part")).cast("int").alias("side"), "shingles")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _ in words.by_key(batches, 1 << 62):
            key, node, label, side = map(np.asarray, columns[:4])
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
                lists = columns[4].slice(lo, hi - lo)
                size = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
                n, s = hi - lo, side[lo:hi]
                left, right = np.flatnonzero(s >= 0), np.flatnonzero(s <= 0)
                shared = shared_counts(left, right, np.asarray(lists.flatten()), np.repeat(np.arange(n), size))
                x, y = np.nonzero((shared > 0) & (shared >= similarity * (size[left][:, None] + size[right][None, :] - shared)))
                x, y = left[x], right[y]
                _, mine = np.unique(label[lo:hi], return_inverse=True)
                used = _Forest(n).span(mine[x], mine[y])
                x, y = node[lo + x[used]], node[lo + y[used]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(count, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, node, component, first): rows with the hash of their fingerprint, their group, and its least (id, node).

    Rows without a word are one group. A null id is less than any other.
    """
    rows = fingerprints(docs, text, k, (id_col,), _WORDS).withColumnRenamed(id_col, "id")
    rows = materialize(rows.withColumn("node", F.xxhash64(*_WORDS)), "similar")
    points = materialize(rows.groupBy("node", *_WORDS).agg(F.min(F.struct("id"))["id"].alias("least"), F.count(F.lit(1)).alias("n")), "points")
    good = materialize(verified(docs, points, similar_links(points, similarity), id_col, text, k, similarity), "good")
    found = materialize(points.select("node", "least").join(components(good), "node", "left").withColumn("label", F.coalesce("label", "node")), "found")
    pairs, more = crossing(docs, found, id_col, text, k, similarity)
    good = good.unionByName(verified(docs, points, pairs, id_col, text, k, similarity)).unionByName(more)
    label = components(good)
    named = points.select("node", "least", "n").join(label, "node", "left").withColumn("component", F.coalesce("label", "node"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("least").alias("id"), "node")).alias("first"))
    named = materialize(named.join(first, "component").select("node", "component", "first", "n"), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    return join_counted(rows.select("id", "node"), named, "node", "n", total).drop("n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the one of least id, a null id before all others.

    Repeated rows keep one. Rows without a word say nothing alike; they are one group and keep one row.
    """
    rows = materialize(similar_groups(docs, id_col, text, k, similarity), "groups")
    each = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "node") == F.col("first")).alias("stays"))
    each = materialize(each.where("n > 1 or not stays"), "going")
    n = each.count()
    several = each.where("n > 1").select("id")
    data = packed(docs, F.col(id_col).alias("key"), F.col(text).cast("string").alias("text"))
    going = each.select("id")
    out = data.join(F.broadcast(going) if n <= BROADCAST_IDS else going, F.col("key").eqNullSafe(F.col("id")), "left_anti").select("row")
    if not several.isEmpty():
        # rows of one id are told apart by their fingerprints
        more = data.join(several, F.col("key").eqNullSafe(F.col("id")), "left_semi")
        more = fingerprints(more, "text", k, ("row", "key"), _WORDS).withColumn("node", F.xxhash64(*_WORDS)).select("row", "key", "node")
        first = rows.select(F.col("first.id").alias("id"), F.col("first.node").alias("kept")).distinct()
        more = more.join(first, F.col("key").eqNullSafe(F.col("id")) & (F.col("node") == F.col("kept"))).dropDuplicates(["key", "node"])
        out = out.unionByName(more.select("row"))
    return out.select("row.*")


def simhash_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
