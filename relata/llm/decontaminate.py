"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the words from each position and ignore the rest, so a substituted word
only spoils the masks that look at it. Seed hashes of the test items are compared with those of
every position of every document where the document is; each hit fixes an alignment, and the
aligned words around it decide: some window of ``window`` words (the whole item if it is shorter)
must agree in ``similarity`` of its words. No document is shuffled.

The test items are read in blocks of about ``block_words`` words, one pass over the documents for
each, so what is sent to executors is bounded however large the benchmark is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words
from .common import WORD, packed, table

MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 2, 5, 7), (0, 2, 4, 5, 8), (0, 1, 4, 7, 8))
#: Shorter items have a mask for each word that they may lack; at a similarity of 0.8 that is all they may,
#: and those under five words may lack none.
SPAN = 10
MIN_WORDS = 3
WINDOW = 20
SIMILARITY = 0.8
BLOCK_WORDS = 1_000_000
_BITS = 22


class Index:
    """Seed hashes of test items, sorted, with a bitmap in front."""

    def __init__(self, ids: list, texts: list[str | None]):
        w = words.split(pa.array(texts, pa.string()), lower=True)
        self.ids, self.h, self.first = ids, words.word_hashes(w), w.first
        self.tables: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]] = []
        n = w.n
        short = sorted({int(x) for x in n if MIN_WORDS <= x < SPAN})
        masks = [(m, 0, n >= SPAN) for m in MASKS]
        for x in short:
            if x < 5:
                masks.append((tuple(range(x)), 0, n == x))
                continue
            for lost in range(x):
                m = [k for k in range(x) if k != lost]
                masks.append((tuple(k - m[0] for k in m), m[0], n == x))
        for mask, lead, mine in masks:
            keys, at = [], []
            for i in np.flatnonzero(mine):
                a, b = self.first[i] + lead, self.first[i + 1]
                g = words.gram_hashes(self.h[a:b], list(mask))
                keys.append(g)
                at.append(np.arange(a, a + len(g)))
            if keys:
                k, p = np.concatenate(keys), np.concatenate(at)
                order = np.argsort(k, kind="stable")
                bits = np.zeros(1 << _BITS, bool)
                bits[k & np.uint64((1 << _BITS) - 1)] = True
                self.tables.append((mask, k[order], p[order], bits))
        self.item_of = np.repeat(np.arange(len(n)), n)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h and in the index of equal seeds."""
        where, there = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for mask, keys, at, bits in self.tables:
            g = words.gram_hashes(h, list(mask))
            maybe = np.flatnonzero(bits[g & np.uint64((1 << _BITS) - 1)])
            lo, hi = np.searchsorted(keys, g[maybe], "left"), np.searchsorted(keys, g[maybe], "right")
            n = hi - lo
            where.append(np.repeat(maybe, n))
            there.append(at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        return np.concatenate(where), np.concatenate(there)

    def overlaps(self, h: np.ndarray, first: np.ndarray, window: int, similarity: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, share of equal words) of verified alignments, one for a text and item."""
        p, q = self.hits(h)
        item = self.item_of[q]
        aligned = np.unique(np.stack((np.searchsorted(first, p, "right") - 1, item, p - (q - self.first[item])), axis=1), axis=0).tolist()
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for text, item, at in aligned:
            test = self.h[self.first[item] : self.first[item + 1]]
            equal = np.zeros(len(test), np.int64)
            lo, hi = max(at, int(first[text])), min(at + len(test), int(first[text + 1]))
            if lo < hi:
                equal[lo - at : hi - at] = h[lo:hi] == test[lo - at : hi - at]
            size = min(window, len(test))
            sums = np.convolve(equal, np.ones(size, np.int64), "valid")
            good = np.flatnonzero(sums >= math.ceil(similarity * size - 1e-9))
            if len(good):
                a, b = max(int(good[0]), lo - at), min(int(good[-1]) + size, hi - at)
                got = (float(equal[a:b].mean()), b - a, at + a - int(first[text]))
                best[text, item] = max(best.get((text, item), (0.0, 0, 0)), got)
        for (text, item), (share, size, at) in sorted(best.items()):
            yield text, item, at, size, share


def indexes(benchmark: DataFrame, item_col: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """An index of each block of items; items with under MIN_WORDS words (or a null text) are in none."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text).cast("string").alias("t")).where(F.regexp_count("t", F.lit(WORD)) >= MIN_WORDS).distinct()
    total = items.agg(F.sum(F.regexp_count("t", F.lit(WORD))).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_words))
    for k in range(n if total else 0):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        if rows:
            yield Index([r["i"] for r in rows], [r["t"] for r in rows])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", window: int = WINDOW, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item, first_word, n_words, share): every document that holds a test item, once for each item.

    Null and empty texts hold none; repeated rows are found each. Words are lower-cased in A-Z.
    """
    spark = docs.sparkSession
    ids, items = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"`{id_col}` {ids}, `{item_col}` {items}, first_word long, n_words long, share double"
    out = spark.createDataFrame([], schema)
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    frame = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__text"))
    for index in indexes(benchmark, item_col, text, block_words):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in words.blocks(batch, "__text"):
                    w = words.split(b.column("__text"), lower=True)
                    got = list(sent.value.overlaps(words.word_hashes(w), w.first, window, similarity))
                    if got:
                        who = b.column("__id").take(pa.array([g[0] for g in got]))
                        what = pa.array([sent.value.ids[g[1]] for g in got], kind)
                        yield pa.RecordBatch.from_arrays([who, what, pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.float64())], names=[id_col, item_col, "first_word", "n_words", "share"])

        out = out.unionByName(frame.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", window: int = WINDOW, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; null and empty texts stay."""
    spark = docs.sparkSession
    out = packed(docs)
    schema, place = out.schema, docs.columns.index(text)
    for index in indexes(benchmark, item_col, "text", block_words):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in words.blocks(words.with_text(batch, place), "text"):
                    w = words.split(b.column("text"), lower=True)
                    ok = np.ones(b.num_rows, bool)
                    for got in sent.value.overlaps(words.word_hashes(w), w.first, window, similarity):
                        ok[got[0]] = False
                    yield b.select(["row"]).filter(pa.array(ok))

        out = out.mapInArrow(run, schema)
    return out.select("row.*")


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, table(spark, sf_dir, "benchmark"))
