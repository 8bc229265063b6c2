"""Suffix-array dedup over sparse suffixes: exact passages of MIN_WORDS words or more that repeat.

Suffixes start at minimisers only: of every WINDOW successive hashes of K words the least one is
kept, so any two equal passages of WINDOW + K - 1 = MIN_WORDS words have such a position in common.

1. Suffixes whose first K words stand at one place only can't begin a repeat; a combined aggregate
   over the hashes of those words finds the others.
2. These get a bounded context, MIN_WORDS word hashes (24 bits each) to the left and to the right.
   Every passage of MIN_WORDS words around the position lies in it; a longer one has more positions.
3. They are sorted over all partitions by their words to the right, then those to the left. For each
   place ``left`` of the position in a passage, rows that share the passage's right side lie side by
   side; the stretches of equal passages among them are its chains. A chain with two places is a
   repeat.
4. Rows with another left side may part equal passages into more chains. Wherever that can be, at
   the ends of a batch too, each chain sends a hash of its passage, and equal ones are brought
   together by an aggregate. So no passage is missed, however many documents stand between two equal
   ones, and the work is linear: at most MIN_WORDS - K + 1 hashes a row, none inside a chain of copies.

Words are case-sensitive. Repeats inside one document count too. Links go to one row of each chain and
one document of each passage, so documents linked in any way are in one class. A text of fewer words,
or none, or null has no suffix, a row without an id is left out, and repeated rows add nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, words
from .common import materialize, table

MIN_WORDS = 50
K = 16
WIDTH = 3
HOT = 10_000


def minimisers(min_words: int, k: int):
    window = min_words - k + 1

    def anchor(column: pa.Array, spans: bool):
        w = words.split(column)
        h = words.mixed(words.word_hashes(w))
        g = words.gram_hashes(h, list(range(k)))
        at = anchors.window_minima(g, window, w.first[:-1], np.maximum(0, w.n - min_words + 1))
        return w, h, [(at, g[at], np.zeros(len(at)))]

    return anchor


def chains(rows: DataFrame, min_words: int, k: int) -> DataFrame:
    """(id, first, last, other, passage) of ``rows`` sorted by their contexts.

    Without ``passage``: a span that the document ``other`` has too. With it: the hash of a passage
    that may stand elsewhere; its place is null if its chain is a repeat already, shared by ``other``.
    """
    kind = dict(rows.dtypes)["id"]
    names = ["id", "first", "last", "other", "passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, at = np.asarray(batch.column("key")), np.asarray(batch.column("at"))
            back, ahead = (anchors.unpack(batch.column(x), min_words, WIDTH) for x in ("back", "ahead"))
            ids = batch.column("id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            same = key[1:] == key[:-1]
            left = np.where(same, anchors.common(back[1:], back[:-1]), -1)
            right = np.where(same, anchors.common(ahead[1:], ahead[:-1]), -1)
            has_left, has_right = (back != 0).sum(axis=1), (ahead != 0).sum(axis=1)
            change = (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])
            mates = np.full((min_words - k + 1, n), -1, np.int64)
            sent = []
            for o in range(min_words - k + 1):
                near = right >= min_words - o
                link = near & (left >= o)
                group = np.concatenate(([0], np.cumsum(~near)))
                chain = np.concatenate(([0], np.cumsum(~link)))
                head = np.flatnonzero(np.concatenate(([True], ~link)))
                # the first row of another place than the head's
                differs = np.flatnonzero(link & change) + 1
                mate = np.full(len(head), -1, np.int64)
                mate[chain[differs[::-1]]] = differs[::-1]
                own = mate[chain]
                first = head[chain]
                mates[o] = np.where(own < 0, -1, np.where((ids == ids[first]) & (at == at[first]), own, first))
                broken = np.zeros(group[-1] + 1, bool)
                broken[[0, -1]] = True
                broken[group[1:][near & ~link]] = True
                valid = broken[group] & (has_left >= o) & (has_right >= min_words - o)
                alone = np.flatnonzero(valid & (own < 0))
                heads = head[valid[head] & (mate >= 0)]
                sent.append((np.concatenate((alone, heads)), np.concatenate((np.zeros(len(alone), bool), np.ones(len(heads), bool))), o))
            hit = np.zeros((n, len(mates) + 2), np.int8)
            hit[:, 1:-1] = (mates >= 0).T
            step = np.diff(hit, axis=1)
            row, low = np.nonzero(step == 1)
            high = np.nonzero(step == -1)[1] - 1
            if len(row):
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(at[row] - high), pa.array(at[row] - low + min_words), batch.column("id").take(pa.array(mates[low, row])), pa.nulls(len(row), pa.int64())], names=names)
            where = np.concatenate([x[0] for x in sent])
            if not len(where):
                continue
            shared = np.concatenate([x[1] for x in sent])
            o = np.concatenate([np.full(len(x[0]), x[2]) for x in sent])
            used, slot = np.unique(where, return_inverse=True)
            with np.errstate(over="ignore"):
                base = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
                powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(2 * min_words, base))))
                tags = words.mixed(np.concatenate((back[used, ::-1], ahead[used]), axis=1).astype(np.uint64))
                # later words have lower powers, so that a difference of sums is raised to one power for all places
                sums = np.concatenate((np.zeros((len(used), 1), np.uint64), np.cumsum(tags * powers[2 * min_words - 1 :: -1][: 2 * min_words], axis=1)), axis=1)
                part = (sums[slot, 2 * min_words - o] - sums[slot, min_words - o]) * powers[min_words - o]
                passage = words.mixed(words.mixed(part) + words.mixed(key[where].view(np.uint64)) + o.astype(np.uint64)).view(np.int64)
            first = pa.array(at[where] - o, mask=shared)
            other = np.where(shared, mates[o, where], 0)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(where)), first, pa.array(at[where] - o + min_words), batch.column("id").take(pa.array(other, mask=~shared)), pa.array(passage)], names=names)

    by = ["key", "ahead", "back", "id", "at"]
    schema = f"id {kind}, first long, last long, other {kind}, passage long"
    return rows.select("key", "ahead", "back", "id", "at").repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """(id, first, last, other): spans of words that stand elsewhere too, unmerged, and a document of their class.

    A row without a span is a link only.
    """
    rows = anchors.repeated(docs, minimisers(min_words, k), id_col, text, min_words, WIDTH, "suffix")
    found = materialize(chains(rows, min_words, k), "chains")
    sent = found.where("passage is not null")
    # a chain that is a repeat sends its head without a place
    place = F.when(F.col("first").isNotNull(), F.xxhash64("id", "first"))
    least = F.least("id", "other")  # nulls don't count
    shared = sent.groupBy("passage").agg(F.min(least).alias("other"), F.min(place).alias("p"), F.max(place).alias("q"), F.count("first").alias("n"), F.count(F.lit(1)).alias("all"))
    shared = materialize(shared.where("all > n or p <> q").select("passage", "other", "n"), "passages")
    alone = sent.select("id", "first", F.when(F.col("first").isNotNull(), F.col("last")).alias("last"), "passage")
    # frequent passages are few: at most one in HOT rows
    hot = alone.join(F.broadcast(shared.where(F.col("n") > HOT)), "passage")
    rest = alone.join(shared.where(F.col("n") <= HOT), "passage")
    more = hot.unionByName(rest).select("id", "first", "last", "other")
    return found.where("passage is null").select("id", "first", "last", "other").unionByName(more)


def suffixes_query(spark, sf_dir: str) -> DataFrame:
    return anchors.merged(repeats(table(spark, sf_dir, "documents")), "doc_id")
