"""Anchored passages: positions chosen by content, with a bounded context of word hashes on each side.

A key matters if it stands at two places or more, in one document or in several. What is done with
the rows of a key is the caller's business; here are the anchors, the spans and the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import components, materialize

BROADCAST_KEYS = 2_000_000
_POS = 26


def window_minima(g: np.ndarray, size: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorted positions that are the first least value of some window of ``size`` values.

    Windows of text i start at first[i] .. first[i] + count[i] - 1.
    """
    if not len(g) or count.max(initial=0) <= 0:
        return np.zeros(0, np.int64)
    out = []
    step = 1 << (_POS - 1)
    starts = np.repeat(first - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(int(count.sum()))
    for lo in range(0, len(g), step):
        part = g[lo : lo + step + size]
        here = starts[(starts >= lo) & (starts < lo + step)] - lo
        if not len(here):
            continue
        low = np.uint64((1 << _POS) - 1)
        x = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= size:
            x = np.minimum(x[:-width], x[width:])
            width *= 2
        if width < size:
            x = np.minimum(x[: len(x) - (size - width)], x[size - width :])
        out.append(np.unique(x[here] & low).astype(np.int64) + lo)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def contexts(h: np.ndarray, first: np.ndarray, owner: np.ndarray, at: np.ndarray, reach: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ``reach`` words before each position, nearest first, and from it on; zero outside the text."""
    tag = h >> np.uint64(64 - 8 * width)
    tag[tag == 0] = 1
    n = np.diff(first)
    # texts lie ``reach`` zeros apart, so that no window needs a check of its ends
    shift = reach * (1 + np.arange(len(n)))
    padded = np.zeros((len(h) + reach * (len(n) + 1), width), np.uint8)
    padded[np.arange(len(h)) + np.repeat(shift, n)] = np.ascontiguousarray(tag.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    where = at + shift[owner]
    sides = []
    for tags, start in ((np.ascontiguousarray(padded[::-1]), len(padded) - where), (padded, where)):
        view = np.lib.stride_tricks.sliding_window_view(tags.reshape(-1), reach * width)
        sides.append(view[start * width])
    return sides[0], sides[1]


def binary(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    offsets = pa.py_buffer((np.arange(n + 1) * size).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def unpack(column: pa.Array, reach: int, width: int) -> np.ndarray:
    """(rows, reach) word tags of a column made by ``binary``; 0 stands outside the text."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(n, reach, width)
    if width == 2:
        return raw.reshape(n, reach * 2).view(">u2").astype(np.uint32)
    out = np.zeros((n, reach), np.uint32)
    for i in range(width):
        out = (out << np.uint32(8)) | raw[:, :, i]
    return out


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words from the first on that rows have in common, up to the end of either text."""
    same = (x == y) & (x != 0)
    return np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))


def _owned(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mixed(keys) + words.mixed(owner.astype(np.uint64) + np.uint64(1))


Anchor = Callable[[pa.Array, bool], tuple[words.Words, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]


def anchored(docs: DataFrame, anchor: Anchor, id_col: str, text: str, reach: int = 0, width: int = 3, block: int = words.BLOCK_BYTES, only: tuple[str, str] | None = None) -> DataFrame:
    """(key, id, at) of every anchor of every text, with its contexts (span, back, ahead) if ``reach``.

    ``anchor`` gives the words of a block, their hashes, and lists of (positions, keys, spans); what a
    span means is the caller's business, and it is only asked for with contexts. ``only`` names two columns with the keys wanted of each text
    and those of them that are hot; there is a column ``hot`` then.
    """
    names = ["key", "id", "at", *(["span", "back", "ahead"] if reach else []), *(["hot"] if only else [])]
    kind = dict(docs.dtypes)[id_col]

    def wanted(lists: pa.Array) -> np.ndarray:
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
        return _owned(np.asarray(lists.flatten()).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(size)), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, "text", block):
                w, h, found = anchor(b.column("text"), reach > 0)
                hot = None
                if only:
                    every, crowded = wanted(b.column("wanted")), wanted(b.column("crowded"))
                for all_at, all_keys, all_spans in found:
                    if only:
                        mine = _owned(all_keys, np.searchsorted(w.first, all_at, "right") - 1)
                        ok = np.isin(mine, every)
                        all_at, all_keys, all_spans, hot = all_at[ok], all_keys[ok], all_spans[ok], np.isin(mine[ok], crowded)
                    for lo in range(0, len(all_at), 20_000):
                        at, keys = all_at[lo : lo + 20_000], all_keys[lo : lo + 20_000]
                        owner = np.searchsorted(w.first, at, "right") - 1
                        cols = [pa.array(keys.view(np.int64)), b.column(0).take(pa.array(owner)), pa.array(at - w.first[owner])]
                        if reach:
                            cols.append(pa.array(all_spans[lo : lo + 20_000].astype(np.int32)))
                            cols += map(binary, contexts(h, w.first, owner, at, reach, width))
                        if only:
                            cols.append(pa.array(hot[lo : lo + 20_000]))
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    more = [F.col(only[0]).alias("wanted"), F.col(only[1]).alias("crowded")] if only else []
    frame = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), *more)
    return frame.mapInArrow(run, f"key long, id {kind}, at long" + (", span int, back binary, ahead binary" if reach else "") + (", hot boolean" if only else ""))


def repeated(docs: DataFrame, anchor: Anchor, id_col: str, text: str, reach: int, width: int, name: str, block: int = words.BLOCK_BYTES, crowd: int = 0) -> DataFrame:
    """Anchors with contexts whose key stands at two places or more, written to the shared folder.

    ``hot`` marks keys of more than ``crowd`` anchors. Up to BROADCAST_KEYS such keys are broadcast;
    more meet the anchors, without contexts, in a join. Rows without an id are left out.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null")
    place = F.xxhash64("id", "at")
    keys = anchored(docs, anchor, "id", "text", block=block).groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
    keys = materialize(keys.where("a <> b").select("key", (F.col("n") > crowd).alias("hot")), f"{name}-keys")
    if keys.count() <= BROADCAST_KEYS:
        rows = anchored(docs, anchor, "id", "text", reach, width, block).join(F.broadcast(keys), "key")
    else:
        # contexts are large: shuffle anchors without them, then take the texts to their own repeated keys
        light = anchored(docs, anchor, "id", "text", block=block).select("key", "id").distinct().join(keys, "key")
        mine = light.groupBy("id").agg(F.collect_list("key").alias("wanted"), F.collect_list(F.when(F.col("hot"), F.col("key"))).alias("crowded"))
        rows = anchored(docs.join(mine, "id"), anchor, "id", "text", reach, width, block, ("wanted", "crowded"))
    return materialize(rows, f"{name}-rows")


def merged(spans: DataFrame, id_col: str) -> DataFrame:
    """(id, spans, n_repeated, component_id) of the documents with a span.

    ``spans`` has (id, first, last, other): words first..last of document id, and a document that is in
    one class with it; first may be null, then the row is a link only. Touching spans are merged; the
    class is named by its least id.
    """
    spans = materialize(spans, "spans")
    ordered = Window.partitionBy("id").orderBy("first", "last")
    rows = spans.where("first is not null").select("id", "first", "last")
    rows = rows.withColumn("before", F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.count(F.when(F.col("before") >= F.col("first"), None).otherwise(1)).over(ordered))
    rows = rows.groupBy("id", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    rows = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"), F.sum(F.col("last") - F.col("first")).alias("n_repeated"))
    label = components(spans.select("id", "other").distinct(), "id", "other")
    least = label.groupBy("label").agg(F.min("node").alias("component_id"))
    named = label.join(least, "label").select(F.col("node").alias("id"), "component_id")
    rows = rows.join(named, "id", "left")
    return rows.select(F.col("id").alias(id_col), "spans", "n_repeated", F.coalesce("component_id", "id").alias("component_id"))
