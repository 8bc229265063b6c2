"""Embedding behind one interface: an iterator function per task, vectors of unit length.

No model weights are at hand, so the engine is a deterministic stand-in: words are hashed to signed
dimensions and averaged. A real model goes where ``hashed`` is, loaded once a task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.functions import vectors as V

#: Behaviour by a part of the model's name: prefixes of queries and passages, pooling, whole notes.
MODELS = {
    "e5": {"query": "query: ", "passage": "passage: ", "pooling": "mean", "whole_note": False},
    "jina": {"query": "", "passage": "", "pooling": "last", "whole_note": True},
    "bge": {"query": "", "passage": "", "pooling": "mean", "whole_note": False},
    "": {"query": "", "passage": "", "pooling": "mean", "whole_note": False},
}


def behaviour(model: str) -> dict:
    return next(v for k, v in MODELS.items() if k in model.lower())


def hashed(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    def engine(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h & 0x10000 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return engine


def embed(chunks: DataFrame, text: str = "text", kind: str = "passage", model: str = "", dims: int = 64, batch_size: int = 12) -> DataFrame:
    """``chunks`` with ``vec``, in order; a null or empty text has the zero vector."""
    prefix = behaviour(model)[kind]
    columns = chunks.columns
    schema = chunks.select("*", F.array(F.lit(0.0)).alias("vec")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = hashed(dims)
        for b in batches:
            texts = [prefix + t if t else "" for t in b.column(text).to_pylist()]
            rows = [r for lo in range(0, len(texts), batch_size) for r in engine(texts[lo : lo + batch_size])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(r) for r in rows], pa.list_(pa.float64()))], names=[*columns, "vec"])

    return chunks.mapInArrow(run, schema)


def pool(tokens: DataFrame, how: str, order: str = "chunk_ix", keys: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """(keys, vec): the mean of each group's token vectors, or its last one, at unit length."""
    if how == "mean":
        return V.mean_by(tokens, list(keys))
    last = tokens.groupBy(*keys).agg(F.max_by("vec", order).alias("vec"))
    return last.withColumn("vec", V.unit("vec"))


def whole_notes(passages: DataFrame, model: str = "jina") -> DataFrame:
    """(note_id, granularity, idea, vec): a vector for each note (idea -1) and, if the model takes whole notes, each idea."""
    how = behaviour(model)
    note = V.mean_by(passages, ["note_id"]).select("note_id", F.lit("note").alias("granularity"), F.lit(-1).alias("idea"), "vec")
    if not how["whole_note"]:
        return note
    idea = V.mean_by(passages, ["note_id", "idea_id"]).select("note_id", F.lit("idea").alias("granularity"), F.col("idea_id").alias("idea"), "vec")
    return note.unionByName(idea)
