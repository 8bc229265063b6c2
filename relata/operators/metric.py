"""A metric from links: the directions along which linked notes differ most are taken as irrelevant.

The second moment of the differences of linked vectors is one sum of outer products, combined a task,
so only dimensions x dimensions numbers come to the driver, whatever the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference_directions(pairs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, eigenvalues), greatest first, of pairs of vectors (a, b); none for no pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = np.stack([np.asarray(v, float) for v in batch["a"]]) - np.stack([np.asarray(v, float) for v in batch["b"]])
                moment = d.T @ d
                yield pd.DataFrame({"i": np.arange(len(moment)), "row": list(moment), "n": len(d)})

    parts = pairs.select("a", "b").where("size(a) = size(b)").mapInPandas(run, "i int, row array<double>, n long")
    cells = parts.select("i", "n", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    if not cells:
        return np.zeros((0, 0)), np.zeros(0)
    size = 1 + max(c["i"] for c in cells)
    moment = np.zeros((size, size))
    for c in cells:
        moment[c["i"], c["j"]] = c["v"] / c["n"]
    values, vectors = np.linalg.eigh((moment + moment.T) / 2)
    return vectors[:, ::-1][:, :n].T, values[::-1][:n]


def reweighted(df: DataFrame, directions: np.ndarray, values: np.ndarray, soft: float | None = None, vec: str = "vec") -> DataFrame:
    """Unit vectors without the directions, or with each shrunk by 1 / sqrt(value / greatest + ``soft``)."""
    if not len(directions):
        return df
    top = values[0] if values[0] > 0 else 1.0
    scale = np.zeros(len(values)) if soft is None else 1 / np.sqrt(np.maximum(values, 0) / top + soft)

    @F.pandas_udf("array<double>")
    def weigh(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(a, float) for a in v])
        x = x + ((x @ directions.T) * (scale - 1)) @ directions
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list(np.where(size > 0, x / np.where(size > 0, size, 1), x)))

    return df.withColumn(vec, weigh(vec))
