"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than space and U+0009..U+000D. Every operator takes
the columns it needs by parameter, ignores the others, and treats a null text as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.operators.components import components, delete, materialize, shared_dir

__all__ = ["WORD", "components", "delete", "join_counted", "materialize", "packed", "shared_dir", "table"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as one struct ``row`` beside ``more`` columns, so that no name can clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"), *more)


#: Keys with more than this share of all rows are at most 100,000.
HOT_SHARE = 1e-5


def join_counted(rows: DataFrame, facts: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """``rows`` with the facts of their key. ``facts`` has each key once, with its number of rows ``n``.

    Facts of the keys that have a large share of the ``total`` rows are broadcast, few as they are, so
    that no key of many rows comes to one task; the others meet in a shuffle.
    """
    hot = F.col(n) > int(HOT_SHARE * total) + 1000
    return rows.join(F.broadcast(facts.where(hot)), key).unionByName(rows.join(facts.where(~hot), key))
