"""Mixing sources to target weights: repetition rates by source, whole copies by hashed coins.

Built from DataFrame functions only. Per-source sums are partial aggregates of one row a source and
task. They are joined back by broadcast if there are at most BROADCAST_SOURCES sources (counted
first), else over a salted key, so that a source with a third of all rows is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_RATE = 2
SEED = 42
BROADCAST_SOURCES = 20_000
SALTS = 64


def size_of(text: str) -> Column:
    """Words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code point order (null last) have the weights in turn. Targets fill up in proportion
    to them to ``share`` of all sizes; none is above ``max_rate`` times its source's size. With the
    sources in order of cap / weight, all before the first that stays below its cap are full; what
    they leave, divided by the weights left, is the level of the others. Sizes of zero give zero.
    """
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", F.lit(max_rate) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("spent", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.col("full")) / (F.sum("weight").over(whole) - F.col("spent")))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("turn"), F.col("level").alias("level")))
    s = s.withColumn("at", F.min(open_).over(whole)["level"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("at") * F.col("weight"), F.lit(0.0))).alias("target"))


def coin(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the id and the seed."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns as a struct ``row``, with size, source_size, target and copies, for every row."""
    parts = docs.select(F.col(source).cast("string").alias("source"), size_of(text).alias("size"))
    sizes = materialize(parts.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = targets(sizes)
    rows = docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("__id"), F.col(source).cast("string").alias("__source"), size_of(text).alias("size"))
    if sizes.count() <= BROADCAST_SOURCES:
        both = rows.join(F.broadcast(goal), F.col("__source").eqNullSafe(F.col("source")))
    else:
        salt = F.pmod(F.xxhash64("__id", "size"), F.lit(SALTS)).cast("int")
        goal = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("__salt", salt).join(goal, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__salt") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(coin(F.col("__id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return both.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with the copy's number in ``mix_copy``
    (with as many ``_`` behind it as make it a new name).

    A null text has no words and a null source is a source. Rows of a source without words have
    rate 0 and don't appear. Rows of the same id share a coin. Reruns agree.
    """
    out = rated(docs, id_col, text, source, seed, tuple(docs.columns)).where("copies > 0")
    copy = out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    named = "mix_copy"
    while named in docs.columns:
        named += "_"
    return copy.select("row.*", F.col("copy").alias(named))


def mixing_query(spark, sf_dir: str) -> DataFrame:
    out = rated(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_SIZES = r"""
sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(turn % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM per_source
), filled AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS full_, coalesce(sum(weight) OVER w, 0) AS spent FROM weighed
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)::DOUBLE - full_::DOUBLE) / ((SELECT sum(weight) FROM weighed) - spent)::DOUBLE AS level FROM filled
), level_at AS (
  SELECT min({{'r': cap::DOUBLE / weight, 't': turn, 'l': level}}).l AS at_level FROM levels WHERE level * weight < cap
), goals AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(at_level * weight, 0)) AS target FROM levels, level_at
), rates AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), copied AS (
  SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM rates
)
"""

MIXING_SQL = "WITH " + _SIZES.format(docs="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM copied"
