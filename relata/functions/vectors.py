"""Vector expressions over ARRAY<DOUBLE> columns; all sums in double, one pass, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a, b) -> Column:
    """Dot product; 0 for vectors of different length, as for a null one."""
    a, b = _col(a), _col(b)
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.when(F.size(a) == F.size(b), s), F.lit(0.0))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    return let(_col(a), lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def center(v, c) -> Column:
    """``v`` without its part along the unit vector ``c``, normalised again."""
    v, c = _col(v), _col(c)
    return unit(let(dot(v, c), lambda p: F.zip_with(v, c, lambda x, y: x - p * y)))


def subtract(v, m) -> Column:
    return unit(F.zip_with(_col(v), _col(m), lambda x, y: x - y))


def scale_of(v) -> Column:
    """Greatest absolute value / 127; 1 for a zero row."""
    most = F.array_max(F.transform(_col(v), lambda x: F.abs(x)))
    return F.when(most > 0, most / 127.0).otherwise(F.lit(1.0))


def quantize(v, scale) -> Column:
    """Bytes in -127..127; halves round up."""
    s = _col(scale)
    return F.transform(_col(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / s + 0.5))).cast("tinyint"))


def dequantize(q, scale) -> Column:
    s = _col(scale)
    return unit(F.transform(_col(q), lambda x: x.cast("double") * s))


def dims(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """One row a component: keys, dim, value."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "value"))


def mean_by(df: DataFrame, keys: list[str], vec: str = "vec", normalise: bool = True) -> DataFrame:
    """(keys, vec): component-wise means of each group, combined before the shuffle."""
    parts = dims(df, keys, vec).groupBy(*keys, "dim").agg(F.avg("value").alias("value"))
    rows = parts.groupBy(*keys) if keys else parts.groupBy()
    out = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("vec"))
    return out.withColumn("vec", unit("vec")) if normalise else out


def centroid(df: DataFrame, vec: str = "vec", normalise: bool = True) -> DataFrame:
    """One row, ``centroid``: the mean of all vectors of the commonest length, normalised."""
    return mean_by(df, [], vec, normalise).withColumnRenamed("vec", "centroid")


def centered(df: DataFrame, vec: str = "vec", project: bool = True) -> DataFrame:
    """``df`` with ``vec`` centred: the centroid's direction projected out, or the mean subtracted. One row is broadcast."""
    c = centroid(df, vec, project)
    new = center(vec, "centroid") if project else subtract(vec, "centroid")
    return df.crossJoin(F.broadcast(c)).withColumn(vec, new).drop("centroid")


def attributed(v, around, weight: float = 1.0) -> Column:
    """``v`` followed by ``weight`` times the mean ``around`` it, normalised; ``v`` alone where there is none."""
    v, around = _col(v), _col(around)
    return F.when(around.isNull(), v).otherwise(unit(F.concat(v, F.transform(around, lambda x: x * weight))))
