"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="relata-"))
    return spark.sparkContext.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``materialize``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(_clean)


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is there goes when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/relata-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below the shared folder and read it again.

    The files survive the loss of any executor. They go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs, as (node, label).

    Each round every node hooks to its neighbour of least hash, if that is below its own, and the
    edges are contracted; hashing makes the order random, so chains shrink by a constant factor a
    round, and stars go in one. Edges only shrink, everything is a join or a combinable minimum,
    and each round is written to the shared folder. Only nodes with an edge to another are returned.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        hook = hook.select("node", F.when(F.col("m.h") < F.xxhash64("node"), F.col("m.b")).otherwise(F.col("node")).alias("up"))
        hook = materialize(hook, "hook")
        if label is None:
            label = hook.select("node", F.col("up").alias("label"))
        else:
            up = hook.select(F.col("node").alias("label"), "up")
            label = materialize(label.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "label")
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        e = e.join(left, "a").join(right, "b").where("ua <> ub")
        e = materialize(e.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label
