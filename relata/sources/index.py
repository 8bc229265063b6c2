"""The vector index as Parquet tables: means, quantised passages, labels.

Means are read without passages and labels are rewritten without vectors, as each is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.functions import vectors as V

VERSION = 1


def write(chunks: DataFrame, folder: str, model: str, dims: int) -> None:
    """``chunks(note_id, chunk_ix, idea_id, mtime, vec)``: int8 passages with a scale each, means, and a manifest row."""
    q = chunks.withColumn("scale", V.scale_of("vec")).withColumn("q", V.quantize("vec", "scale"))
    q.select("note_id", "chunk_ix", "idea_id", "q", "scale").write.mode("overwrite").parquet(f"{folder}/chunks")
    times = chunks.groupBy("note_id").agg(F.max("mtime").alias("mtime"), F.count(F.lit(1)).alias("chunk_count"))
    V.mean_by(chunks, ["note_id"]).join(times, "note_id").write.mode("overwrite").parquet(f"{folder}/means")
    chunks.sparkSession.createDataFrame([(VERSION, model, dims)], "version int, model string, dims int").write.mode("overwrite").parquet(f"{folder}/manifest")


def write_labels(labels: DataFrame, folder: str) -> None:
    labels.write.mode("overwrite").parquet(f"{folder}/labels")


def read(spark: SparkSession, folder: str, model: str) -> tuple[DataFrame, DataFrame] | None:
    """(means, dequantised chunks) or None for another version or model; rows of the wrong length are dropped,
    and an idea below zero is none."""
    head = spark.read.parquet(f"{folder}/manifest").first()
    if head is None or (head["version"], head["model"]) != (VERSION, model):
        return None
    means = spark.read.parquet(f"{folder}/means").where(F.size("vec") == head["dims"])
    chunks = spark.read.parquet(f"{folder}/chunks").where((F.size("q") == head["dims"]) & F.col("scale").isNotNull())
    return means, chunks.select("note_id", "chunk_ix", F.when(F.col("idea_id") >= 0, F.col("idea_id")).alias("idea_id"), V.dequantize("q", "scale").alias("vec"))


def to_base64(q) -> "F.Column":
    """Text form of an int8 row."""
    raw = F.unhex(F.array_join(F.transform(q, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")), ""))
    return F.regexp_replace(F.base64(raw), r"\s", "")  # one line, however long


def from_base64(text) -> "F.Column":
    digits = F.hex(F.unbase64(text))
    value = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    n = (F.length(digits) / 2).cast("int")
    bytes_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<int>"))
    return F.transform(bytes_, lambda x: F.when(x > 127, x - 256).otherwise(x).cast("tinyint"))
