"""Engine relations over the star-schema tables, and the same as DuckDB CTEs.

links      directed: parts on an order's first line -> parts on its second
days       node, day: the part's first order date
notes      vec_id, vec (double), label
chunks     four successive vectors are a note, the first its title
doclines   doc_id, line_no, line
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    end = lambda n, name: lines.where(F.col("l_linenumber") == n).select("l_orderkey", F.col("l_partkey").alias(name))
    return end(1, "src").join(end(2, "dst"), "l_orderkey").select("src", "dst").distinct()


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node"))
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).groupBy("node").agg(F.min("day").alias("day"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose both ends are notes."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    e = links(spark, sf_dir)
    return e.join(ids.withColumnRenamed("vec_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("vec_id", "dst"), "dst", "left_semi").select("src", "dst")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("note_id"), (F.col("vec_id") % 4).cast("int").alias("chunk_ix"), "vec")


def doclines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


LINKS = """links AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  WHERE a.l_linenumber = 1 AND b.l_linenumber = 2
)"""
ADJ = LINKS + """, adj AS (
  SELECT src AS node, dst AS nbr FROM links WHERE src <> dst UNION SELECT dst, src FROM links WHERE src <> dst
), deg AS (SELECT node, count(*) AS k FROM adj GROUP BY node)"""
DAYS = """days AS (
  SELECT l_partkey AS node, min(o_orderdate::DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
)"""
NOTES = "notes AS (SELECT vec_id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
CHUNKS = NOTES + ", chunks AS (SELECT vec_id // 4 AS note_id, (vec_id % 4)::INT AS chunk_ix, vec FROM notes)"
NOTE_ADJ = LINKS + """, nlinks AS (
  SELECT src, dst FROM links WHERE src IN (SELECT vec_id FROM embeddings) AND dst IN (SELECT vec_id FROM embeddings)
), adj AS (
  SELECT src AS node, dst AS nbr FROM nlinks WHERE src <> dst UNION SELECT dst, src FROM nlinks WHERE src <> dst
), deg AS (SELECT node, count(*) AS k FROM adj GROUP BY node)"""
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM documents)"
