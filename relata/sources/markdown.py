"""Markdown corpora: scan, front matter, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINK = r"\[\[([^\]|#\n]+)(?:[|#][^\]\n]*)?\]\]"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, body, mtime) of all .md files below a folder; dot files are skipped by Spark's reader."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").format("text").option("wholetext", "true").load(folder)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("mtime"))
    return raw.withColumn("title", F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"[.]md$", "")).select("path", "title", "body", "mtime")


def outside(df: DataFrame, folders: list[str], path: str = "path") -> DataFrame:
    """Rows that are in none of the folders."""
    for f in (f.rstrip("/") for f in folders):
        if f:
            df = df.where((F.col(path) != f) & ~F.startswith(F.col(path), F.lit(f + "/")))
    return df


def front_matter(body: Column) -> Column:
    return F.regexp_extract(body, r"^---\n([\s\S]*?)\n---(\n|$)", 1)


def without_front_matter(body: Column) -> Column:
    return F.regexp_replace(body, r"^---\n[\s\S]*?\n---\n?", "")


def field_list(front: Column, name: str) -> Column:
    """Values of a front-matter field, written inline (``[a, b]`` or ``a, b``) or as a block list."""
    inline = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[?([^\]\n]*)\]?[ \t]*$", 1)
    block = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|$))+)", 1)
    items = F.when(F.trim(inline) != "", F.split(inline, ",")).otherwise(F.split(block, "\n"))
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), "^-[ \t]*|^[\"'#]+|[\"']+$", "")))
    return F.filter(F.transform(clean, lambda x: F.regexp_replace(x, "^[\"'#]+|[\"']+$", "")), lambda x: x != "")


def link_targets(notes: DataFrame) -> DataFrame:
    """(path, target) of every wikilink, as often as it occurs."""
    return notes.select("path", F.explode(F.regexp_extract_all("body", F.lit(LINK), F.lit(1))).alias("target")).withColumn("target", F.trim("target"))


def resolved_links(notes: DataFrame) -> DataFrame:
    """(src, dst, n): links whose folded target is a title; of equal titles the first path owns it."""
    own = notes.select(F.lower(F.trim("title")).alias("key"), F.col("path").alias("dst")).groupBy("key").agg(F.min("dst").alias("dst"))
    t = link_targets(notes).withColumn("key", F.lower("target"))
    return t.join(own, "key").groupBy(F.col("path").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


def ghost_links(notes: DataFrame) -> DataFrame:
    """(path, target) of links to no title."""
    own = notes.select(F.lower(F.trim("title")).alias("key"))
    return link_targets(notes).withColumn("key", F.lower("target")).join(own, "key", "left_anti").select("path", "target").distinct()
