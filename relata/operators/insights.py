"""Whole-corpus reports: template groups, receipts, completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import text as T
from relata.functions import vectors as V

from .components import components


def template_groups(headings: DataFrame, least: int = 3, ceiling: int | None = None) -> DataFrame:
    """(note_id, grp, size): notes that share two headings, by single linkage, of ``least`` to ``ceiling`` notes.

    Notes meet under pairs of their own headings and are linked to the first note of each pair, so a
    heading that all notes have makes one row a note, not a row for each two notes. The ceiling is 30
    or a twentieth of the notes, whichever is more.
    """
    h = headings.select("note_id", T.lower(T.trim("heading")).alias("h")).distinct()
    n = h.where("note_id is not null").select("note_id").distinct().count() if ceiling is None else 0
    most = max(30, int(0.05 * n + 0.5)) if ceiling is None else ceiling
    pairs = h.join(h.select("note_id", F.col("h").alias("g")), "note_id").where("h < g").select("note_id", F.xxhash64("h", "g").alias("pair"))
    first = pairs.groupBy("pair").agg(F.min("note_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    label = components(pairs.join(first, "pair").select("a", F.col("note_id").alias("b")))
    size = label.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("grp")).where(F.col("size").between(least, most))
    return label.join(size, "label").select(F.col("node").alias("note_id"), "grp", "size")


def decrowd(vectors: DataFrame, groups: DataFrame, id_col: str = "note_id", vec: str = "vec") -> DataFrame:
    """``vectors`` of group members without their group's common direction; others as they are."""
    member = groups.select(F.col("note_id").alias("__id"), "grp")
    rows = vectors.join(member, vectors[id_col] == member["__id"], "left").drop("__id")
    inside = rows.where("grp is not null")
    centre = V.mean_by(inside.select("grp", F.col(vec).alias("vec")), ["grp"]).withColumnRenamed("vec", "centroid")
    moved = inside.join(centre, "grp").withColumn(vec, V.center(vec, "centroid")).select(*vectors.columns)
    return rows.where("grp is null").select(*vectors.columns).unionByName(moved)


def receipt(text: Column, token: Column, reach: int = 90) -> Column:
    """The text around the first place of a token, with dots where it is cut."""
    at = F.instr(T.lower(text), token)
    lo = F.greatest(F.lit(1), at - reach)
    hi = F.least(F.length(text), at + F.length(token) - 1 + reach)
    cut = F.concat(F.when(lo > 1, "…").otherwise(""), F.substring(text, lo, hi - lo + 1), F.when(hi < F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut)


def bridge_sentence(text: Column, bridge: Column, least: int = 25, most: int = 260) -> Column:
    """The first sentence of ``least`` characters that names the bridge."""
    kept = F.filter(T.sentences(text), lambda s: (F.length(s) >= least) & F.contains(T.lower(s), T.lower(bridge)))
    return F.substring(F.try_element_at(kept, F.lit(1)), 1, most)


def named_detail(token: Column, text: Column) -> Column:
    """Whether a token holds a digit or stands capitalised inside a sentence."""
    capital = F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, F.lit(2), F.length(token)))
    inside = F.regexp_like(text, F.concat(F.lit(r"[a-z,;] "), capital))
    return token.rlike("[0-9]") | inside


def completions(queries: DataFrame, names: DataFrame, semantic: DataFrame, limit: int = 37, fuzzy_weight: float = 0.6) -> DataFrame:
    """(query_id, note_id, score, rank): fuzzy and semantic blend for each query (query_id, query, prefix).

    Names (note_id, name, prefix) meet a query under an equal ``prefix`` key, so no query is compared
    with all names. The fuzzy magnitude is 1 / (1 + edit distance), relative to the query's strongest.
    An empty query has semantic scores alone.
    """
    hit = queries.where("query <> ''").join(names, "prefix")
    mag = 1.0 / (1.0 + F.levenshtein(F.lower("query"), F.lower("name")))
    best = hit.groupBy("query_id", "note_id").agg(F.max(mag).alias("mag"))
    most = F.max("mag").over(Window.partitionBy("query_id"))
    best = best.withColumn("fuzzy", F.when(most > 0, F.col("mag") / most).otherwise(0.0)).join(semantic, ["query_id", "note_id"], "left")
    blend = best.select("query_id", "note_id", (fuzzy_weight * F.col("fuzzy") + (1 - fuzzy_weight) * F.coalesce("semantic", F.lit(0.0))).alias("score"))
    empty = queries.where("query = ''").select("query_id").join(semantic, "query_id").select("query_id", "note_id", F.col("semantic").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "note_id")
    return blend.unionByName(empty).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def new_concepts(labels: DataFrame, surfaces: DataFrame, least: float = 0.45, notes: int = 8, limit: int = 3) -> DataFrame:
    """(query_id, concept, rank): parts of the labels of a query's best notes (query_id, note_id, label, semantic) that no surface owns."""
    near = Window.partitionBy("query_id").orderBy(F.col("semantic").desc(), "note_id")
    top = labels.withColumn("r", F.row_number().over(near)).where((F.col("r") <= notes) & (F.col("semantic") >= least))
    parts = top.select("query_id", "r", F.posexplode(F.split("label", " · ")).alias("i", "concept")).withColumn("key", F.lower(F.trim("concept"))).where(F.length("key") >= 3)
    parts = parts.join(surfaces.select(F.col("surface").alias("key")).distinct(), "key", "left_anti")
    once = parts.groupBy("query_id", "key").agg(F.min(F.struct("r", "i", "concept")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m.r", "m.i", "key")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", F.trim("m.concept").alias("concept"), "rank")


def report(sections: dict[str, DataFrame], rows: int = 20) -> str:
    """The first rows of each section as Markdown tables."""
    out = []
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in df.limit(rows).collect()] + [""]
    return "\n".join(out)
