"""Queries over chunks, mentions, clusters and templates, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.functions import text as T
from relata.functions import vectors as V
from relata.operators import chunking, cluster, embed, insights, mentions
from relata.operators.components import components
from relata.operators.graph import adjacency

from . import relations as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def notes(spark, sf):
    """Documents as notes: the first line is the title."""
    d = R.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("note_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))


@query("c6_chunks")
def chunks(spark, sf):
    return chunking.chunk(notes(spark, sf)).select("note_id", "chunk_ix", "is_title", "idea_id", F.length("text").alias("n"))


@query("c5_ideas")
def ideas(spark, sf):
    return chunking.chunk(notes(spark, sf)).groupBy("note_id").agg(F.max("idea_id").alias("ideas"), F.count(F.lit(1)).alias("chunks"))


@query("c10_sentence_inventory", r"""SELECT doc_id AS note_id, least(60, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r\f\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 8))) AS sentences FROM documents""")
def sentence_inventory(spark, sf):
    kept = F.filter(T.sentences("body"), lambda s: F.length(s) >= 8)
    return notes(spark, sf).select("note_id", F.least(F.lit(60), F.size(kept)).cast("long").alias("sentences"))


@query("e1_embed")
def embedded(spark, sf):
    """Every passage embedded, and the note's mean vector."""
    c = embed.embed(chunking.chunk(notes(spark, sf)))
    return V.mean_by(c, ["note_id"]).select("note_id", F.round(V.norm("vec"), 6).alias("norm"), F.round(F.element_at("vec", 1), 6).alias("first"))


def part_names(spark, sf):
    p = R.table(spark, sf, "part")
    return p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("note_id"), F.lit("title").alias("kind"))


_SURF = r"""e AS (SELECT DISTINCT trim(regexp_replace(lower(nfc_normalize(p_name)), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS surface, p_partkey AS note_id FROM part), ex AS (SELECT * FROM e WHERE length(surface) >= 3)"""


@query("m1_surfaces", f"""WITH {_SURF}, v AS (SELECT CASE WHEN regexp_matches(surface, '[^aeiou]y$') THEN left(surface, length(surface) - 1) || 'ies' WHEN regexp_matches(surface, 'ies$') THEN left(surface, length(surface) - 3) || 'y'
WHEN regexp_matches(surface, '(ss|x|z|ch|sh)es$') THEN left(surface, length(surface) - 2) WHEN regexp_matches(surface, '(ss|us|is)$') THEN surface || 'es' WHEN regexp_matches(surface, 's$') THEN left(surface, length(surface) - 1)
WHEN regexp_matches(surface, '(x|z|ch|sh)$') THEN surface || 'es' ELSE surface || 's' END AS surface, note_id FROM ex WHERE length(surface) >= 4)
SELECT surface, note_id, 'title' AS kind FROM ex UNION ALL SELECT DISTINCT surface, note_id, 'variant' FROM v WHERE surface NOT IN (SELECT surface FROM ex)""")
def surfaces(spark, sf):
    return mentions.surfaces(part_names(spark, sf))


@query("m2_resolve", f"WITH {_SURF}, p AS (SELECT surface, note_id, 'n/' || note_id AS path FROM ex) SELECT surface, note_id, owners > 1 AS ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY length(path), path) AS r, count(*) OVER (PARTITION BY surface) AS owners FROM p) WHERE r = 1")
def resolve(spark, sf):
    names = part_names(spark, sf)
    paths = names.select("note_id", F.concat(F.lit("n/"), F.col("note_id").cast("string")).alias("path"))
    exact = mentions.surfaces(names).where("kind <> 'variant'")
    return mentions.resolve(exact, paths).select("surface", "note_id", "ambiguous")


@query("m7_mentions")
def detect(spark, sf):
    """Mentions in documents of the first three words of benchmark items."""
    b = R.table(spark, sf, "benchmark")
    names = b.select(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 3), " ").alias("name"), (-1 - F.col("item_id")).alias("note_id"), F.lit("title").alias("kind"))
    index = mentions.resolve(mentions.surfaces(names), names.select("note_id", F.col("name").alias("path")))
    return mentions.detect(notes(spark, sf).select("note_id", "body"), index)


@query("k2_kmeans")
def kmeans(spark, sf):
    n = V.centered(R.notes(spark, sf))
    return cluster.kmeans(n, cluster.suggest_k(n.count()))[0]


@query("k4_map")
def corpus_map(spark, sf):
    p = cluster.project(V.centered(R.notes(spark, sf)))
    return p.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("v11_without_top")
def without_top(spark, sf):
    out = cluster.without_top(R.notes(spark, sf).select("vec_id", "vec"))
    return out.select("vec_id", F.round(F.element_at("vec", 1), 6).alias("first"))


def _least_label(edges: str, rounds: int = 24) -> str:
    """CTEs lab0 ... of the least node within so many steps over ``edges`` (node, nbr); the last is ``labels``."""
    out = f"lab0 AS (SELECT DISTINCT node, node AS label FROM {edges})"
    for i in range(1, rounds + 1):
        name = "labels" if i == rounds else f"lab{i}"
        out += f", {name} AS MATERIALIZED (SELECT l.node, least(any_value(l.label), min(m.label)) AS label FROM lab{i - 1} l JOIN {edges} e ON e.node = l.node JOIN lab{i - 1} m ON m.node = e.nbr GROUP BY 1)"
    return out


@query("g22_components", f"WITH {R.ADJ}, {_least_label('adj')} SELECT node, label AS component, count(*) OVER (PARTITION BY label) AS size FROM labels")
def connected(spark, sf):
    a = adjacency(R.links(spark, sf))
    label = components(a.select(F.col("node").alias("a"), F.col("nbr").alias("b")))
    least = label.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    return label.join(least, "label").select("node", "component", "size")


@query("i6_template_groups", f"""WITH {R.LINES}, h AS (SELECT DISTINCT doc_id, lower(trim(line)) AS h FROM lines WHERE length(line) >= 6 AND line IN (SELECT line FROM lines WHERE length(line) >= 6 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)),
pr AS (SELECT x.doc_id, x.h AS a, y.h AS b FROM h x JOIN h y USING (doc_id) WHERE x.h < y.h), fi AS (SELECT a, b, min(doc_id) AS first FROM pr GROUP BY 1, 2 HAVING count(*) > 1), ed AS (SELECT first AS p, doc_id AS q FROM pr JOIN fi USING (a, b) WHERE first <> doc_id),
g AS (SELECT p AS node, q AS nbr FROM ed UNION SELECT q, p FROM ed), {_least_label('g')}, z AS (SELECT node, label, count(*) OVER (PARTITION BY label) AS size FROM labels)
SELECT node AS note_id, label AS grp, size FROM z WHERE size BETWEEN 3 AND greatest(30, floor(0.05::DOUBLE * (SELECT count(DISTINCT doc_id) FROM h) + 0.5::DOUBLE))""")
def template_groups(spark, sf):
    """Documents that share two lines of six characters, grouped."""
    h = R.doclines(spark, sf).where(F.length("line") >= 6).select(F.col("doc_id").alias("note_id"), F.col("line").alias("heading"))
    common = h.distinct().groupBy("heading").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return insights.template_groups(h.join(common, "heading"))


_TOKEN = "lower(regexp_extract(text, '([A-Za-z]{6,})', 1))"
_SAID = r"list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r\f\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s))"


@query("i20_receipts", f"""WITH t AS (SELECT doc_id, text, {_TOKEN} AS token FROM documents), p AS (SELECT *, strpos(lower(text), token) AS pos FROM t), r AS (SELECT *, greatest(1, pos - 90) AS lo, least(length(text), pos + length(token) - 1 + 90) AS hi FROM p)
SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN lo > 1 THEN '…' ELSE '' END || substring(text, lo, hi - lo + 1) || CASE WHEN hi < length(text) THEN '…' ELSE '' END END AS receipt, left(list_filter({_SAID}, lambda s: length(s) >= 25 AND contains(lower(s), token))[1], 260) AS sentence FROM r""")
def receipts(spark, sf):
    """The text around the first place of a word, and the first sentence that names it."""
    d = R.table(spark, sf, "documents")
    token = F.lower(F.regexp_extract("text", "([A-Za-z]{6,})", 1))
    return d.select("doc_id", insights.receipt(F.col("text"), token).alias("receipt"), insights.bridge_sentence(F.col("text"), token).alias("sentence"))


@query("i19_named_detail", f"""WITH t AS (SELECT doc_id, text, {_TOKEN} AS token FROM documents) SELECT doc_id, regexp_matches(token, '[0-9]') OR regexp_matches(text, '[a-z,;] ' || upper(left(token, 1)) || substring(token, 2)) AS named FROM t""")
def named_detail(spark, sf):
    d = R.table(spark, sf, "documents")
    token = F.lower(F.regexp_extract("text", "([A-Za-z]{6,})", 1))
    return d.select("doc_id", insights.named_detail(token, F.col("text")).alias("named"))


@query("r15_completions")
def completions(spark, sf):
    """Completions of each benchmark item's first word among the first words of documents."""
    first = lambda c: F.lower(F.regexp_extract(c, r"([\p{L}]+)", 1))
    names = notes(spark, sf).select("note_id", first("title").alias("name")).withColumn("prefix", F.substring("name", 1, 2))
    q = R.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), first("text").alias("query")).withColumn("prefix", F.substring("query", 1, 2))
    none = spark.createDataFrame([], "query_id long, note_id long, semantic double")
    return insights.completions(q, names, none).select("query_id", "note_id", F.round("score", 6).alias("score"), "rank")
