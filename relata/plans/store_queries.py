"""Markdown notes, the vector index, surfaces, links in text and the change feed, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.functions import text as T
from relata.functions import vectors as V
from relata.operators import evaluation, mentions
from relata.operators.components import folder
from relata.sources import index, markdown
from relata.streaming import feed

from . import note_queries
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


_MD = r"""md AS (SELECT doc_id, lang, source, text, 'n/' || (doc_id % 7) || '/' || doc_id || '.md' AS path, (doc_id * 7 + 1) % 1500 AS one, (doc_id * 3) % 1500 AS two FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)"""
_TAIL = """'See [[Note ' || one || ']] and [[note ' || two || '|that]], or [[Ghost ' || (doc_id % 10) || '#part]].'"""


def notes(spark, sf):
    """Documents as Markdown notes with front matter and three links each."""
    d = R.table(spark, sf, "documents").where("text is not null and lang is not null and source is not null")
    i = F.col("doc_id")
    head = F.format_string("---\ntags: [%s, '#%s']\naliases:\n- a%d\n- %s note\n---\n", "lang", "source", "doc_id", "source")
    tail = F.format_string("\nSee [[Note %d]] and [[note %d|that]], or [[Ghost %d#part]].", (i * 7 + 1) % 1500, (i * 3) % 1500, i % 10)
    return d.select(F.format_string("n/%d/%d.md", i % 7, i).alias("path"), F.format_string("Note %d", i).alias("title"), F.concat(head, "text", tail).alias("body"))


@query("io3_front_matter", f"WITH {_MD} SELECT path, lang || ',' || source AS tags, 'a' || doc_id || ',' || source || ' note' AS aliases FROM md")
def front_matter(spark, sf):
    n = notes(spark, sf).withColumn("front", markdown.front_matter(F.col("body")))
    return n.select("path", *(F.array_join(markdown.field_list(F.col("front"), x), ",").alias(x) for x in ("tags", "aliases")))


@query("io4_without_front_matter", f"WITH {_MD} SELECT path, md5(text || chr(10) || {_TAIL}) AS hash FROM md")
def without_front_matter(spark, sf):
    return notes(spark, sf).select("path", F.md5(markdown.without_front_matter(F.col("body")).cast("binary")).alias("hash"))


@query("io10_resolved_links", f"WITH {_MD}, t AS (SELECT path, one AS target FROM md UNION ALL SELECT path, two FROM md) SELECT t.path AS src, o.path AS dst, count(*) AS n FROM t JOIN md o ON o.doc_id = target GROUP BY 1, 2")
def resolved_links(spark, sf):
    return markdown.resolved_links(notes(spark, sf))


@query("io11_ghost_links", f"WITH {_MD}, t AS (SELECT path, one AS target, 'Note ' || one AS said FROM md UNION ALL SELECT path, two, 'note ' || two FROM md) SELECT DISTINCT path, said AS target FROM t WHERE target NOT IN (SELECT doc_id FROM md) UNION ALL SELECT path, 'Ghost ' || (doc_id % 10) FROM md")
def ghost_links(spark, sf):
    return markdown.ghost_links(notes(spark, sf))


_Q = f"""{R.CHUNKS}, sc AS (SELECT note_id, chunk_ix, vec, CASE WHEN list_max(list_transform(vec, lambda x: abs(x))) > 0 THEN list_max(list_transform(vec, lambda x: abs(x))) / 127.0::DOUBLE ELSE 1 END AS scale FROM chunks),
qz AS (SELECT note_id, chunk_ix, vec, list_transform(vec, lambda x: greatest(-127, least(127, floor(x / scale + 0.5::DOUBLE))) * scale) AS u FROM sc)"""


def stored(spark, sf, name: str):
    """The index of the fixture's passages below the shared folder, written and read again."""
    where = folder(spark, f"index-{name}")
    rows = R.chunks(spark, sf).withColumn("idea_id", F.floor(F.col("chunk_ix") / 2).cast("int")).withColumn("mtime", F.lit(1))
    index.write(rows, where, "stand-in", 64)
    return where, rows, index.read(spark, where, "stand-in")


@query("io7_index_passages", f"WITH {_Q} SELECT note_id, chunk_ix, round(list_inner_product(vec, list_transform(u, lambda x: x / sqrt(list_inner_product(u, u)))), 6) AS fidelity FROM qz")
def index_passages(spark, sf):
    """Cosine of each passage with what the index gives back."""
    _, rows, (_, chunks) = stored(spark, sf, "passages")
    both = rows.select("note_id", "chunk_ix", F.col("vec").alias("was")).join(chunks, ["note_id", "chunk_ix"])
    return both.select("note_id", "chunk_ix", F.round(V.dot("was", "vec"), 6).alias("fidelity"))


@query("io5_index_means", f"WITH {R.CHUNKS}, d AS (SELECT note_id, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM chunks), m AS (SELECT note_id, d, avg(v) AS m FROM d GROUP BY 1, 2), n AS (SELECT note_id, sqrt(sum(m * m)) AS n FROM m GROUP BY 1), c AS (SELECT note_id, count(*) AS chunk_count FROM chunks GROUP BY 1) SELECT note_id, chunk_count, (d - 1)::INT AS dim, round(m / n, 6) AS value FROM m JOIN n USING (note_id) JOIN c USING (note_id)")
def index_means(spark, sf):
    _, _, (means, _) = stored(spark, sf, "means")
    return V.dims(means, ["note_id", "chunk_count"]).withColumn("value", F.round("value", 6))


@query("io6_index_labels", "SELECT vec_id // 4 AS note_id, 'l' || min(label) AS label FROM embeddings GROUP BY 1")
def index_labels(spark, sf):
    """Labels rewritten without a vector being touched."""
    where, _, _ = stored(spark, sf, "labels")
    label = R.notes(spark, sf).groupBy(F.floor(F.col("vec_id") / 4).alias("note_id")).agg(F.concat(F.lit("l"), F.min("label").cast("string")).alias("label"))
    index.write_labels(label, where)
    return spark.read.parquet(f"{where}/labels")


@query("io8_base64", "SELECT vec_id, 88 AS n, true AS same FROM embeddings")
def base64(spark, sf):
    """int8 rows as text and back."""
    n = R.notes(spark, sf).withColumn("q", V.quantize("vec", V.scale_of("vec")))
    n = n.withColumn("said", index.to_base64(F.col("q")))
    return n.select("vec_id", F.length("said").alias("n"), (index.from_base64(F.col("said")) == F.col("q")).alias("same"))


@query("m3_has_surface", f"WITH {note_queries._SURF}, a AS (SELECT DISTINCT trim(regexp_replace(lower(p_brand), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS surface FROM part UNION SELECT surface FROM e WHERE note_id % 10 = 0) SELECT surface, surface IN (SELECT surface FROM ex) AS known FROM a")
def has_surface(spark, sf):
    """Whether words are exact surfaces: brands, which are none, and some names."""
    p = R.table(spark, sf, "part")
    asked = p.select(T.normalize("p_brand").alias("surface")).union(p.where("p_partkey % 10 = 0").select(T.normalize("p_name"))).distinct()
    return mentions.known(asked, mentions.surfaces(note_queries.part_names(spark, sf)).where("kind <> 'variant'"))


@query("m8_link_text", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '[[' || p_name || ']]' ELSE '[[' || p_name || '|' || upper(p_name) || ']]' END AS link FROM part")
def link_text(spark, sf):
    p = R.table(spark, sf, "part").withColumn("said", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")))
    return p.select("p_partkey", mentions.link_text("p_name", "said", F.col("said") == F.col("p_name")).alias("link"))


@query("st1_apply_changes", """WITH c AS (SELECT ts, user_id AS path, ['create', 'modify', 'delete', 'rename'][event_id % 4 + 1] AS op, CASE WHEN event_id % 4 = 3 THEN user_id + 1 END AS old FROM events), a AS (SELECT ts, path, op FROM c UNION ALL SELECT ts, old, 'delete' FROM c WHERE old IS NOT NULL),
l AS (SELECT path, ts, op FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, op DESC) AS r FROM a) WHERE r = 1) SELECT p_partkey AS path, TIMESTAMP '2000-01-01' AS ts FROM part WHERE p_partkey NOT IN (SELECT path FROM l) UNION ALL SELECT path, ts FROM l WHERE op <> 'delete'""")
def apply_changes(spark, sf):
    """Parts as the state, events as its changes: upserts, tombstones and renames."""
    e = R.table(spark, sf, "events")
    kinds = F.array(*map(F.lit, ("create", "modify", "delete", "rename")))
    op = F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int"))
    c = e.select("ts", F.col("user_id").alias("path"), op.alias("op"), F.when(F.col("event_id") % 4 == 3, F.col("user_id") + 1).alias("old_path"))
    state = R.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")).alias("ts"))
    return feed.apply_changes(state, c)


@query("st5_stale_rows", "SELECT o_orderkey AS path, o_orderdate AS mtime FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def stale_rows(spark, sf):
    """Orders as notes; the index lacks a seventh of them and has another time for a fifth."""
    n = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    late = F.when(F.col("path") % 5 == 0, F.col("mtime") - F.expr("interval 1 day")).otherwise(F.col("mtime"))
    return feed.stale_rows(n, n.where("path % 7 <> 0").withColumn("mtime", late))


@query("q8_admission", "SELECT o_orderpriority AS channel, round(avg(o_totalprice), 4) AS gain, round(stddev_pop(o_totalprice), 4) AS sd, avg(o_totalprice) > 2 * stddev_pop(o_totalprice) AS admitted FROM orders GROUP BY 1 UNION ALL SELECT 'size', round(avg(p_size + 60), 4), round(stddev_pop(p_size + 60), 4), avg(p_size + 60) > 2 * stddev_pop(p_size + 60) FROM part")
def admission(spark, sf):
    """Prices by priority and sizes of parts stand for gains by channel and seed."""
    o = R.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("channel"), F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("gain"))
    p = R.table(spark, sf, "part").select(F.lit("size").alias("channel"), F.col("p_partkey").alias("seed"), (F.col("p_size") + 60).cast("double").alias("gain"))
    return evaluation.admission(o.unionByName(p)).select("channel", F.round("gain", 4).alias("gain"), F.round("sd", 4).alias("sd"), "admitted")
