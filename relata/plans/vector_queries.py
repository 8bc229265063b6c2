"""Vector, similarity, fusion and evaluation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relata.functions import vectors as V
from relata.operators import evaluation as E
from relata.operators import fusion as U
from relata.operators import graph as G
from relata.operators import similarity as S

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


_DIMS = "dims AS (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS d FROM notes)"
_MEAN = "cm AS (SELECT d, avg(v) AS m FROM dims GROUP BY d), cn AS (SELECT sqrt(sum(m * m)) AS n FROM cm)"
CENTROID = f"{R.NOTES}, {_DIMS}, {_MEAN}, cent AS (SELECT list(m / n ORDER BY d) AS c, list(m ORDER BY d) AS raw FROM cm, cn)"
_UNIT = "list_transform(u, lambda x: x / sqrt(list_inner_product(u, u)))"
CENTERED = CENTROID + f""", proj AS (SELECT vec_id, label, list_transform(list_zip(vec, c), lambda z: z[1] - list_inner_product(vec, c) * z[2]) AS u FROM notes, cent),
c AS (SELECT vec_id, label, {_UNIT} AS vec FROM proj)"""
SIMS = CENTERED + ", sims AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS la, b.label AS lb, list_inner_product(a.vec, b.vec) AS s FROM c a JOIN c b ON a.vec_id <> b.vec_id)"
RANKED = SIMS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, dst) AS rank FROM sims)"


def content(spark, sf, k=10):
    c = V.centered(R.notes(spark, sf))
    return S.top_k(c, c, k)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("related_notes", f"WITH {RANKED} SELECT src, dst, round(s, 6) AS score, rank FROM ranked WHERE rank <= 10")
def related_notes(spark, sf):
    return r6(content(spark, sf), "score")


@query("v1_cosine", f"WITH {R.NOTES} SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.vec, b.vec), 6) AS cosine FROM notes a JOIN notes b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf):
    n = R.notes(spark, sf)
    b = n.select(F.col("vec_id").alias("b"), F.col("vec").alias("u"))
    return n.join(b, F.col("b") == F.col("vec_id") + 1).select(F.col("vec_id").alias("a"), "b", F.round(V.dot("vec", "u"), 6).alias("cosine"))


@query("v3_mean", f"WITH {R.NOTES}, {_DIMS}, m AS (SELECT label, d, avg(v) AS m FROM dims GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) SELECT label, d::INT AS dim, round(m / n, 6) AS value FROM m JOIN n USING (label)")
def mean(spark, sf):
    return r6(V.dims(V.mean_by(R.notes(spark, sf), ["label"]), ["label"]), "value")


@query("v4_centroid", f"WITH {R.NOTES}, {_DIMS}, {_MEAN} SELECT d::INT AS dim, round(m / n, 6) AS value FROM cm, cn")
def centroid(spark, sf):
    return r6(V.dims(V.centroid(R.notes(spark, sf)), [], "centroid"), "value")


@query("v5_center", f"WITH {CENTERED} SELECT vec_id, (generate_subscripts(vec, 1) - 1)::INT AS dim, round(unnest(vec), 6) AS value FROM c")
def center(spark, sf):
    return r6(V.dims(V.centered(R.notes(spark, sf)), ["vec_id"]), "value")


@query("v6_center_chunks", f"""WITH {R.CHUNKS}, d AS (SELECT note_id, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM chunks), m AS (SELECT note_id, d, avg(v) AS m FROM d GROUP BY 1, 2),
n AS (SELECT note_id, sqrt(sum(m * m)) AS n FROM m GROUP BY 1), cm AS (SELECT d, avg(m / n) AS m FROM m JOIN n USING (note_id) GROUP BY d), cent AS (SELECT list(m / (SELECT sqrt(sum(m * m)) FROM cm) ORDER BY d) AS c FROM cm),
p AS (SELECT note_id, chunk_ix, list_transform(list_zip(vec, c), lambda z: z[1] - list_inner_product(vec, c) * z[2]) AS u FROM chunks, cent)
SELECT note_id, chunk_ix, (generate_subscripts({_UNIT}, 1) - 1)::INT AS dim, round(unnest({_UNIT}), 6) AS value FROM p""")
def center_chunks(spark, sf):
    chunks = R.chunks(spark, sf)
    c = V.centroid(V.mean_by(chunks, ["note_id"]))
    out = chunks.crossJoin(F.broadcast(c)).withColumn("vec", V.center("vec", "centroid"))
    return r6(V.dims(out, ["note_id", "chunk_ix"]), "value")


_Q = f"""{R.NOTES}, sc AS (SELECT vec_id, vec, CASE WHEN list_max(list_transform(vec, lambda x: abs(x))) > 0 THEN list_max(list_transform(vec, lambda x: abs(x))) / 127.0::DOUBLE ELSE 1 END AS scale FROM notes),
qz AS (SELECT vec_id, vec, scale, list_transform(vec, lambda x: greatest(-127, least(127, floor(x / scale + 0.5::DOUBLE)))::INT) AS q FROM sc)"""


@query("v7_quantize", f"WITH {_Q} SELECT vec_id, round(scale, 9) AS scale, array_to_string(q, ',') AS q FROM qz")
def quantize(spark, sf):
    n = R.notes(spark, sf).withColumn("by", V.scale_of("vec"))  # no column "scale": in the lambda that would be the rounded one
    return n.select("vec_id", F.round("by", 9).alias("scale"), F.array_join(V.quantize("vec", "by").cast("array<string>"), ",").alias("q"))


@query("v8_dequantize", f"WITH {_Q}, dq AS (SELECT vec_id, vec, list_transform(q, lambda x: x * scale) AS u FROM qz) SELECT vec_id, round(list_inner_product(vec, {_UNIT}), 6) AS fidelity FROM dq")
def dequantize(spark, sf):
    n = R.notes(spark, sf).withColumn("scale", V.scale_of("vec")).withColumn("q", V.quantize("vec", "scale"))
    return n.select("vec_id", F.round(V.dot("vec", V.dequantize("q", "scale")), 6).alias("fidelity"))


@query("v9_subtract_mean", f"WITH {CENTROID}, s AS (SELECT vec_id, list_transform(list_zip(vec, raw), lambda z: z[1] - z[2]) AS u FROM notes, cent) SELECT vec_id, (generate_subscripts({_UNIT}, 1) - 1)::INT AS dim, round(unnest({_UNIT}), 6) AS value FROM s")
def subtract_mean(spark, sf):
    out = V.centered(R.notes(spark, sf), project=False)
    return r6(V.dims(out, ["vec_id"]), "value")


@query("v10_z_score", """SELECT source AS src, doc_id AS dst, CASE WHEN stddev_pop(n_chars) OVER w < 1e-9 THEN 0 ELSE round((n_chars - avg(n_chars) OVER w) / stddev_pop(n_chars) OVER w, 6) END AS z
FROM documents WINDOW w AS (PARTITION BY source)""")
def z_score(spark, sf):
    d = R.table(spark, sf, "documents").select(F.col("source").alias("src"), F.col("doc_id").alias("dst"), "n_chars")
    return d.select("src", "dst", U.z_score("n_chars", digits=6).alias("z"))


@query("v13_domain_residual", f"""WITH {CENTERED}, cd AS (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM c), t AS (SELECT label, d, sum(v) AS s, count(*) AS n FROM cd GROUP BY 1, 2),
dom AS (SELECT label, list(s ORDER BY d) AS s, any_value(n) AS n FROM t GROUP BY 1),
r AS (SELECT vec_id, list_transform(list_zip(vec, s), lambda z: z[1] - (z[2] - z[1]) / (n - 1)) AS u FROM c JOIN dom USING (label) WHERE n >= 8)
SELECT vec_id, (generate_subscripts({_UNIT}, 1) - 1)::INT AS dim, round(unnest({_UNIT}), 6) AS value FROM r""")
def domain_residual(spark, sf):
    c = V.centered(R.notes(spark, sf))
    t = V.dims(c, ["label"]).groupBy("label", "dim").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    t = t.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("s"), F.first("n").alias("n")).where("n >= 8")
    out = c.join(t, "label")
    out = out.withColumn("vec", V.unit(F.zip_with("vec", "s", lambda x, s: x - (s - x) / (F.col("n") - 1))))
    return r6(V.dims(out, ["vec_id"]), "value")


_ROC = RANKED + f""", fbd AS (SELECT src, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM ranked JOIN c ON vec_id = dst WHERE rank <= 5),
fs AS (SELECT src, d, sum(v) AS s FROM fbd GROUP BY 1, 2), fb AS (SELECT src, list(s ORDER BY d) AS u FROM fs GROUP BY 1), fu AS (SELECT src, {_UNIT} AS f FROM fb),
mx AS (SELECT src, list_transform(list_zip(vec, f), lambda z: z[1] + 0.7::DOUBLE * z[2]) AS u FROM fu JOIN c ON vec_id = src), roc AS (SELECT src, {_UNIT} AS q FROM mx)"""


@query("v14_rocchio", f"WITH {_ROC}, rs AS (SELECT src, vec_id AS dst, list_inner_product(q, vec) AS s FROM roc JOIN c ON vec_id <> src) SELECT src, dst, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, dst) AS rank FROM rs) WHERE rank <= 5")
def rocchio(spark, sf):
    c = V.centered(R.notes(spark, sf))
    best = S.top_k(c, c, 5).select(F.col("src").alias("vec_id"), F.col("dst").alias("other"))
    rows = best.join(c.select(F.col("vec_id").alias("other"), "vec"), "other")
    sums = V.mean_by(rows, ["vec_id"]).withColumnRenamed("vec", "f")
    q = c.join(sums, "vec_id").select("vec_id", V.unit(F.zip_with("vec", "f", lambda x, y: x + 0.7 * y)).alias("vec"))
    return r6(S.top_k(q, c, 5), "score")


@query("v15_generality", f"WITH {SIMS} SELECT src AS vec_id, round(avg(s), 6) AS generality FROM sims GROUP BY 1")
def generality(spark, sf):
    """Mean similarity to all others, in closed form: (v . sum - v . v) / (n - 1)."""
    c = V.centered(R.notes(spark, sf))
    parts = V.dims(c, []).groupBy("dim").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    total = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("total"), F.max("n").alias("n"))
    return c.crossJoin(F.broadcast(total)).select("vec_id", F.round((V.dot("vec", "total") - V.dot("vec", "vec")) / (F.col("n") - 1), 6).alias("generality"))


@query("v16_hop_mean", f"""WITH {CENTERED}, {R.NOTE_ADJ}, h AS (SELECT node, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM adj JOIN c ON vec_id = nbr),
hs AS (SELECT node, d, sum(v) AS s FROM h GROUP BY 1, 2), hl AS (SELECT node, list(s ORDER BY d) AS u FROM hs GROUP BY 1)
SELECT node AS vec_id, (generate_subscripts({_UNIT}, 1) - 1)::INT AS dim, round(unnest({_UNIT}), 6) AS value FROM hl""")
def hop_mean(spark, sf):
    c = V.centered(R.notes(spark, sf))
    adj = G.adjacency(R.note_links(spark, sf))
    m = V.mean_by(adj.join(c.select(F.col("vec_id").alias("nbr"), "vec"), "nbr"), ["node"])
    return r6(V.dims(m.withColumnRenamed("node", "vec_id"), ["vec_id"]), "value")


@query("j2_similar_pairs", f"WITH {SIMS} SELECT src AS a, dst AS b, round(s, 6) AS score FROM sims WHERE src < dst AND s >= 0.35::DOUBLE")
def similar_pairs(spark, sf):
    return r6(S.pairs_above(V.centered(R.notes(spark, sf)), 0.35), "score")


_CHUNK = f"""{R.CHUNKS}, cd AS (SELECT note_id, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM chunks), cmn AS (SELECT note_id, d, avg(v) AS m FROM cd GROUP BY 1, 2),
cml AS (SELECT note_id, list(m ORDER BY d) AS u FROM cmn GROUP BY 1), means AS (SELECT note_id, {_UNIT} AS vec FROM cml),
ms AS (SELECT a.note_id AS src, b.note_id AS dst, list_inner_product(a.vec, b.vec) AS s FROM means a JOIN means b ON a.note_id <> b.note_id),
short AS (SELECT src, dst, s FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, dst) AS r FROM ms) WHERE r <= 15),
cross_ AS (SELECT p.src, p.dst, x.chunk_ix AS i, y.chunk_ix AS j, list_inner_product(x.vec, y.vec) AS s FROM short p JOIN chunks x ON x.note_id = p.src JOIN chunks y ON y.note_id = p.dst)"""


def shortlist(spark, sf, k=15):
    chunks = R.chunks(spark, sf)
    means = V.mean_by(chunks, ["note_id"])
    return chunks, S.top_k(means, means, k, "note_id", "note_id").select("src", "dst", "score")


@query("j1_shortlist", f"WITH {_CHUNK} SELECT src, dst, round(s, 6) AS score FROM short")
def stage_one(spark, sf):
    return r6(shortlist(spark, sf)[1], "score")


_BIMAX = _CHUNK + """, n AS (SELECT note_id, count(*) AS n FROM chunks GROUP BY 1),
f AS (SELECT src, dst, i, greatest(0, max(s)) AS best FROM cross_ JOIN n ON note_id = src WHERE n > 1 GROUP BY 1, 2, 3
  UNION ALL SELECT p.src, p.dst, 0, greatest(0, list_inner_product(x.vec, m.vec)) FROM short p JOIN n ON n.note_id = p.src AND n = 1 JOIN chunks x ON x.note_id = p.src JOIN means m ON m.note_id = p.dst),
g AS (SELECT src, dst, j AS i, greatest(0, max(s)) AS best FROM cross_ JOIN n ON note_id = dst WHERE n > 1 GROUP BY 1, 2, 3
  UNION ALL SELECT p.src, p.dst, 0, greatest(0, list_inner_product(x.vec, m.vec)) FROM short p JOIN n ON n.note_id = p.dst AND n = 1 JOIN chunks x ON x.note_id = p.dst JOIN means m ON m.note_id = p.src),
ways AS (SELECT src, dst, sum(CASE WHEN i = 0 THEN 2 ELSE 1 END * best) / sum(CASE WHEN i = 0 THEN 2 ELSE 1 END) AS s FROM f GROUP BY 1, 2
  UNION ALL SELECT src, dst, sum(CASE WHEN i = 0 THEN 2 ELSE 1 END * best) / sum(CASE WHEN i = 0 THEN 2 ELSE 1 END) FROM g GROUP BY 1, 2),
bimax AS (SELECT src, dst, sum(s) / 2 AS s FROM ways GROUP BY 1, 2)"""


@query("j3_bimax", f"WITH {_BIMAX} SELECT src, dst, round(s, 6) AS bimax FROM bimax")
def bimax(spark, sf):
    chunks, pairs = shortlist(spark, sf)
    return r6(S.bimax(pairs, chunks), "bimax")


@query("j4_content_top10", f"WITH {R.NOTES}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.vec, b.vec) AS s FROM notes a JOIN notes b ON a.vec_id <> b.vec_id) SELECT src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, dst) AS rank FROM s) WHERE rank <= 10")
def content_top10(spark, sf):
    n = R.notes(spark, sf)
    return S.top_k(n, n, 10).select("src", "dst", "rank")


_NPAIRS = f"{RANKED}, {R.NOTE_ADJ}, npaths AS (SELECT a.node AS a, b.node AS b, d.k FROM adj a JOIN adj b ON a.nbr = b.nbr JOIN deg d ON d.node = a.nbr WHERE a.node < b.node AND d.k <= 40), nra AS (SELECT a, b, sum(1.0::DOUBLE / k) AS ra FROM npaths GROUP BY 1, 2)"


@query("j5_mutually_outside", f"WITH {_NPAIRS} SELECT a, b, round(ra, 6) AS ra FROM nra WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.rank <= 10 AND ((r.src = a AND r.dst = b) OR (r.src = b AND r.dst = a)))")
def mutually_outside(spark, sf):
    near = content(spark, sf)
    seen = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return r6(G.resource_allocation(G.adjacency(R.note_links(spark, sf))), "ra").join(seen, ["a", "b"], "left_anti")


@query("j6_best_passage_pair", f"WITH {_CHUNK} SELECT src, dst, i, j, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY round(s, 12) DESC, i, j) AS r FROM cross_) WHERE r = 1")
def best_passage_pair(spark, sf):
    chunks, pairs = shortlist(spark, sf)
    x = pairs.select("src", "dst").join(chunks.select(F.col("note_id").alias("src"), F.col("chunk_ix").alias("i"), F.col("vec").alias("v")), "src")
    x = x.join(chunks.select(F.col("note_id").alias("dst"), F.col("chunk_ix").alias("j"), F.col("vec").alias("u")), "dst")
    best = F.min(F.struct(-F.round(V.dot("v", "u"), 12).alias("s"), "i", "j"))
    return x.groupBy("src", "dst").agg(best.alias("b")).select("src", "dst", "b.i", "b.j", F.round(-F.col("b")["col1"], 6).alias("score"))


@query("j7_retrieve", f"""WITH {R.CHUNKS}, s AS (SELECT q.vec_id AS query_id, note_id, chunk_ix, list_inner_product(q.vec, c.vec) AS s FROM notes q JOIN chunks c ON q.vec_id % 100 = 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, note_id ORDER BY round(s, 12) DESC, chunk_ix) AS r FROM s) WHERE r = 1)
SELECT query_id, note_id, chunk_ix, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, note_id) AS n FROM b) WHERE n <= 10""")
def retrieve(spark, sf):
    """Best passage of each note for a stated query set: vectors whose id is divisible by 100."""
    n = R.notes(spark, sf)
    # the best 10 notes are among the notes of the best 40 passages, as a note has four
    hits = S.top_k(n.where("vec_id % 100 = 0"), n, 40, itself=True)
    hits = hits.select(F.col("src").alias("query_id"), F.floor(F.col("dst") / 4).alias("note_id"), (F.col("dst") % 4).cast("int").alias("chunk_ix"), "score")
    one = G.top(hits, ["query_id", "note_id"], [F.col("score").desc(), F.col("chunk_ix")], 1).drop("rank")
    return G.top(one, ["query_id"], [F.col("score").desc(), F.col("note_id")], 10).select("query_id", "note_id", "chunk_ix", F.round("score", 6).alias("score"))


@query("j11_unlinked", f"WITH {RANKED}, {R.NOTE_ADJ} SELECT src, dst, round(s, 6) AS score FROM ranked r WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM adj WHERE node = r.src AND nbr = r.dst)")
def unlinked(spark, sf):
    return r6(G.unlinked(content(spark, sf), G.adjacency(R.note_links(spark, sf))).select("src", "dst", "score"), "score")


@query("j12_areas", f"WITH {SIMS} SELECT src, dst, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, dst) AS rank FROM sims WHERE (la = 0) = (lb = 0)) WHERE rank <= 10")
def areas(spark, sf):
    """Notes of the isolated area (label 0) relate only within it, all others only outside."""
    c = V.centered(R.notes(spark, sf))
    parts = [c.where(F.col("label") == 0), c.where(F.col("label") != 0)]
    return r6(S.top_k(parts[0], parts[0], 10).unionByName(S.top_k(parts[1], parts[1], 10)), "score")


@query("j14_bridges", f"""WITH {RANKED}, near AS (SELECT src, dst, s FROM ranked WHERE rank <= 10),
t AS (SELECT x.dst AS a, y.dst AS b, x.src AS m, least(x.s, y.s) AS leg FROM near x JOIN near y ON x.src = y.src AND x.dst < y.dst),
o AS (SELECT t.* FROM t JOIN sims q ON q.src = a AND q.dst = b WHERE q.s < 0.35::DOUBLE)
SELECT a, b, m AS mediator, round(round(leg, 9), 6) AS leg FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(leg, 9) DESC, m) AS r FROM o) WHERE r = 1""")
def bridges(spark, sf):
    """Best mediator of pairs of its neighbours that are far from each other."""
    c = V.centered(R.notes(spark, sf))
    near = S.top_k(c, c, 10).select("src", "dst", "score")
    t = near.select("src", F.col("dst").alias("a"), F.col("score").alias("s1")).join(near.select("src", F.col("dst").alias("b"), F.col("score").alias("s2")), "src").where("a < b")
    t = t.join(c.select(F.col("vec_id").alias("a"), F.col("vec").alias("v")), "a").join(c.select(F.col("vec_id").alias("b"), F.col("vec").alias("u")), "b")
    t = t.where(V.dot("v", "u") < 0.35).groupBy("a", "b").agg(F.min(F.struct((-F.round(F.least("s1", "s2"), 9)).alias("leg"), "src")).alias("m"))
    return t.select("a", "b", F.col("m.src").alias("mediator"), F.round(-F.col("m.leg"), 6).alias("leg"))


@query("j15_twins", f"WITH {SIMS} SELECT src AS a, dst AS b, round(s, 6) AS score FROM sims WHERE src < dst AND (la < 5) <> (lb < 5) AND s >= 0.35::DOUBLE")
def twins(spark, sf):
    """Pairs across two halves of the labels (standing in for languages) of a cosine of 0.35 or more."""
    c = V.centered(R.notes(spark, sf))
    side = c.select(F.col("vec_id").alias("a"), (F.col("label") < 5).alias("la"))
    pairs = S.pairs_above(c, 0.35).join(side, "a").join(side.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b").where("la <> lb")
    return r6(pairs.select("a", "b", "score"), "score")


POOL = _NPAIRS + """, pool AS (SELECT src, dst FROM ranked WHERE rank <= 60 UNION SELECT a, b FROM nra UNION SELECT b, a FROM nra),
sc AS (SELECT p.src, p.dst, s.s AS content, coalesce(ra, 0) AS ra FROM pool p JOIN sims s ON s.src = p.src AND s.dst = p.dst LEFT JOIN nra ON a = least(p.src, p.dst) AND b = greatest(p.src, p.dst))"""
_Z = "CASE WHEN stddev_pop({0}) OVER w < 1e-9 THEN 0 ELSE round(({0} - avg({0}) OVER w) / stddev_pop({0}) OVER w, 9) END"


def pool(spark, sf, k=60):
    """Shortlist and graph nominations with both scores: (src, dst, content, ra)."""
    c = V.centered(R.notes(spark, sf))
    ra = G.both_ways(G.resource_allocation(G.adjacency(R.note_links(spark, sf))), "ra")
    pairs = S.top_k(c, c, k).select("src", "dst").union(ra.select("src", "dst")).distinct()
    pairs = pairs.join(c.select(F.col("vec_id").alias("src"), F.col("vec").alias("v")), "src").join(c.select(F.col("vec_id").alias("dst"), F.col("vec").alias("u")), "dst")
    return pairs.select("src", "dst", V.dot("v", "u").alias("content")).join(ra, ["src", "dst"], "left").fillna(0.0, ["ra"])


@query("r4_graph_fusion", f"WITH {POOL}, z AS (SELECT *, round({_Z.format('content')} + {_Z.format('ra')}, 8) AS fused FROM sc WINDOW w AS (PARTITION BY src)) SELECT src, dst, round(content, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY fused DESC, dst) AS rank FROM z) WHERE rank <= 12")
def graph_fusion(spark, sf):
    """Order by z(content) + z(resource allocation); the score shown stays the content's."""
    f = U.fuse(pool(spark, sf), {"content": 1.0, "ra": 1.0}, 12)
    return f.select("src", "dst", F.round("content", 6).alias("score"), "rank")


@query("r5_linear_fusion", f"WITH {POOL}, z AS (SELECT *, round({_Z.format('content')} * 0.7::DOUBLE + {_Z.format('ra')} * 0.3::DOUBLE, 8) AS fused FROM sc WINDOW w AS (PARTITION BY src)) SELECT src, dst, round(fused, 6) AS fused, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY fused DESC, dst) AS rank FROM z) WHERE rank <= 10")
def linear_fusion(spark, sf):
    return r6(U.fuse(pool(spark, sf), {"content": 0.7, "ra": 0.3}, 10).select("src", "dst", "fused", "rank"), "fused")


@query("r6_reciprocal_rank", f"WITH {POOL} SELECT src, dst, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY src ORDER BY round(content, 9) DESC, dst)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY src ORDER BY round(ra, 9) DESC, dst)), 6) AS rrf FROM sc")
def reciprocal_rank(spark, sf):
    return r6(U.reciprocal_rank(pool(spark, sf), ["content", "ra"]).select("src", "dst", "rrf"), "rrf")


@query("r7_csls", f"WITH {RANKED}, r AS (SELECT src, avg(s) AS r FROM ranked WHERE rank <= 10 GROUP BY 1) SELECT k.src, k.dst, round(2 * k.s - x.r - y.r, 6) AS csls FROM ranked k JOIN r x ON x.src = k.src JOIN r y ON y.src = k.dst WHERE k.rank <= 60")
def csls(spark, sf):
    near = content(spark, sf, 60)
    r = near.where("rank <= 10").groupBy("src").agg(F.avg("score").alias("r"))
    out = near.join(r, "src").join(r.select(F.col("src").alias("dst"), F.col("r").alias("q")), "dst")
    return out.select("src", "dst", F.round(2 * F.col("score") - F.col("r") - F.col("q"), 6).alias("csls"))


_ERF = "(CASE WHEN {0} >= 0 THEN 1 ELSE -1 END * (1 - (((((1.061405429::DOUBLE * {1} - 1.453152027::DOUBLE) * {1}) + 1.421413741::DOUBLE) * {1} - 0.284496736::DOUBLE) * {1} + 0.254829592::DOUBLE) * {1} * exp(-({0}) * ({0}))))"


def _sf(mu: str, sd: str) -> str:
    x = f"((1 - k.s - {mu}) / ({sd} * sqrt(2.0::DOUBLE)))"
    return "0.5::DOUBLE * (1 - " + _ERF.format(x, f"(1 / (1 + 0.3275911::DOUBLE * abs({x})))") + ")"


@query("r9_mutual_proximity", f"WITH {RANKED}, m AS (SELECT src, 1 - avg(s) AS mu, stddev_pop(s) AS sd FROM sims GROUP BY 1) SELECT k.src, k.dst, round({_sf('x.mu', 'x.sd')} * {_sf('y.mu', 'y.sd')}, 5) AS mp FROM ranked k JOIN m x ON x.src = k.src JOIN m y ON y.src = k.dst WHERE k.rank <= 20")
def mutual_proximity(spark, sf):
    c = V.centered(R.notes(spark, sf))
    m = S.moments(c).select(F.col("id").alias("src"), (1 - F.col("mean")).alias("mu"), "sd")
    near = S.top_k(c, c, 20).join(m, "src").join(m.select(F.col("src").alias("dst"), F.col("mu").alias("mu2"), F.col("sd").alias("sd2")), "dst")
    tail = lambda mu, sd: 0.5 * (1 - U.erf((1 - F.col("score") - F.col(mu)) / (F.col(sd) * F.sqrt(F.lit(2.0)))))
    return near.select("src", "dst", F.round(tail("mu", "sd") * tail("mu2", "sd2"), 5).alias("mp"))


@query("r10_mutual_rank", f"WITH {RANKED}, top AS MATERIALIZED (SELECT src, dst, rank FROM ranked WHERE rank <= 50) SELECT x.src, x.dst, -(x.rank + y.rank) AS mutual FROM top x JOIN top y ON y.src = x.dst AND y.dst = x.src")
def mutual_rank(spark, sf):
    near = content(spark, sf, 50)
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rank").alias("back"))
    return near.join(back, ["src", "dst"]).select("src", "dst", (-(F.col("rank") + F.col("back"))).cast("long").alias("mutual"))


@query("r18_group_cap", f"WITH {RANKED}, g AS (SELECT r.*, row_number() OVER (PARTITION BY src, lb ORDER BY round(s, 9) DESC, dst) AS nth FROM ranked r WHERE rank <= 50) SELECT src, dst, lb AS label, row_number() OVER (PARTITION BY src ORDER BY (nth > 3)::INT, round(s, 9) DESC, dst) AS rank FROM g")
def group_cap(spark, sf):
    near = content(spark, sf, 50).drop("rank").join(R.notes(spark, sf).select(F.col("vec_id").alias("dst"), "label"), "dst")
    return U.per_group_cap(near, "score", "label").select("src", "dst", "label", "rank")


_HOLD = f"{SIMS}, {R.NOTE_ADJ}, ed AS (SELECT node AS a, nbr AS b, (node * 31 + nbr) % 5 = 0 AS held FROM adj WHERE node < nbr), tr AS (SELECT a, b FROM ed WHERE NOT held UNION SELECT b, a FROM ed WHERE NOT held), te AS (SELECT a AS src, b AS dst FROM ed WHERE held UNION SELECT b, a FROM ed WHERE held), rk AS (SELECT src, dst, s, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, dst) AS rank FROM sims s WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.a = s.src AND tr.b = s.dst))"


def held_out(spark, sf, k=50):
    """(ranked, targets): content ranks without training links, and held-out links both ways."""
    adj = G.adjacency(R.note_links(spark, sf))
    e = E.hold_out(adj.where("node < nbr").select(F.col("node").alias("a"), F.col("nbr").alias("b")))
    both = lambda d: d.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(d.select("b", "a"))
    train = both(e.where("not held"))
    c = V.centered(R.notes(spark, sf))
    return S.top_k(c, c, k, without=train), both(e.where("held"))


@query("q1_hold_out", f"WITH {_HOLD} SELECT a, b, held FROM ed")
def hold_out(spark, sf):
    adj = G.adjacency(R.note_links(spark, sf))
    return E.hold_out(adj.where("node < nbr").select(F.col("node").alias("a"), F.col("nbr").alias("b")))


@query("q2_recall", f"WITH {_HOLD} SELECT count(*) FILTER (rank <= 10) AS hits, count(*) AS total, round(count(*) FILTER (rank <= 10) / greatest(1, count(*)), 6) AS recall FROM te LEFT JOIN rk USING (src, dst)")
def recall(spark, sf):
    ranked, targets = held_out(spark, sf)
    return r6(E.recall_at(ranked, targets), "recall")


@query("q3_mrr", f"WITH {_HOLD}, b AS (SELECT src, min(rank) AS r FROM te LEFT JOIN (SELECT * FROM rk WHERE rank <= 50) USING (src, dst) GROUP BY 1) SELECT round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr, count(*) AS sources FROM b")
def mrr(spark, sf):
    ranked, targets = held_out(spark, sf)
    return r6(E.mean_reciprocal_rank(ranked, targets), "mrr")


@query("q4_non_obvious", f"WITH {_HOLD} SELECT count(*) AS non_obvious FROM te WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.src = te.src AND rk.dst = te.dst AND rank <= 10)")
def non_obvious(spark, sf):
    ranked, targets = held_out(spark, sf)
    return targets.join(ranked.where("rank <= 10"), ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("non_obvious"))


@query("q5_hubness", f"WITH {RANKED}, n AS (SELECT vec_id, count(src) AS n FROM notes LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) ON dst = vec_id GROUP BY 1), m AS (SELECT avg(n) AS mu FROM n) SELECT round(avg((n - mu) ** 3) / avg((n - mu) ** 2) ** 1.5::DOUBLE, 6) AS skew FROM n, m")
def hubness(spark, sf):
    return r6(E.occurrence_skew(content(spark, sf), R.notes(spark, sf).select(F.col("vec_id").alias("node"))), "skew")


@query("q6_spearman", f"WITH {POOL}, k AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY round(content, 9) DESC, dst) AS x, row_number() OVER (PARTITION BY src ORDER BY round(ra, 9) DESC, dst) AS y FROM sc) SELECT src, round(corr(x, y), 6) AS rho FROM k GROUP BY 1")
def spearman(spark, sf):
    return r6(E.spearman(pool(spark, sf), "content", "ra"), "rho")


@query("q7_coverage", f"WITH {_NPAIRS} SELECT count(DISTINCT src)::BIGINT AS covered, (SELECT count(*) FROM notes) AS notes FROM (SELECT a AS src FROM nra UNION ALL SELECT b FROM nra)")
def coverage(spark, sf):
    ra = G.both_ways(G.resource_allocation(G.adjacency(R.note_links(spark, sf))), "ra")
    n = R.notes(spark, sf).agg(F.count(F.lit(1)).alias("notes"))
    return ra.agg(F.countDistinct("src").alias("covered")).crossJoin(n)


@query("q10_member_precision", f"WITH {RANKED} SELECT la AS label, round(avg((la = lb)::INT), 6) AS precision FROM ranked WHERE rank <= 10 GROUP BY 1")
def member_precision(spark, sf):
    label = R.notes(spark, sf).select("vec_id", "label")
    near = content(spark, sf).join(label.select(F.col("vec_id").alias("src"), "label"), "src").join(label.select(F.col("vec_id").alias("dst"), F.col("label").alias("other")), "dst")
    return near.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("precision"))


@query("q13_yield", f"WITH {SIMS} SELECT cut, count(*) FILTER (s >= cut) AS pairs FROM sims, (SELECT unnest([0.2::DOUBLE, 0.3, 0.4, 0.5, 0.6]) AS cut) WHERE src < dst GROUP BY 1")
def yield_at(spark, sf):
    cuts = [0.2, 0.3, 0.4, 0.5, 0.6]
    pairs = S.pairs_above(V.centered(R.notes(spark, sf)), min(cuts))
    n = pairs.agg(*(F.count(F.when(F.col("score") >= c, 1)).alias(f"c{i}") for i, c in enumerate(cuts)))
    return n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), F.col(f"c{i}").alias("pairs")) for i, c in enumerate(cuts)))).alias("r")).select("r.*")


@query("q14_blind_share", f"WITH {_HOLD}, p AS (SELECT DISTINCT x.a AS src, y.b AS dst FROM tr x JOIN tr y ON y.a = x.b WHERE x.a <> y.b) SELECT round(avg((p.src IS NULL)::INT), 6) AS blind FROM te LEFT JOIN p USING (src, dst)")
def blind_share(spark, sf):
    adj = G.adjacency(R.note_links(spark, sf))
    e = E.hold_out(adj.where("node < nbr").select(F.col("node").alias("a"), F.col("nbr").alias("b")))
    train = G.adjacency(e.where("not held").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    held = e.where("held")
    cn = G.common_neighbours(train)
    return held.join(cn, ["a", "b"], "left").agg(F.round(F.avg(F.col("cn").isNull().cast("int")), 6).alias("blind"))


@query("i8_crowding", f"WITH {RANKED} SELECT src, count(*) FILTER (la = lb) AS same FROM ranked WHERE rank <= 10 GROUP BY 1")
def crowding(spark, sf):
    label = R.notes(spark, sf).select("vec_id", "label")
    near = content(spark, sf).join(label.select(F.col("vec_id").alias("src"), "label"), "src").join(label.select(F.col("vec_id").alias("dst"), F.col("label").alias("other")), "dst")
    return near.groupBy("src").agg(F.count(F.when(F.col("label") == F.col("other"), 1)).alias("same"))


@query("i1_suggested_links", f"WITH {RANKED}, {R.NOTE_ADJ} SELECT src, dst, round(s, 6) AS score FROM (SELECT * FROM ranked r WHERE rank <= 10 AND src < dst AND NOT EXISTS (SELECT 1 FROM adj WHERE node = r.src AND nbr = r.dst)) ORDER BY round(s, 12) DESC, src, dst LIMIT 50")
def suggested_links(spark, sf):
    near = G.unlinked(content(spark, sf).where("src < dst"), G.adjacency(R.note_links(spark, sf)))
    return near.orderBy(F.col("score").desc(), "src", "dst").limit(50).select("src", "dst", F.round("score", 6).alias("score"))


@query("i3_suggested_tags", f"""WITH {RANKED}, t AS (SELECT src, la, lb AS tag, count(*) AS support FROM ranked WHERE rank <= 10 GROUP BY 1, 2, 3), df AS (SELECT label, count(*) AS df FROM notes GROUP BY 1)
SELECT src, tag, support FROM t JOIN df ON df.label = tag WHERE tag <> la AND support >= 3 AND df <= 0.25::DOUBLE * (SELECT count(*) FROM notes)""")
def suggested_tags(spark, sf):
    """Labels that three or more of the ten nearest carry, the note doesn't, and at most a quarter of all do."""
    label = R.notes(spark, sf).select("vec_id", "label")
    near = content(spark, sf).join(label.select(F.col("vec_id").alias("src"), F.col("label").alias("mine")), "src").join(label.select(F.col("vec_id").alias("dst"), F.col("label").alias("tag")), "dst")
    votes = near.groupBy("src", "mine", "tag").agg(F.count(F.lit(1)).alias("support")).where("support >= 3 and tag <> mine")
    df = label.groupBy(F.col("label").alias("tag")).agg(F.count(F.lit(1)).alias("df"))
    n = label.agg(F.count(F.lit(1)).alias("n"))
    return votes.join(df, "tag").crossJoin(F.broadcast(n)).where(F.col("df") <= 0.25 * F.col("n")).select("src", "tag", "support")


@query("i25_orphan_relatives", f"WITH {RANKED}, {R.NOTE_ADJ} SELECT src, dst, round(s, 6) AS score FROM ranked WHERE rank = 1 AND src NOT IN (SELECT node FROM adj)")
def orphan_relatives(spark, sf):
    lone = content(spark, sf, 1).withColumnRenamed("src", "node").join(G.adjacency(R.note_links(spark, sf)).select("node"), "node", "left_anti")
    return lone.select(F.col("node").alias("src"), "dst", F.round("score", 6).alias("score"))


@query("i2_surprising", f"""WITH {_NPAIRS}, cand AS (SELECT s.src, s.dst, s.s AS content FROM sims s WHERE NOT EXISTS (SELECT 1 FROM adj WHERE node = s.src AND nbr = s.dst)),
aa AS (SELECT a, b, sum(1 / ln(1 + k)) AS aa, string_agg(x::VARCHAR, ',' ORDER BY k, x) AS via FROM (SELECT a.node AS a, b.node AS b, a.nbr AS x, d.k FROM adj a JOIN adj b ON a.nbr = b.nbr JOIN deg d ON d.node = a.nbr WHERE a.node < b.node AND d.k <= 40) GROUP BY 1, 2),
p AS (SELECT c.*, coalesce(aa, 0) AS aa, via FROM cand c LEFT JOIN aa ON a = least(src, dst) AND b = greatest(src, dst)),
z AS (SELECT *, round({_Z.format('content')} + {_Z.format('aa')}, 8) AS fused FROM p WINDOW w AS (PARTITION BY src)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY fused DESC, dst) AS r FROM z) WHERE r <= 6),
k AS (SELECT * FROM t WHERE via IS NOT NULL AND content >= 0 AND NOT EXISTS (SELECT 1 FROM ranked q WHERE q.rank <= 10 AND ((q.src = t.src AND q.dst = t.dst) OR (q.src = t.dst AND q.dst = t.src))))
SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(fused, 6) AS score, via FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src) AS f FROM k) WHERE f = 1""")
def surprising(spark, sf):
    """Pairs that the fused score finds and content doesn't, with the notes that join them.

    z-scores run over all unlinked notes of a source. Those without a shared neighbour have no graph
    score and can't pass, so only moments of the pool are needed for them.
    """
    c = V.centered(R.notes(spark, sf))
    adj = G.adjacency(R.note_links(spark, sf))
    near = S.top_k(c, c, 10).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    paths = G.two_hop(adj, 1 / F.log1p("k"), G.HUB)
    via = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "x"))), lambda s: s["x"].cast("string")), ",")
    aa = paths.groupBy("a", "b").agg(F.sum("w").alias("aa"), via.alias("via"))
    vec = lambda n, v: c.select(F.col("vec_id").alias(n), F.col("vec").alias(v))
    linked = adj.select(F.col("node").alias("src"), F.col("nbr").alias("dst")).join(vec("src", "v"), "src").join(vec("dst", "u"), "dst").withColumn("s", V.dot("v", "u"))
    lost = linked.groupBy("src").agg(F.count(F.lit(1)).alias("ln"), F.sum("s").alias("ls"), F.sum(F.col("s") * F.col("s")).alias("lss"))
    m = S.moments(c).withColumnRenamed("id", "src").join(lost, "src", "left").fillna(0)
    n = F.col("n") - F.coalesce("ln", F.lit(0))
    total, square = F.col("mean") * F.col("n") - F.coalesce("ls", F.lit(0.0)), (F.col("sd") ** 2 + F.col("mean") ** 2) * F.col("n") - F.coalesce("lss", F.lit(0.0))
    graph = G.unlinked(G.both_ways(aa, "aa", "via"), adj)
    g = graph.groupBy("src").agg(F.sum("aa").alias("gs"), F.sum(F.col("aa") * F.col("aa")).alias("gss"))
    m = m.join(g, "src").select("src", (total / n).alias("cm"), F.sqrt(square / n - (total / n) ** 2).alias("cs"), (F.col("gs") / n).alias("gm"), F.sqrt(F.greatest(F.lit(0.0), F.col("gss") / n - (F.col("gs") / n) ** 2)).alias("gd"))
    z = lambda x, mu, sd: F.when(F.col(sd) < 1e-9, 0.0).otherwise(F.round((F.col(x) - F.col(mu)) / F.col(sd), 9))
    most = S.top_k(c, c, 6).select("src", "dst", F.lit(0.0).alias("aa"), F.lit(None).cast("string").alias("via"))
    rest = G.unlinked(S.top_k(c, c, 60).select("src", "dst"), adj).join(graph.select("src", "dst"), ["src", "dst"], "left_anti").join(most.select("src").distinct(), "src", "left_semi")
    rest = rest.select("src", "dst", F.lit(0.0).alias("aa"), F.lit(None).cast("string").alias("via"))
    x = graph.unionByName(rest).join(vec("src", "v"), "src").join(vec("dst", "u"), "dst").withColumn("content", V.dot("v", "u")).join(m, "src")
    x = x.withColumn("fused", F.round(z("content", "cm", "cs") + z("aa", "gm", "gd"), 8))
    x = U.ranked(x.drop("v", "u"), "fused", 6).where("via is not null and content >= 0")
    x = x.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).join(near, ["a", "b"], "left_anti")
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("src"))
    return x.withColumn("f", first).where("f = 1").select("a", "b", F.round("fused", 6).alias("score"), "via")
