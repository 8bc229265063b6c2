"""Graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.operators import graph as G

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


def adj(spark, sf):
    return G.adjacency(R.links(spark, sf))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_PATHS = """, paths AS (
  SELECT a.node AS a, b.node AS b, a.nbr AS x, d.k FROM adj a JOIN adj b ON a.nbr = b.nbr JOIN deg d ON d.node = a.nbr WHERE a.node < b.node
)"""
A = f"WITH {R.ADJ}"
P = A + _PATHS


def _best(score: str, k: int = 10) -> str:
    return f""", both_ AS (SELECT a AS src, b AS dst, s FROM scored UNION ALL SELECT b, a, s FROM scored)
SELECT src, dst, round(s, 6) AS {score}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, dst) AS rank FROM both_) WHERE rank <= {k}"""


def _top(score: str, k: int = 10) -> str:
    return f"""
SELECT src, dst, round(s, 6) AS {score}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, dst) AS rank FROM scored) WHERE rank <= {k}"""


def best(pairs, score, k=10):
    t = G.both_ways(pairs, score)
    return G.top(t, ["src"], [F.round(score, 9).desc(), F.col("dst")], k).select("src", "dst", F.round(score, 6).alias(score), "rank")


def best_of(directed, score, k=10):
    t = directed.withColumnRenamed("w", score) if score not in directed.columns else directed
    return G.top(t, ["src"], [F.round(score, 9).desc(), F.col("dst")], k).select("src", "dst", F.round(score, 6).alias(score), "rank")


_ANTI = " AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.node = w.src AND z.nbr = w.dst)"


@query("g1_degree", A + " SELECT node, k FROM deg")
def degree(spark, sf):
    return G.degree(adj(spark, sf))


@query("g2_neighbours", A + " SELECT node, nbr FROM adj")
def neighbours(spark, sf):
    return adj(spark, sf)


@query("g3_evidence", P + """ SELECT a, b, round(sum(1.0::DOUBLE / k), 6) AS ra, string_agg(x::VARCHAR, ',' ORDER BY k, x) AS shared
FROM paths WHERE k <= 40 GROUP BY a, b""")
def evidence(spark, sf):
    e = G.evidence(adj(spark, sf))
    return e.select("a", "b", F.round("ra", 6).alias("ra"), F.array_join(F.transform("shared", lambda x: x.cast("string")), ",").alias("shared"))


_PPR = A + """, s1 AS (SELECT d.node AS src, a.nbr AS pos, 1.0::DOUBLE * (1 - 0.15::DOUBLE) / d.k AS mass FROM deg d JOIN adj a ON a.node = d.node WHERE d.k <= 40),
f1 AS (SELECT src, pos, mass FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(mass, 12) DESC, pos) AS r FROM s1) WHERE r <= 400),
s2 AS (SELECT src, pos, sum(share) AS mass FROM (SELECT f.src, a.nbr AS pos, f.mass * (1 - 0.15::DOUBLE) / d.k AS share FROM f1 f JOIN deg d ON d.node = f.pos JOIN adj a ON a.node = f.pos WHERE d.k <= 40) WHERE share >= 1e-6 GROUP BY 1, 2),
f2 AS (SELECT src, pos, mass FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(mass, 12) DESC, pos) AS r FROM s2) WHERE r <= 400),
s3 AS (SELECT src, pos, sum(share) AS mass FROM (SELECT f.src, a.nbr AS pos, f.mass * (1 - 0.15::DOUBLE) / d.k AS share FROM f2 f JOIN deg d ON d.node = f.pos JOIN adj a ON a.node = f.pos WHERE d.k <= 40) WHERE share >= 1e-6 GROUP BY 1, 2),
f3 AS (SELECT src, pos, mass FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(mass, 12) DESC, pos) AS r FROM s3) WHERE r <= 400),
ppr AS (SELECT src, pos AS dst, sum(mass) / sqrt(any_value(d.k)) AS mass FROM (FROM f1 UNION ALL FROM f2 UNION ALL FROM f3) JOIN deg d ON d.node = pos WHERE src <> pos GROUP BY 1, 2)"""


@query("g4_rooted_page_rank", _PPR + ", scored AS (SELECT src, dst, mass AS s FROM ppr)" + _top("mass", 20))
def rooted_page_rank(spark, sf):
    return best_of(G.page_rank_from(adj(spark, sf)), "mass", 20)


@query("g5_candidates", _PPR + _PATHS + """, ra AS (SELECT a, b, sum(1.0::DOUBLE / k) AS ra FROM paths WHERE k <= 40 GROUP BY a, b),
scored AS (SELECT w.src, w.dst, w.mass + coalesce(ra.ra, 0) AS s FROM ppr w LEFT JOIN ra ON ra.a = least(w.src, w.dst) AND ra.b = greatest(w.src, w.dst) WHERE true""" + _ANTI + ")" + _top("score"))
def candidates(spark, sf):
    return G.candidates(adj(spark, sf)).select("src", "dst", G.rounded(F.col("score"), 6).alias("score"), "rank")


@query("g6_common_neighbours", P + " SELECT a, b, count(*)::DOUBLE AS cn FROM paths GROUP BY a, b")
def common_neighbours(spark, sf):
    return G.common_neighbours(adj(spark, sf))


@query("g6_adamic_adar", P + " SELECT a, b, round(sum(1 / ln(1 + k)), 6) AS aa FROM paths GROUP BY a, b")
def adamic_adar(spark, sf):
    return rounded(G.adamic_adar(adj(spark, sf)), "aa")


@query("g6_adamic_adar_plain", P + " SELECT a, b, round(sum(1 / ln(k)), 6) AS aa FROM paths WHERE k >= 2 GROUP BY a, b")
def adamic_adar_plain(spark, sf):
    return rounded(G.adamic_adar(adj(spark, sf), True), "aa")


@query("g7_resource_allocation", P + ", scored AS (SELECT a, b, sum(1.0::DOUBLE / k) AS s FROM paths GROUP BY a, b)" + _best("ra"))
def resource_allocation(spark, sf):
    return best(G.resource_allocation(adj(spark, sf), None), "ra")


def _walks(weights: list[str], share: bool) -> str:
    w = "1.0::DOUBLE / d.k" if share else "1.0::DOUBLE"
    out = A + f", e AS (SELECT a.node, a.nbr, {w} AS s FROM adj a JOIN deg d ON d.node = a.node), w1 AS (SELECT node AS src, nbr AS pos, s AS n FROM e)"
    for i in range(2, len(weights) + 1):
        out += f", w{i} AS (SELECT w.src, e.nbr AS pos, sum(w.n * e.s) AS n FROM w{i - 1} w JOIN e ON e.node = w.pos GROUP BY 1, 2)"
    union = " UNION ALL ".join(f"SELECT src, pos AS dst, n * {x} AS w FROM w{i}" for i, x in enumerate(weights, 1))
    return out + f", walked AS (SELECT src, dst, sum(w) AS s FROM ({union}) WHERE src <> dst GROUP BY 1, 2), scored AS (SELECT src, dst, s FROM walked w WHERE s > 0" + _ANTI + ")"


@query("g8_katz", _walks(["0.05::DOUBLE", "0.05::DOUBLE ** 2", "0.05::DOUBLE ** 3"], False) + _top("katz"))
def katz(spark, sf):
    return best_of(G.katz(adj(spark, sf)), "katz")


_RST = A + ", f0 AS (SELECT node AS src, node AS pos, 1.0::DOUBLE AS mass FROM deg)"
for _i in range(1, 7):
    _RST += f""", f{_i} AS (SELECT src, pos, sum(mass) AS mass FROM (
  SELECT f.src, a.nbr AS pos, f.mass * (1 - 0.15::DOUBLE) / d.k AS mass FROM f{_i - 1} f JOIN deg d ON d.node = f.pos JOIN adj a ON a.node = f.pos
  UNION ALL SELECT node, node, 0.15::DOUBLE FROM deg) GROUP BY 1, 2)"""


@query("g9_page_rank_restart", _RST + ", scored AS (SELECT src, pos AS dst, mass AS s FROM f6 WHERE src <> pos)" + _top("mass"))
def page_rank_restart(spark, sf):
    return best_of(G.page_rank_restart(adj(spark, sf), best=10), "mass")


@query("g10_heat_kernel", _walks(["exp(-2::DOUBLE) * 2", "exp(-2::DOUBLE) * 2", "exp(-2::DOUBLE) * 8 / 6", "exp(-2::DOUBLE) * 16 / 24"], True) + _top("heat"))
def heat_kernel(spark, sf):
    return best_of(G.heat_kernel(adj(spark, sf), best=10), "heat")


_DEGS = " JOIN deg da ON da.node = a JOIN deg db ON db.node = b"


@query("g11_simrank", P + f" SELECT a, b, round(count(*) * 0.8::DOUBLE / (any_value(da.k) * any_value(db.k)), 6) AS simrank FROM paths{_DEGS} GROUP BY a, b")
def simrank(spark, sf):
    return rounded(G.simrank_once(adj(spark, sf)), "simrank")


@query("g12_local_path", _walks(["0", "1", "0.01::DOUBLE"], False) + _top("lp"))
def local_path(spark, sf):
    return best_of(G.local_path(adj(spark, sf)), "lp")


@query("g13_preferential_attachment", P + f" SELECT a, b, (any_value(da.k) * any_value(db.k))::DOUBLE AS pa FROM paths{_DEGS} GROUP BY a, b")
def preferential_attachment(spark, sf):
    return G.preferential_attachment(adj(spark, sf))


@query("g14_three_paths", A + """, scored AS (SELECT a.node AS src, c.nbr AS dst, sum(1 / sqrt(du.k * dv.k)) AS s
FROM adj a JOIN adj b ON b.node = a.nbr AND b.nbr <> a.node JOIN adj c ON c.node = b.nbr AND c.nbr <> b.node AND c.nbr <> a.node
JOIN deg du ON du.node = b.node JOIN deg dv ON dv.node = c.node GROUP BY 1, 2)""" + _top("l3"))
def three_paths(spark, sf):
    return best_of(G.three_paths(adj(spark, sf)), "l3")


_LPA = A + ", l0 AS (SELECT node, node AS c FROM deg)"
for _i in range(1, 7):
    _LPA += f""", l{_i} AS (SELECT node, c FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, c) AS r FROM (
  SELECT a.node, l.c, count(*) AS n FROM adj a JOIN l{_i - 1} l ON l.node = a.nbr GROUP BY 1, 2)) WHERE r = 1)"""


@query("g15_communities", _LPA + " SELECT node, c AS community, count(*) OVER (PARTITION BY c) AS size FROM l6")
def communities(spark, sf):
    return G.communities(adj(spark, sf))


@query("g16_decayed_allocation", P + f""", {R.DAYS} SELECT a, b, round(sum(1.0::DOUBLE / k) * exp(-abs(datediff('day', any_value(da.day), any_value(db.day))) / 400.0::DOUBLE), 6) AS decayed
FROM paths JOIN days da ON da.node = a JOIN days db ON db.node = b WHERE k <= 40 GROUP BY a, b""")
def decayed_allocation(spark, sf):
    return rounded(G.decayed_allocation(adj(spark, sf), R.days(spark, sf)), "decayed")


@query("g17_open_triangles", P + f""", {R.DAYS} SELECT a, b, round(max(ln(1 + abs(datediff('day', da.day, db.day))) / k), 6) AS spread
FROM paths JOIN days da ON da.node = a JOIN days db ON db.node = b WHERE k <= 40 GROUP BY a, b""")
def open_triangles(spark, sf):
    return rounded(G.open_triangles(adj(spark, sf), R.days(spark, sf)), "spread")


def part_words(spark, sf):
    p = R.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("node"), F.explode(F.split("p_name", " ")).alias("entity"))


def brand_size(spark, sf):
    p = R.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("node"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("entity"))


_HOLD = "WITH holds AS (SELECT DISTINCT p_partkey AS node, p_brand || '/' || p_type || '/' || p_size AS entity FROM part), rare AS (SELECT entity, count(*) AS h FROM holds GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60)"
_PAIR = " FROM holds x JOIN holds y ON x.entity = y.entity AND x.node < y.node JOIN rare r ON r.entity = x.entity GROUP BY 1, 2"


@query("g18_ghost_coreference", _HOLD + " SELECT x.node AS a, y.node AS b, round(sum(1.0::DOUBLE / h), 6) AS w" + _PAIR)
def ghost_coreference(spark, sf):
    return rounded(G.shared_entity(brand_size(spark, sf), 1 / F.col("h")), "w")


@query("g19_shared_people", _HOLD + " SELECT x.node AS a, y.node AS b, round(sum(1 / ln(1 + h)), 6) AS w" + _PAIR)
def shared_people(spark, sf):
    return rounded(G.shared_entity(brand_size(spark, sf), 1 / F.log1p("h")), "w")


def label_tags(spark, sf):
    c = R.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("node"), F.explode(F.array(F.concat_ws("/", "c_mktsegment", "c_nationkey"), F.concat(F.lit("b"), F.floor(F.col("c_acctbal") / 100).cast("string")))).alias("entity"))


_TAGS = """WITH holds AS (SELECT c_custkey AS node, c_mktsegment || '/' || c_nationkey AS entity FROM customer UNION SELECT c_custkey, 'b' || floor(c_acctbal / 100)::BIGINT FROM customer),
n AS (SELECT node, count(*) AS n FROM holds GROUP BY 1), rare AS (SELECT entity FROM holds GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60),
s AS (SELECT x.node AS a, y.node AS b, count(*)::DOUBLE AS w FROM holds x JOIN holds y ON x.entity = y.entity AND x.node < y.node JOIN rare r ON r.entity = x.entity GROUP BY 1, 2)
SELECT a, b, {} FROM s JOIN n na ON na.node = a JOIN n nb ON nb.node = b"""


@query("g19_tag_cosine", _TAGS.format("round(w / sqrt(na.n * nb.n), 6) AS cosine"))
def tag_cosine(spark, sf):
    return rounded(G.tag_overlap(label_tags(spark, sf)).select("a", "b", "cosine"), "cosine")


@query("g21_tag_jaccard", _TAGS.format("round(w / (na.n + nb.n - w), 6) AS jaccard"))
def tag_jaccard(spark, sf):
    return rounded(G.tag_overlap(label_tags(spark, sf)).select("a", "b", "jaccard"), "jaccard")


def supplier_days(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    lines = R.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("node"))
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).groupBy("node").agg(F.max("day").alias("day"))


@query("g20_temporal_proximity", """WITH d AS (SELECT l_suppkey AS node, max(o_orderdate::DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT x.node AS a, y.node AS b, round(exp(-abs(datediff('day', x.day, y.day)) / 7.0::DOUBLE), 6) AS near FROM d x JOIN d y ON x.node < y.node AND abs(datediff('day', x.day, y.day)) <= 30""")
def temporal_proximity(spark, sf):
    return G.temporal_proximity(supplier_days(spark, sf), digits=6)


@query("g23_hubs", A + " SELECT node, k FROM deg WHERE k > (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM deg) WHERE i = (SELECT floor(count(*) * 0.95::DOUBLE) FROM deg))")
def hubs(spark, sf):
    return G.hubs(adj(spark, sf))


@query("g25_orphans", A + " SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM adj)")
def orphans(spark, sf):
    return G.orphans(R.table(spark, sf, "part").select(F.col("p_partkey").alias("node")), adj(spark, sf))


@query("g26_outgoing", f"WITH {R.LINKS} SELECT DISTINCT src, dst FROM links WHERE src <> dst")
def outgoing(spark, sf):
    return G.outgoing(R.links(spark, sf))
