"""Link-graph signals as joins and aggregates over ``adj(node, nbr)`` and ``deg(node, k)``.

Resource allocation, evidence, rooted walks and what is built on them expand only neighbours of at most
``hub`` links; that rule is part of these signals and bounds them by ``hub`` rows an edge. The other
signals (common neighbours, Adamic-Adar, Katz, heat kernel, restart walks, SimRank, local path, three
paths, preferential attachment) have no such rule by definition: a hub of k links makes k * k rows.
Their ``hub`` argument, None by default, gives a bounded variant for graphs with large hubs.
Ties are broken by id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import local_walks
from .components import materialize

HUB = 40


def adjacency(links: DataFrame) -> DataFrame:
    """Undirected, distinct, without self-loops: (node, nbr) in both directions, from (src, dst)."""
    e = links.select("src", "dst").where("src <> dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).union(e.select("dst", "src")).distinct()


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy("node").agg(F.count(F.lit(1)).alias("k"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes groups before and after the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rounded(value: Column, digits: int) -> Column:
    """``value`` rounded as the SQL does: scaled as a double first. Spark's ``round`` takes the decimal digits of the value.

    A score of 0.0007225 that comes out as 0.0007224999999999999 is 722.5 millionths, rounded up, and not 722.49...
    """
    return F.round(value * 10.0**digits, 0) / F.lit(10.0**digits)


def two_hop(adj: DataFrame, weight: Column, hub: int | None = HUB, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, x, w): pairs a < b with a shared neighbour x, and the weight of x, an expression over its degree ``k``."""
    deg = degree(adj)
    mid = deg if hub is None else deg.where(F.col("k") <= hub)
    mid = mid.select(F.col("node").alias("x"), "k", weight.cast("double").alias("w"))
    left = adj.select(F.col("nbr").alias("x"), F.col("node").alias("a")).join(mid, "x")
    right = adj.select(F.col("nbr").alias("x"), F.col("node").alias("b"))
    return left.join(right, "x").where("a < b").select("a", "b", "x", "w", *extra)


def pair_score(paths: DataFrame, name: str) -> DataFrame:
    return paths.groupBy("a", "b").agg(F.sum("w").alias(name))


def resource_allocation(adj: DataFrame, hub: int | None = HUB) -> DataFrame:
    """(a, b, ra): sum of 1 / degree over shared neighbours that are no hubs."""
    return pair_score(two_hop(adj, 1 / F.greatest(F.lit(1), F.col("k")), hub), "ra")


def evidence(adj: DataFrame, hub: int | None = HUB) -> DataFrame:
    """(a, b, ra, shared): with the shared neighbours, those of most weight first."""
    paths = two_hop(adj, 1 / F.greatest(F.lit(1), F.col("k")), hub)
    shared = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "x")))
    return paths.groupBy("a", "b").agg(F.sum("w").alias("ra"), F.transform(shared, lambda s: s["x"]).alias("shared"))


def common_neighbours(adj: DataFrame, hub: int | None = None) -> DataFrame:
    return pair_score(two_hop(adj, F.lit(1.0), hub), "cn")


def adamic_adar(adj: DataFrame, plain: bool = False, hub: int | None = None) -> DataFrame:
    """1 / ln(1 + degree), or 1 / ln(degree) for degrees of 2 and more if ``plain``."""
    weight = F.when(F.col("k") >= 2, 1 / F.log(F.col("k"))) if plain else 1 / F.log1p(F.col("k"))
    return pair_score(two_hop(adj, weight, hub), "aa")


def both_ways(pairs: DataFrame, *cols: str) -> DataFrame:
    """(src, dst, ...) in both directions from (a, b, ...)."""
    one = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), *cols)
    return one.union(pairs.select("b", "a", *cols))


def best(pairs: DataFrame, score: str, k: int = 10) -> DataFrame:
    """The ``k`` best partners of each node."""
    return top(both_ways(pairs, score), ["src"], [F.col(score).desc(), F.col("dst")], k)


def unlinked(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """Pairs (src, dst) without a link in either direction."""
    return pairs.join(adj.select(F.col("node").alias("src"), F.col("nbr").alias("dst")), ["src", "dst"], "left_anti")


def page_rank_from(adj: DataFrame, hub: int = HUB, steps: int = 3, alpha: float = 0.15, frontier: int = 400, floor: float = 1e-6) -> DataFrame:
    """(src, dst, mass): truncated walks from every node, divided by the root of the target's degree.

    A step leaves a node of at most ``hub`` links (so a root above it has no walk) with a share of at
    least ``floor``; the heaviest ``frontier`` targets of each root go on and are added up.
    """
    deg = materialize(degree(adj), "degree")
    out = materialize(adj.join(deg.where(F.col("k") <= hub), "node"), "steps")
    front = deg.select(F.col("node").alias("src"), F.col("node").alias("at"), F.lit(1.0).alias("mass"))
    total = None
    for _ in range(steps):
        share = F.col("mass") * (1 - alpha) / F.col("k")
        step = front.join(out, F.col("at") == F.col("node")).withColumn("share", share).where(F.col("share") >= floor)
        step = step.groupBy("src", F.col("nbr").alias("at")).agg(F.sum("share").alias("mass"))
        front = materialize(top(step, ["src"], [rounded(F.col("mass"), 12).desc(), F.col("at")], frontier).drop("rank"), "front")
        total = front if total is None else total.union(front)
    mass = total.where("src <> at").groupBy("src", F.col("at").alias("dst")).agg(F.sum("mass").alias("mass"))
    goal = deg.select(F.col("node").alias("dst"), "k")
    return mass.join(goal, "dst").select("src", "dst", (F.col("mass") / F.sqrt(F.greatest(F.lit(1), F.col("k")))).alias("mass"))


def candidates(adj: DataFrame, limit: int = 10, hub: int = HUB) -> DataFrame:
    """(src, dst, score, rank): nodes without a direct link by walk mass plus resource allocation."""
    adj = materialize(adj, "graph")
    ra = both_ways(resource_allocation(adj, hub), "ra")
    score = F.col("mass") + F.coalesce("ra", F.lit(0.0))
    walked = unlinked(page_rank_from(adj, hub), adj).join(ra, ["src", "dst"], "left")
    return top(walked.select("src", "dst", score.alias("score")), ["src"], [rounded(F.col("score"), 9).desc(), F.col("dst")], limit)


def walks(adj: DataFrame, weights: list[float], share: bool = False, hub: int | None = None) -> DataFrame:
    """(src, dst, w): walks of 1, 2, ... steps, each counted with its weight; a step divides by the degree if ``share``."""
    deg = degree(adj)
    out = adj.join(deg if hub is None else deg.where(F.col("k") <= hub), "node")
    w = (1.0 / F.col("k")) if share else F.lit(1.0)
    step = out.select(F.col("node").alias("src"), F.col("nbr").alias("at"), w.alias("n"))
    first = step.select("src", "at", "n")
    parts = [first.select("src", F.col("at").alias("dst"), (F.col("n") * weights[0]).alias("w"))]
    edge = out.select("node", "nbr", w.alias("s"))
    for x in weights[1:]:
        first = first.join(edge, F.col("at") == F.col("node")).groupBy("src", F.col("nbr").alias("at")).agg(F.sum(F.col("n") * F.col("s")).alias("n"))
        parts.append(first.select("src", F.col("at").alias("dst"), (F.col("n") * x).alias("w")))
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return union.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def katz(adj: DataFrame, beta: float = 0.05, hops: int = 3, hub: int | None = None) -> DataFrame:
    return unlinked(walks(adj, [beta**h for h in range(1, hops + 1)], hub=hub), adj)


def _held(adj: DataFrame, best: int | None, hub: int | None) -> DataFrame | None:
    """``adj``, written once, if only the best ends are asked for and a task can hold it; else None."""
    if best is None or hub is not None:
        return None
    adj = materialize(adj, "graph")
    return adj if 0 < adj.count() <= local_walks.EDGES else None


def heat_kernel(adj: DataFrame, t: float = 2.0, terms: int = 4, hub: int | None = None, best: int | None = None) -> DataFrame:
    """(src, dst, w); with ``best``, at least so many of the greatest of each src, and not all."""
    weights = [math.exp(-t) * t**h / math.factorial(h) for h in range(1, terms + 1)]
    held = _held(adj, best, hub)
    if held is not None:
        return local_walks.ends(held, lambda near, src: local_walks.heat(near, src, weights), terms, best, "w")
    return unlinked(walks(adj, weights, share=True, hub=hub), adj)


def page_rank_restart(adj: DataFrame, alpha: float = 0.15, steps: int = 6, hub: int | None = None, best: int | None = None) -> DataFrame:
    """(src, dst, mass): walks whose restart mass returns to the root at every step; all places go on.

    With ``best``, at least so many of the greatest of each src, and not all.
    """
    held = _held(adj, best, hub)
    if held is not None:
        return local_walks.ends(held, lambda near, src: local_walks.restart(near, src, alpha, steps, best), steps, best, "mass")
    deg = degree(adj)
    out = adj.join(deg if hub is None else deg.where(F.col("k") <= hub), "node")
    front = deg.select(F.col("node").alias("src"), F.col("node").alias("at"), F.lit(1.0).alias("mass"))
    root = front.withColumn("mass", F.lit(alpha))
    for _ in range(steps):
        step = front.join(out, F.col("at") == F.col("node")).select("src", F.col("nbr").alias("at"), (F.col("mass") * (1 - alpha) / F.col("k")).alias("mass"))
        front = step.union(root).groupBy("src", "at").agg(F.sum("mass").alias("mass"))
    return front.where("src <> at").select("src", F.col("at").alias("dst"), "mass")


def simrank_once(adj: DataFrame, c: float = 0.8, hub: int | None = None) -> DataFrame:
    """(a, b, simrank): shared neighbours times c over the product of both degrees."""
    deg = degree(adj)
    n = common_neighbours(adj, hub)
    n = n.join(deg.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(deg.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    return n.select("a", "b", (F.col("cn") * c / (F.col("ka") * F.col("kb"))).alias("simrank"))


def preferential_attachment(adj: DataFrame, hub: int | None = None) -> DataFrame:
    deg = degree(adj)
    n = common_neighbours(adj, hub)
    n = n.join(deg.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(deg.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    return n.select("a", "b", (F.col("ka") * F.col("kb")).cast("double").alias("pa"))


def local_path(adj: DataFrame, epsilon: float = 0.01, hub: int | None = None) -> DataFrame:
    """Walks of two steps plus ``epsilon`` times those of three."""
    return unlinked(walks(adj, [0.0, 1.0, epsilon], hub=hub), adj).where("w > 0")


def three_paths(adj: DataFrame, hub: int | None = None) -> DataFrame:
    """(src, dst, l3): over paths src-u-v-dst, 1 / sqrt(degree u * degree v); src, u, v, dst as walks without an immediate return."""
    deg = degree(adj)
    mid = adj.join(deg if hub is None else deg.where(F.col("k") <= hub), "node")
    one = adj.select(F.col("node").alias("src"), F.col("nbr").alias("u"))
    two = mid.select(F.col("node").alias("u"), F.col("nbr").alias("v"), F.col("k").alias("ku"))
    three = mid.select(F.col("node").alias("v"), F.col("nbr").alias("dst"), F.col("k").alias("kv"))
    half = one.join(two, "u").where("v <> src").groupBy("src", "u", "v").agg(F.first("ku").alias("ku"))
    paths = half.join(three, "v").where("dst <> u and dst <> src")
    return paths.groupBy("src", "dst").agg(F.sum(1 / F.sqrt(F.col("ku") * F.col("kv"))).alias("l3"))


def communities(adj: DataFrame, sweeps: int = 6) -> DataFrame:
    """(node, community, size): synchronous label propagation; the commonest label of the neighbours, the least of ties."""
    label = degree(adj).select("node", F.col("node").alias("community"))
    for _ in range(sweeps):
        votes = adj.join(label.withColumnRenamed("node", "nbr"), "nbr").groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        label = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("community"))
    sizes = label.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return label.join(sizes, "community").select("node", "community", "size")


def decayed_allocation(adj: DataFrame, days: DataFrame, hub: int = HUB, scale: float = 400.0) -> DataFrame:
    """Resource allocation times exp(-gap / scale) of the days (node, day) of both ends."""
    ra = resource_allocation(adj, hub)
    ra = ra.join(days.select(F.col("node").alias("a"), F.col("day").alias("da")), "a").join(days.select(F.col("node").alias("b"), F.col("day").alias("db")), "b")
    return ra.select("a", "b", (F.col("ra") * F.exp(-F.abs(F.datediff("da", "db")) / scale)).alias("decayed"))


def open_triangles(adj: DataFrame, days: DataFrame, hub: int = HUB) -> DataFrame:
    """(a, b, spread): the greatest ln(1 + days between the ends) / degree of a shared neighbour."""
    paths = two_hop(adj, 1 / F.col("k"), hub)
    paths = paths.join(days.select(F.col("node").alias("a"), F.col("day").alias("da")), "a").join(days.select(F.col("node").alias("b"), F.col("day").alias("db")), "b")
    return paths.groupBy("a", "b").agg(F.max(F.log1p(F.abs(F.datediff("da", "db"))) * F.col("w")).alias("spread"))


def shared_entity(holds: DataFrame, weight: Column, least: int = 2, most: int = 60) -> DataFrame:
    """(a, b, w): over entities that between ``least`` and ``most`` nodes hold, the sum of a weight of their number ``h``."""
    holds = holds.select("node", "entity").distinct()
    rare = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("h")).where(F.col("h").between(least, most))
    left = holds.join(rare, "entity").select("entity", F.col("node").alias("a"), weight.cast("double").alias("w"))
    return left.join(holds.select("entity", F.col("node").alias("b")), "entity").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("w"))


def tag_overlap(holds: DataFrame, most: int = 60) -> DataFrame:
    """(a, b, cosine, jaccard) of tag sets of pairs that share a tag of at most ``most`` holders."""
    holds = holds.select("node", "entity").distinct()
    n = holds.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    shared = shared_entity(holds, F.lit(1.0), 2, most)
    shared = shared.join(n.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return shared.select("a", "b", (F.col("w") / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"), (F.col("w") / (F.col("na") + F.col("nb") - F.col("w"))).alias("jaccard"))


def temporal_proximity(days: DataFrame, reach: int = 30, scale: float = 7.0, digits: int | None = None, block: int = 1024) -> DataFrame:
    """(a, b, near): exp(-gap / scale) for days at most ``reach`` apart, rounded if ``digits`` are given.

    The nodes of a day stand in lists of about ``block``; lists meet by their days, each two once, and
    are dealt over all tasks before their nodes are paired, so that a crowded day comes to no one task.
    The score is that of the two days and is computed once for two lists.
    """
    d = days.where("node is not null and day is not null").select("node", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d"))
    n = d.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    lists = d.join(n, "d").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)))
    lists = materialize(lists.groupBy("d", "part").agg(F.collect_list("node").alias("nodes")), "days")
    left = lists.select(F.col("d").alias("da"), F.col("part").alias("pa"), F.col("nodes").alias("x"), F.explode(F.sequence(F.col("d"), F.col("d") + reach)).alias("db"))
    right = lists.select(F.col("d").alias("db"), F.col("part").alias("pb"), F.col("nodes").alias("y"))
    near = F.exp(-(F.col("db") - F.col("da")) / scale)
    spark = days.sparkSession
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = left.join(right, "db").where("da < db or pa <= pb").select(((F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb"))).alias("same"), "x", "y", (near if digits is None else F.round(near, digits)).alias("near"))
    pairs = met.repartition(tasks).select("same", "near", "y", F.explode("x").alias("v")).select("same", "near", "v", F.explode("y").alias("w"))
    return pairs.where("not same or v < w").select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"), "near")


def hubs(adj: DataFrame, share: float = 0.95) -> DataFrame:
    """(node, k) with a degree above the one at position floor(n * share) of all degrees in order.

    The position is found in a histogram of degrees, not by ranking all nodes in one task.
    """
    deg = degree(adj)
    hist = deg.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = hist.withColumn("seen", F.sum("n").over(up)).withColumn("all", F.sum("n").over(all_))
    cut = cut.where(F.col("seen") > F.floor(F.col("all") * share)).agg(F.min("k").alias("cut"))
    return deg.join(F.broadcast(cut), F.col("k") > F.col("cut")).select("node", "k")


def orphans(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    return nodes.join(adj, "node", "left_anti")


def outgoing(links: DataFrame) -> DataFrame:
    return links.where("src <> dst").select("src", "dst").distinct()
