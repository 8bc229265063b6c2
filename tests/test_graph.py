import math

from pyspark.sql import functions as F

from relata.operators import graph as G


def star(spark, n):
    return G.adjacency(spark.createDataFrame([(0, i) for i in range(1, n + 1)] + [(5, 5)], "src long, dst long"))


def test_adjacency_drops_loops_and_doubles(spark):
    a = G.adjacency(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3)], "src long, dst long"))
    assert sorted(map(tuple, a.collect())) == [(1, 2), (2, 1)]


def test_hub_of_40_counts_and_of_41_does_not(spark):
    pair = (F.col("a") == 1) & (F.col("b") == 2)
    assert math.isclose(G.resource_allocation(star(spark, 40)).where(pair).first()["ra"], 1 / 40)
    assert G.resource_allocation(star(spark, 41)).count() == 0
    assert math.isclose(G.resource_allocation(star(spark, 41), None).where(pair).first()["ra"], 1 / 41)


def test_root_above_the_hub_degree_has_no_walk(spark):
    w = G.page_rank_from(star(spark, 41))
    assert w.where("src = 0").count() == 0
    # one step from a leaf reaches the hub, and stops there
    assert [(r.dst, round(r.mass, 9)) for r in w.where("src = 1").collect()] == [(0, round(0.85 / math.sqrt(41), 9))]


def test_walk_by_hand(spark):
    a = G.adjacency(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    got = {(r.src, r.dst): r.mass for r in G.page_rank_from(a).collect()}
    one, two, three = 0.85, 0.85**2 / 2, 0.85**3 / 2
    assert math.isclose(got[1, 2], (one + three * 2) / math.sqrt(2))
    assert math.isclose(got[1, 3], two)


def test_candidates_leave_out_links(spark):
    a = G.adjacency(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long"))
    assert not {(r.src, r.dst) for r in G.candidates(a).collect()} & {(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)}


def test_empty_graph(spark):
    a = G.adjacency(spark.createDataFrame([], "src long, dst long"))
    for f in (G.resource_allocation, G.page_rank_from, G.candidates, G.communities, G.katz, G.hubs):
        assert f(a).collect() == []
