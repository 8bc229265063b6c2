import numpy as np
from pyspark.sql import functions as F

from relata.functions import vectors as V
from relata.operators import cluster, fusion, similarity


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vec array<double>")


def unit_rows(n, d=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dot_of_other_lengths_is_zero(spark):
    r = frame(spark, [(1, [1.0, 2.0])]).select(V.dot("vec", F.array(F.lit(1.0))).alias("a"), V.dot("vec", F.lit(None).cast("array<double>")).alias("b"), V.dot("vec", "vec").alias("c")).first()
    assert tuple(r) == (0.0, 0.0, 5.0)


def test_centred_rows_are_orthogonal_to_the_centroid(spark):
    df = frame(spark, [(i, list(map(float, v))) for i, v in enumerate(unit_rows(30))])
    c = V.centroid(df).first()["centroid"]
    for r in V.centered(df).collect():
        assert abs(np.dot(r.vec, c)) < 1e-9 and abs(np.linalg.norm(r.vec) - 1) < 1e-9


def test_quantised_round_trip(spark):
    rows = [(i, list(map(float, v))) for i, v in enumerate(unit_rows(20, 64))] + [(99, [0.0] * 64)]
    q = frame(spark, rows).withColumn("s", V.scale_of("vec")).withColumn("q", V.quantize("vec", "s")).withColumn("back", V.dequantize("q", "s"))
    for r in q.collect():
        assert max(map(abs, r.q)) <= 127
        assert (r.vec_id == 99 and r.s == 1.0 and not any(r.back)) or np.dot(r.vec, r.back) > 0.99


def test_top_k_in_many_blocks(spark):
    x = unit_rows(57)
    df = frame(spark, [(i, list(map(float, v))) for i, v in enumerate(x)])
    want = {}
    for i, s in enumerate(np.round(x @ x.T, 12)):
        want[i] = sorted((j for j in range(57) if j != i), key=lambda j: (-s[j], j))[:5]
    got = {}
    for r in similarity.top_k(df, df, 5, block=10).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == want


def test_bimax_is_symmetric_and_in_range(spark):
    x = unit_rows(9)
    chunks = spark.createDataFrame([(i // 4, i % 4, list(map(float, v))) for i, v in enumerate(x)], "note_id long, chunk_ix int, vec array<double>")
    pairs = spark.createDataFrame([(a, b) for a in range(3) for b in range(3) if a != b], "src long, dst long")
    got = {(r.src, r.dst): r.bimax for r in similarity.bimax(pairs, chunks).collect()}
    assert len(got) == 6 and all(abs(v - got[b, a]) < 1e-12 and 0 <= v <= 1 for (a, b), v in got.items())


def test_flat_channel_has_no_weight(spark):
    s = spark.createDataFrame([(1, i, float(i), 2.0) for i in range(4)], "src long, dst long, a double, b double")
    assert [r.dst for r in fusion.fuse(s, {"a": 1.0, "b": 9.0}).orderBy("rank").collect()] == [3, 2, 1, 0]


def test_kmeans_cost_falls_and_finds_planted_groups(spark):
    rng = np.random.default_rng(3)
    centre = np.eye(8)[:3]
    x = np.repeat(centre, 20, axis=0) + rng.normal(scale=0.05, size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, [(i, list(map(float, v))) for i, v in enumerate(x)])
    got, _, costs = cluster.kmeans(df, 3)
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:], strict=False))
    by = {r.vec_id: r.cluster for r in got.collect()}
    assert all(len({by[20 * g + i] for i in range(20)}) == 1 for g in range(3)) and len(set(by.values())) == 3


def test_link_metric(spark):
    import numpy as np

    from relata.operators import metric

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, (7 * i + 3) % 60) for i in range(60)]
    df = spark.createDataFrame([(x[a].tolist(), x[b].tolist()) for a, b in pairs] + [([1.0], x[0].tolist()), (None, None)], "a array<double>, b array<double>")
    found, values = metric.difference_directions(df, 2)
    d = np.array([x[a] - x[b] for a, b in pairs])
    moment = d.T @ d / len(d)
    assert np.allclose(moment @ found.T, found.T * values) and np.allclose(values, np.linalg.eigvalsh(moment)[::-1][:2])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>")
    hard = np.array([r.vec for r in metric.reweighted(rows, found, values).orderBy("vec_id").collect()])
    want = x - (x @ found.T) @ found
    assert np.allclose(hard, want / np.linalg.norm(want, axis=1, keepdims=True))
    soft = np.array([r.vec for r in metric.reweighted(rows, found, values, 0.05).orderBy("vec_id").collect()])
    want = x + sum((x @ f)[:, None] * (1 / np.sqrt(v / values[0] + 0.05) - 1) * f for f, v in zip(found, values, strict=True))
    assert np.allclose(soft, want / np.linalg.norm(want, axis=1, keepdims=True))
    none = metric.difference_directions(df.where("false"), 2)
    assert metric.reweighted(rows, *none).count() == 60


def test_attributed_and_allowed_pairs(spark):
    from relata.functions import vectors as V
    from relata.operators import similarity as S

    df = spark.createDataFrame([(1, [3.0, 4.0], [0.0, 1.0]), (2, [3.0, 4.0], None)], "vec_id long, vec array<double>, around array<double>")
    got = {r.vec_id: r.v for r in df.select("vec_id", V.attributed("vec", "around", 0.0).alias("v")).collect()}
    assert got == {1: [0.6, 0.8, 0.0, 0.0], 2: [3.0, 4.0]}
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, vec array<double>")
    near = S.top_k(items, items, 2, allow=lambda q, i: i[None, :] < q[:, None])
    assert sorted((r.src, r.dst) for r in near.collect()) == [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 2), (4, 3)]
