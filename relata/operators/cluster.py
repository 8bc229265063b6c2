"""Corpus map: spherical k-means, principal components, cluster labels and agreement measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import materialize

# fixed values: title words without a topic
STOP = "the a an of and or to in on for is are was with that this it as by from at der die das und oder ein eine in im auf mit von zu fuer ist sind war den dem des als bei aus nach vor durch ueber um beim zur zum".split()


def suggest_k(n: int) -> int:
    return max(3, min(16, int(np.floor(np.sqrt(n / 2) + 0.5))))


def _sums(df: DataFrame, vec: str, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Vector sums and sizes by nearest centre, and the inertia; a task sends k rows."""
    k, d = centers.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, size, cost = np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, float) for v in b[vec]])
                s = np.round(x @ centers.T, 12)
                a = s.argmax(axis=1)
                np.add.at(total, a, x)
                size += np.bincount(a, minlength=k)
                cost += np.bincount(a, 1 - s.max(axis=1), minlength=k)
        yield pd.DataFrame({"c": np.arange(k), "total": list(total), "size": size, "cost": cost})

    got = df.select(vec).mapInPandas(run, "c int, total array<double>, size double, cost double")
    rows = got.groupBy("c").agg(*(F.sum(F.element_at("total", i + 1)).alias(f"t{i}") for i in range(d)), F.sum("size").alias("size"), F.sum("cost").alias("cost")).orderBy("c").collect()
    return np.array([[r[f"t{i}"] for i in range(d)] for r in rows]), np.array([r["size"] for r in rows]), sum(r["cost"] for r in rows)


def _nearest(c: np.ndarray):
    @F.pandas_udf("double")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(np.round((np.stack([np.asarray(x, float) for x in v]) @ c.T).max(axis=1), 12))

    return nearest


def seeds(df: DataFrame, k: int, id_col: str, vec: str) -> np.ndarray:
    """Farthest-point seeding: the row of least id, then always the row least like its nearest seed."""
    centers = [df.orderBy(id_col).select(vec).first()[0]]
    while len(centers) < k:
        near = _nearest(np.array(centers, float))
        centers.append(df.select(id_col, vec, near(vec).alias("s")).orderBy("s", id_col).select(vec).first()[0])
    return np.array(centers, float)


def kmeans(df: DataFrame, k: int, id_col: str = "vec_id", vec: str = "vec", rounds: int = 30) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(assignments (id, cluster), centres, inertia by round) of unit vectors.

    Only k centres and k sums a task travel. An empty cluster keeps its centre; ties go to the lower
    index; it stops when no sum changes.
    """
    df = materialize(df.select(id_col, vec), "vectors")
    if df.isEmpty():
        return df.select(id_col, F.lit(0).alias("cluster")), np.zeros((0, 0)), []
    centers, costs, last = seeds(df, k, id_col, vec), [], None
    for _ in range(rounds):
        total, size, cost = _sums(df, vec, centers)
        costs.append(cost)
        if last is not None and np.array_equal(last, size) and abs(costs[-2] - cost) < 1e-12:
            break
        last = size
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where((size[:, None] > 0) & (norm > 0), total / np.where(norm > 0, norm, 1), centers)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.round(np.stack([np.asarray(v, float) for v in b[vec]]) @ centers.T, 12)
                yield pd.DataFrame({id_col: b[id_col], "cluster": s.argmax(axis=1).astype(np.int32)})

    return df.select(id_col, vec).mapInPandas(assign, f"{id_col} {dict(df.dtypes)[id_col]}, cluster int"), centers, costs


def components(df: DataFrame, n: int = 2, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) from one pass that sums outer products; the greatest entry of each is positive."""
    d = len(df.select(vec).first()[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, ss, m = np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, float) for v in b[vec]])
                s, ss, m = s + x.sum(axis=0), ss + x.T @ x, m + len(x)
        yield pd.DataFrame({"i": np.arange(d), "s": s, "row": list(ss), "n": m})

    got = df.select(vec).mapInPandas(run, "i int, s double, row array<double>, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), *(F.sum(F.element_at("row", j + 1)).alias(f"r{j}") for j in range(d))).orderBy("i").collect()
    count = got[0]["n"]
    mean = np.array([r["s"] for r in got]) / count
    cov = np.array([[r[f"r{j}"] for j in range(d)] for r in got]) / count - np.outer(mean, mean)
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :n].T
    return mean, vectors * np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])[:, None]


def project(df: DataFrame, id_col: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(id, x, y) in [0, 1]: two principal components, min-max scaled over all rows."""
    mean, comps = components(df, 2, vec)

    def at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = (np.stack([np.asarray(v, float) for v in b[vec]]) - mean) @ comps.T
                yield pd.DataFrame({id_col: b[id_col], "x": x[:, 0], "y": x[:, 1]})

    p = df.select(id_col, vec).mapInPandas(at, f"{id_col} {dict(df.dtypes)[id_col]}, x double, y double")
    r = p.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    return p.crossJoin(F.broadcast(r)).select(id_col, scaled("x").alias("x"), scaled("y").alias("y"))


def without_top(df: DataFrame, n: int = 2, vec: str = "vec") -> DataFrame:
    """Vectors without the mean and their first ``n`` components, normalised."""
    mean, comps = components(df, n, vec)

    @F.pandas_udf("array<double>")
    def cut(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(a, float) for a in v]) - mean
        x -= (x @ comps.T) @ comps
        return pd.Series(list(x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))))

    return df.withColumn(vec, cut(vec))


def term_scores(titles: DataFrame) -> DataFrame:
    """(cluster, word, score) of (id, cluster, title): share of the cluster's words times ln(1 + titles / titles with the word)."""
    words = titles.select("id", "cluster", F.explode(F.split(F.lower("title"), r"[^\p{L}\p{N}]+")).alias("word"))
    words = words.where((F.length("word") >= 3) & F.col("word").rlike(r"\p{L}") & ~F.col("word").isin(STOP))
    tf = words.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    total = words.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    df = words.select("id", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    c = F.broadcast(titles.agg(F.count(F.lit(1)).alias("c")))
    s = tf.join(total, "cluster").join(df, "word").crossJoin(c)
    return s.select("cluster", "word", F.round(F.col("n") / F.col("m") * F.log1p(F.col("c") / F.col("df")), 9).alias("score"))


def labels(titles: DataFrame, words: int = 3) -> DataFrame:
    """(cluster, label): best words, none a prefix of another, joined; "Group n" for a cluster without any."""
    best = term_scores(titles).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "word"))), lambda x: x["word"]).alias("w"))

    def step(acc, w):
        clash = F.exists(acc, lambda p: p.startswith(w) | w.startswith(p))
        return F.when((F.size(acc) >= words) | clash, acc).otherwise(F.concat(acc, F.array(w)))

    picked = best.select("cluster", F.array_join(F.aggregate("w", F.array().cast("array<string>"), step), " · ").alias("label"))
    all_ = titles.select("cluster").distinct()
    return all_.join(picked, "cluster", "left").select("cluster", F.coalesce("label", F.concat(F.lit("Group "), (F.col("cluster") + 1).cast("string"))).alias("label"))


def agreement(df: DataFrame) -> DataFrame:
    """One row, purity and normalised mutual information of (cluster, truth)."""
    n = df.groupBy("cluster", "truth").agg(F.count(F.lit(1)).alias("n"))
    a = n.groupBy("truth").agg(F.sum("n").alias("na"))
    b = n.groupBy("cluster").agg(F.sum("n").alias("nb"), F.max("n").alias("top"))
    t = F.broadcast(n.agg(F.sum("n").alias("t")))
    h = lambda x: -F.sum(F.col(x) / F.col("t") * F.log(F.col(x) / F.col("t")))
    mi = n.join(a, "truth").join(b, "cluster").crossJoin(t).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    ha, hb = a.crossJoin(t).agg(h("na").alias("ha")), b.crossJoin(t).agg(h("nb").alias("hb"), (F.sum("top") / F.max("t")).alias("purity"))
    return mi.crossJoin(ha).crossJoin(hb).select(F.round("purity", 6).alias("purity"), F.round(2 * F.col("mi") / (F.col("ha") + F.col("hb")), 6).alias("nmi"))


def corpus_map(df: DataFrame, id_col: str = "vec_id", vec: str = "vec", least: int = 3) -> DataFrame:
    """(id, x, y, cluster, size): places and clusters of all vectors of the commonest length.

    Fewer than ``least`` vectors make an empty map; clusters without a member don't appear.
    """
    n = F.size(vec)
    common = df.where(n > 0).groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    kind = dict(df.dtypes)[id_col]
    if common is None or common["c"] < least:
        return df.sparkSession.createDataFrame([], f"{id_col} {kind}, x double, y double, cluster int, size long")
    rows = materialize(df.where(n == common["n"]).select(id_col, vec), "map")
    places = project(rows, id_col, vec)
    member = kmeans(rows, min(suggest_k(common["c"]), common["c"]), id_col, vec)[0]
    size = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    out = places.join(member, id_col).join(F.broadcast(size), "cluster")
    return out.select(id_col, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster", "size")


def _title_words(titles: DataFrame, pattern: str, least: int) -> DataFrame:
    words = titles.select("id", "cluster", F.explode(F.array_distinct(F.split(F.lower("title"), pattern))).alias("word"))
    return words.where(F.length("word") >= least)


def _joined(scored: DataFrame, words: int) -> DataFrame:
    best = scored.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "word"))).alias("w"))
    return best.select("cluster", F.array_join(F.transform(F.slice("w", 1, words), lambda x: x["word"]), " · ").alias("label"))


def count_labels(titles: DataFrame, words: int = 3) -> DataFrame:
    """(cluster, label): the words of four characters or more that most titles (id, cluster, title) have; ties by word."""
    counts = _title_words(titles, "[^a-z0-9]+", 4).groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("score"))
    return _joined(counts, words)


def share_labels(titles: DataFrame, words: int = 2) -> DataFrame:
    """(cluster, label): words over three characters by share of the cluster's titles x ln(titles / titles with the word)."""
    w = _title_words(titles, r"[^\p{L}\p{N}]+", 4).where("word <> 'eine'")
    mine = w.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    every = mine.groupBy("word").agg(F.sum("n").alias("df"))
    size = titles.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    c = F.broadcast(titles.agg(F.count(F.lit(1)).alias("c")))
    scored = mine.join(every, "word").join(size, "cluster").crossJoin(c)
    return _joined(scored.select("cluster", "word", F.round(F.col("n") / F.col("m") * F.log(F.col("c") / F.col("df")), 9).alias("score")), words)
