"""Similarity search over all notes, as a grid of blocks with partial top-k.

Exact search compares every query with every item. Queries and items are dealt into blocks, a task
multiplies one block of each (numpy) and keeps the best ``k`` of each of its queries, and the
partial lists are merged by rank. A task holds two blocks, whatever the corpus; only k rows a query
and item block are shuffled on. Ties are broken by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import vectors as V

BLOCK = 4096


def _blocked(df: DataFrame, id_col: str, vec: str, n: int, mine: str, other: str, m: int, more: tuple[str, ...] = ()) -> DataFrame:
    block = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), block.alias(mine), *more, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column])


def grid(queries: DataFrame, items: DataFrame, emit, schema: str, q_id: str = "vec_id", i_id: str = "vec_id", vec: str = "vec", block: int = BLOCK, extra: str | None = None) -> DataFrame:
    """Run ``emit(query ids, query matrix, item ids, item matrix) -> pandas`` on each pair of blocks.

    With ``extra``, a column of the queries, its values are the last argument.
    """
    nq, ni = (max(1, -(-df.count() // block)) for df in (queries, items))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="float64") for c in schema.split(",")})
        return emit(left["id"].to_numpy(), _matrix(left["vec"]), right["id"].to_numpy(), _matrix(right["vec"]), *([left[extra].tolist()] if extra else []))

    a = _blocked(queries, q_id, vec, nq, "qb", "ib", ni, (extra,) if extra else ()).groupBy("qb", "ib")
    b = _blocked(items, i_id, vec, ni, "ib", "qb", nq).groupBy("qb", "ib")
    return a.cogroup(b).applyInPandas(run, schema)


def top_k(queries: DataFrame, items: DataFrame, k: int = 10, q_id: str = "vec_id", i_id: str = "vec_id", vec: str = "vec", block: int = BLOCK, itself: bool = False, without: DataFrame | None = None, allow=None) -> DataFrame:
    """(src, dst, score, rank): the ``k`` items of greatest dot product for each query, not ``itself``.

    Pairs (src, dst) of ``without`` are left out where the blocks meet, so a query with many of them
    needs no longer list: each query carries its own. ``allow(query ids, item ids)`` is a matrix of the
    pairs that may count.
    """

    def best(qi, q, ii, m, banned):
        s = np.round(q @ m.T, 12)
        if not itself:
            s[qi[:, None] == ii[None, :]] = -np.inf
        for row, no in enumerate(banned):
            if no is not None and len(no):
                s[row, np.isin(ii, no)] = -np.inf
        if allow is not None:
            s[~allow(qi, ii)] = -np.inf
        n = min(k + 1, s.shape[1])
        pick = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(qi), 1))
        low = np.take_along_axis(s, pick, 1).min(axis=1)
        x, y = np.nonzero((s >= low[:, None]) & (s > -np.inf))
        out = pd.DataFrame({"src": qi[x], "dst": ii[y], "score": s[x, y]}).sort_values(["src", "score", "dst"], ascending=[True, False, True])
        return out.groupby("src").head(k)

    schema = "src long, dst long, score double"
    if without is None:
        part = grid(queries, items, lambda qi, q, ii, m: best(qi, q, ii, m, ()), schema, q_id, i_id, vec, block)
    else:
        no = without.groupBy(F.col("src").alias("no_id")).agg(F.collect_list(F.col("dst").cast("long")).alias("no"))
        queries = queries.join(no, F.col(q_id) == F.col("no_id"), "left")
        part = grid(queries, items, best, schema, q_id, i_id, vec, block, "no")
    w = Window.partitionBy("src").orderBy(F.col("score").desc(), "dst")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pairs_above(items: DataFrame, least: float, id_col: str = "vec_id", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(a, b, score): pairs a < b of a score of ``least`` or more."""

    def emit(qi, q, ii, m):
        s = q @ m.T
        x, y = np.nonzero((s >= least) & (qi[:, None] < ii[None, :]))
        return pd.DataFrame({"a": qi[x], "b": ii[y], "score": s[x, y]})

    return grid(items, items, emit, "a long, b long, score double", id_col, id_col, vec, block)


def moments(items: DataFrame, id_col: str = "vec_id", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(id, n, mean, sd) of each item's scores with all others (population)."""

    def emit(qi, q, ii, m):
        s = q @ m.T
        other = qi[:, None] != ii[None, :]
        return pd.DataFrame({"id": qi, "n": other.sum(axis=1), "s": np.where(other, s, 0).sum(axis=1), "ss": np.where(other, s * s, 0).sum(axis=1)})

    t = grid(items, items, emit, "id long, n long, s double, ss double", id_col, id_col, vec, block)
    t = t.groupBy("id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    return t.select("id", "n", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2)).alias("sd"))


def bimax(pairs: DataFrame, chunks: DataFrame, title_weight: float = 2.0, lone_by_mean: bool = True) -> DataFrame:
    """(src, dst, bimax): bidirectional best-passage similarity of pairs (src, dst).

    Each row of one side takes its best dot product with the other's rows, not below 0; rows are
    averaged with ``title_weight`` for row 0; both directions are averaged. With ``lone_by_mean`` a side
    of one row is compared with the other's mean, else with its best row like any other. Rows of all
    chunks of the two notes meet under the pair's key.
    """
    n = chunks.groupBy("note_id").agg(F.count(F.lit(1)).alias("rows"))
    mean = V.mean_by(chunks, ["note_id"])
    side = chunks.join(n, "note_id")

    def one_way(x: str, y: str) -> DataFrame:
        p = pairs.select("src", "dst")
        mine = p.join(side.select(F.col("note_id").alias(x), F.col("chunk_ix").alias("i"), F.col("vec").alias("v"), "rows"), x)
        many = (mine.where("rows > 1") if lone_by_mean else mine).join(chunks.select(F.col("note_id").alias(y), F.col("vec").alias("u")), y)
        if lone_by_mean:
            many = many.unionByName(mine.where("rows = 1").join(mean.select(F.col("note_id").alias(y), F.col("vec").alias("u")), y))
        got = many.groupBy("src", "dst", "i").agg(F.greatest(F.lit(0.0), F.max(V.dot("v", "u"))).alias("best"))
        w = F.when(F.col("i") == 0, title_weight).otherwise(1.0)
        return got.groupBy("src", "dst").agg((F.sum(w * F.col("best")) / F.sum(w)).alias("s"))

    both = one_way("src", "dst").unionByName(one_way("dst", "src")).groupBy("src", "dst").agg((F.sum("s") / 2).alias("bimax"))
    return pairs.select("src", "dst").join(both, ["src", "dst"], "left").select("src", "dst", F.coalesce("bimax", F.lit(0.0)).alias("bimax"))
