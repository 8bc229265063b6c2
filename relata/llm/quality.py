"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected in any stratum.

Fixed rules come first (too few words; too many repeated three-word windows). Then RULES, ratios of
counts over the whole text, are combined into one score: a ridge logistic regression over their
logarithms, fitted on at most ``max_fit`` labelled documents of one half of the labels. The score's
cutoff is chosen for each stratum over **all** labelled documents, counted by stratum, half, label
and score in Spark (a small table, however many labels there are):

* the path of cutoffs goes from lenient to strict. On the other half, the holdout, each tests the
  hypothesis "more than ``alpha`` of the good documents of this stratum would go" by its exact
  binomial tail, and the path ends at the first that can't reject it (a fixed sequence needs no
  correction along the path);
* the level is ``delta`` over the number of strata (Bonferroni). The MAX_STRATA strata with the most
  labels that can reach that level at all, ln(level) / ln(1 - alpha) good holdout documents (217 for
  four strata), stand alone; all others and rows without a stratum are pooled into one more;
* of the cutoffs that pass, the one that gains most on the first half is taken.

With probability 1 - delta every stratum loses at most ``alpha`` of its good documents to the score.
A stratum (or the pool) with too few labels has no cutoff: nothing there is rejected but by the
fixed rules.

Null and empty texts fail the fixed rules. Of several labels of one id the worst counts; of several
labelled rows with one id, the one of least measures. A null label or a null id doesn't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize, packed, table

MAX_FIT = 20_000
MAX_STRATA = 64
BROADCAST_LABELS = 1_000_000
ALPHA = 0.02
DELTA = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_upper", "n_marks", "n_digits")
RULES = ("symbols", "dup_lines", "repeats", "word_length", "upper", "marks", "digits")
#: Scores are counted in bins of this width, from -LIMIT to LIMIT.
BIN, LIMIT = 0.02, 40.0
POOL = None
NEVER = 1 << 40

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER, _MARK, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789"))


def measure_block(column: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text; a null is an empty text."""
    buf, off = words.raw(column)
    total = lambda mark: np.diff(np.concatenate(([0], np.cumsum(mark)))[off])
    few = lambda mark: np.diff(np.searchsorted(np.flatnonzero(mark), off))
    space = words._SPACE[buf]
    w = words.split(column)
    start, end, first = words.shingles(w, 3)
    n, count = w.n, np.diff(first)
    owner = np.repeat(np.arange(len(n)), count)
    real = n[owner] >= 3
    with np.errstate(over="ignore"):
        key = words.xxh64(w.buf, start, end) + words.mixed(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = (np.arange(len(key)) - np.repeat(first[:-1] - w.first[:-1], count))[twice & real]
    covered = np.zeros(len(w.start), bool)
    for o in range(3):
        covered[at + o] = True
    dup, lines = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    data = buf.tobytes()
    for i in np.flatnonzero(n):
        seen: set[bytes] = set()
        for line in data[off[i] : off[i + 1]].split(b"\n"):
            if line.strip(_SPACES):
                lines[i] += 1
                if line in seen:
                    dup[i] += 1
                else:
                    seen.add(line)
    return {
        "n_words": n,
        "word_chars": total(~space & ((buf & 0xC0) != 0x80)),
        "n_symbols": few(_SYMBOL[buf]),
        "n_dup_lines": dup,
        "n_repeat_words": np.diff(np.concatenate(([0], np.cumsum(covered)))[w.first]),
        "n_word_lines": lines,
        "n_upper": few(_UPPER[buf]),
        "n_marks": few(_MARK[buf]),
        "n_digits": few(_DIGIT[buf]),
    }


def ratios(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    part = lambda a, b: np.asarray(a, float) / np.maximum(1, b)
    return {
        "symbols": part(m["n_symbols"], m["word_chars"]),
        "dup_lines": part(m["n_dup_lines"], m["n_word_lines"]),
        "repeats": part(m["n_repeat_words"], m["n_words"]),
        "word_length": part(m["word_chars"], m["n_words"]),
        "upper": part(m["n_upper"], m["word_chars"]),
        "marks": part(m["n_marks"], m["n_words"]),
        "digits": part(m["n_digits"], m["word_chars"]),
    }


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(at most x of n) for a rate p: terms from x downwards, until they no longer count."""
    if x >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p))
    total, i = term, x
    while i > 0 and (i > n * p or term > 1e-18 * total):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    return min(1.0, total)


def features(r: dict[str, np.ndarray]) -> np.ndarray:
    logs = [np.log(np.asarray(r[x], float) + 0.01) for x in RULES]
    return np.stack([*logs, logs[RULES.index("word_length")] ** 2], axis=1)


@dataclass
class Score:
    """A linear score of standardised features; higher is worse."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def bins(self, r: dict[str, np.ndarray]) -> np.ndarray:
        x = np.clip((features(r) - self.mean) / self.scale, -20, 20)
        return np.floor(np.clip(x @ self.weight + self.bias, -LIMIT, LIMIT) / BIN).astype(np.int64)


def fit_score(r: dict[str, np.ndarray], good: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Score | None:
    """Ridge logistic regression by Newton steps; None if one of the labels is missing."""
    if good.all() or not good.any():
        return None
    x = features(r)
    mean, scale = x[good].mean(axis=0), np.maximum(x[good].std(axis=0), 0.05)
    x = np.clip((x - mean) / scale, -20, 20)
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    y = (~good).astype(float)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = np.abs(step).max()
        w += step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return Score(mean, scale, w[:-1], float(w[-1]))


def choose(counts: pd.DataFrame, alpha: float = ALPHA, delta: float = DELTA, max_strata: int = MAX_STRATA) -> dict[str | None, int]:
    """The cutoff of each stratum, POOL for the others. ``counts``: stratum, holdout, good, bin, n.

    A document goes if its bin is above the cutoff; NEVER is the cutoff where none passed.
    """
    if not len(counts):
        return {}
    held_good = counts[counts["holdout"] & counts["good"] & counts["stratum"].notna()].groupby("stratum")["n"].sum()
    ranked = sorted(held_good.items(), key=lambda kv: (-kv[1], kv[0]))[:max_strata]
    alone: set[str] = set()
    for size in range(len(ranked), 0, -1):  # fewer strata of one's own leave more of delta to each
        level = delta / (size + 1)
        if ranked[size - 1][1] * math.log1p(-alpha) <= math.log(level):
            alone = {k for k, _ in ranked[:size]}
            break
    level = delta / (len(alone) + 1)
    out: dict[str | None, int] = {}
    parts = [(k, counts["stratum"] == k) for k in sorted(alone)] + [(POOL, ~counts["stratum"].isin(alone))]
    for stratum, mine in parts:
        rows = counts[mine]
        bins = np.sort(rows["bin"].unique())[::-1]
        above = {}
        for held in (False, True):
            for good in (False, True):
                n = rows[(rows["holdout"] == held) & (rows["good"] == good)].groupby("bin")["n"].sum().reindex(bins, fill_value=0).to_numpy()
                above[held, good] = np.concatenate(([0], np.cumsum(n)))  # above[i]: in bins over bins[i]
        n_held, n_bad = int(above[True, True][-1]), int(above[False, False][-1])
        # a gain from a few bad documents may be chance
        best = (max(3.0, 0.01 * n_bad), None)
        for i, cut in enumerate(bins):
            if not n_held or binomial_tail(int(above[True, True][i]), n_held, alpha) > level:
                break
            # a good document lost costs as much as ten bad ones gain
            gain = above[False, False][i] - 10.0 * above[False, True][i]
            if gain > best[0]:
                best = (gain, int(cut))
        out[stratum] = NEVER if best[1] is None else best[1]
    return out


@dataclass
class Rules:
    """A fitted score with its cutoffs by stratum (POOL: all others); empty, it rejects nothing."""

    score: Score | None
    cutoffs: dict[str | None, int]

    def rejects(self, m: dict[str, np.ndarray], strata: list) -> np.ndarray:
        if self.score is None or not self.cutoffs:
            return np.zeros(len(strata), bool)
        pool = self.cutoffs.get(POOL, NEVER)
        cut = np.array([self.cutoffs.get(s, pool) for s in strata], np.int64)
        return self.score.bins(ratios(m)) > cut


def measures(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The ``keep`` columns and MEASURES of every row."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, batch.schema.names[n]):
                m = measure_block(b.column(n))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *(pa.array(m[x].astype(np.int64)) for x in MEASURES)], names=[*b.schema.names[:n], *MEASURES])

    schema = docs.select(*keep, *(F.lit(0).cast("long").alias(x) for x in MEASURES)).schema
    return docs.select(*keep, F.col(text).cast("string").alias("text of it")).mapInArrow(run, schema)


def _arrays(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {x: np.asarray(b.column(x)) for x in MEASURES}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", good: str = "quality", max_fit: int = MAX_FIT, alpha: float = ALPHA, delta: float = DELTA, measured_docs: DataFrame | None = None) -> Rules:
    """The score of at most ``max_fit`` labelled rows, with cutoffs over all of them.

    ``measured_docs``, if they are at hand, are the rows (id, stratum, MEASURES) of ``docs``. Only
    measures are joined with the labels, never texts.
    """
    chosen = labels.where(F.col(good).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg((F.min(F.col(good)) > 0).alias("good"))
    rows = measured_docs
    if rows is None:
        held = docs.select(F.col(id_col).alias("id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
        ids = materialize(chosen.select(F.col("label_id").alias("id")), "label-ids")
        if ids.count() <= BROADCAST_LABELS:  # else all texts are measured where they are, and only measures meet the labels
            held = held.join(F.broadcast(ids), "id", "left_semi")
        rows = measures(held, [F.col("id"), F.col("stratum")])
    rows = rows.join(chosen, F.col("id") == F.col("label_id")).groupBy("id", "good").agg(F.min(F.struct("stratum", *MEASURES)).alias("m"))
    hash_ = F.xxhash64("id")
    rows = materialize(rows.select("id", "good", (F.shiftrightunsigned(hash_, 7) % 2 == 1).alias("holdout"), hash_.alias("h"), "m.*"), "labelled")
    passed = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.where(passed)
    first = rows.where(~F.col("holdout")).orderBy("h", "id").limit(max_fit).toPandas()
    score = fit_score(ratios({x: first[x].to_numpy() for x in MEASURES}), first["good"].to_numpy(bool)) if len(first) else None
    if score is None:
        return Rules(None, {})
    own = [r["stratum"] for r in rows.where("stratum is not null").groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(MAX_STRATA).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("stratum"), b.column("holdout"), b.column("good"), pa.array(score.bins(ratios(_arrays(b))))], names=["stratum", "holdout", "good", "bin"])

    counts = rows.mapInArrow(run, "stratum string, holdout boolean, good boolean, bin long")
    counts = counts.withColumn("stratum", F.when(F.col("stratum").isin(own), F.col("stratum")))
    counts = counts.groupBy("stratum", "holdout", "good", "bin").agg(F.count(F.lit(1)).alias("n")).toPandas()
    return Rules(score, choose(counts, alpha, delta))


def verdict(m: dict[str, np.ndarray], strata: list, rules: Rules) -> np.ndarray:
    return ~base_failed(m) & ~rules.rejects(m, strata)


def judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` of (id, stratum, MEASURES) with base_failed and kept."""
    schema = rows.select("*", F.lit(True).alias("base_failed"), F.lit(True).alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _arrays(b)
            ok = verdict(m, b.column("stratum").to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base_failed(m)), pa.array(ok)], names=[*b.schema.names, "base_failed", "kept"])

    return rows.mapInArrow(run, schema)


def measured(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(id, MEASURES, base_failed, kept) for every row."""
    rows = measures(docs, [F.col(id_col).alias("id"), F.col(stratum).cast("string").alias("stratum")], text)
    return judged(rows, rules).drop("stratum").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, rules: Rules, text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    frame = packed(docs, F.col(stratum).cast("string").alias("stratum"))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(words.with_text(batch, place), "text"):
                ok = verdict(measure_block(b.column("text")), b.column("stratum").to_pylist(), rules)
                yield b.select(["row"]).filter(pa.array(ok))

    return frame.mapInArrow(run, frame.select("row").schema).select("row.*")


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialize(measures(docs, [F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("stratum")]), "measures")
    out = judged(rows, fit(docs, table(spark, sf_dir, "labels"), measured_docs=rows))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
