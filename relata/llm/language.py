"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ORDER bytes with frozen counts. A byte seen in a
context costs log2((total + distinct) / count); one that isn't costs the escape, log2((total +
distinct) / distinct), plus its cost in the context without the oldest byte, down to a uniform code
over 256 bytes. A context that a language never saw costs nothing and passes to the shorter one.
These costs are exact and depend on the last ORDER bytes only, so they are laid out once as a table
of (longest known context, byte) x language, and a text is scored by looking its bytes up. Languages
share a table of up to CELLS cells; further ones have tables of their own, so memory grows with the
number of languages and not with its square.

Training takes about ``per_language`` rows a language, picked by a hash of their id; of a longer text
than ``max_chars`` it takes that many characters from a place picked by the hash, so a language
that has only long texts is learned too. Prediction covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import table

ORDER = 3
PER_LANGUAGE = 300
MAX_CHARS = 20_000
CELLS = 1 << 22
_PAD = b"\n" * ORDER
_STEP = 1 << 20


class Table:
    """Frozen code lengths of some languages: of each longest known context, what each byte costs in each language."""

    def __init__(self, joined: list[list[np.ndarray]], order: int):
        self.order = order
        seen = np.zeros(256, bool)
        for parts in joined:
            for p in parts:
                seen[p] = True
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        self.symbol[65:91] = self.symbol[97:123]
        a = self.a = int(seen.sum()) + 1
        # counts of (context, next) by order and language
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for k in range(order + 1):
            row = []
            for parts in joined:
                grams = []
                for p in parts:
                    s = self.symbol[p]
                    code = np.zeros(len(s) - order, np.int64)
                    for j in range(k, -1, -1):
                        code = code * a + s[order - j : len(s) - j]
                    grams.append(code)
                row.append(np.unique(np.concatenate(grams), return_counts=True))
            counts.append(row)
        n = len(joined)
        cost = [np.full((1, a, n), 8.0, np.float32)]
        base = 1
        state = np.zeros(1, np.int32)  # of each context of the order below, its longest known suffix
        below = cost[0].astype(np.float64)
        first = 0
        for k in range(order + 1):
            known = np.unique(np.concatenate([grams // a for grams, _ in counts[k]]))
            # the suffix of a known context was seen too, so it is a row of the order below
            parent = state[known % (a ** (k - 1))] - first if k else np.zeros(len(known), np.int32)
            mine = below[parent]
            for i, (grams, times) in enumerate(counts[k]):
                at = np.searchsorted(known, grams // a)
                total = np.bincount(at, times, len(known))
                distinct = np.bincount(at, minlength=len(known))
                have = np.flatnonzero(total)
                mine[have, :, i] += np.log2((total + distinct)[have] / distinct[have])[:, None]
                mine[at, grams % a, i] = np.log2((total + distinct)[at] / times)
            cost.append(mine.astype(np.float32))
            state = np.tile(state, a) if k else state.copy()
            state[known] = base + np.arange(len(known))
            below, first, base = mine, base, base + len(known)
        self.state = state.astype(np.int32)
        self.cost = np.concatenate(cost).reshape(-1, n)

    def add_bits(self, out: np.ndarray, data: np.ndarray, real: np.ndarray, owner: np.ndarray) -> None:
        """Add the cost of the bytes at the places ``real`` to the rows ``owner`` of ``out``."""
        s = self.symbol[data]
        for lo in range(0, len(real), _STEP):
            at = real[lo : lo + _STEP]
            context = np.zeros(len(at), np.int64)
            for j in range(self.order, 0, -1):
                context = context * self.a + s[at - j]
            cost = self.cost[self.state[context].astype(np.int64) * self.a + s[at]]
            who = owner[lo : lo + _STEP]
            begins = np.flatnonzero(np.diff(who, prepend=-1))
            out[who[begins]] += np.add.reduceat(cost, begins, axis=0, dtype=np.float64)


def _groups(joined: list[list[np.ndarray]], order: int, cells: int) -> Iterator[tuple[int, int]]:
    """Successive languages whose common table has about ``cells`` cells or is that of one language."""
    start, held, seen = 0, np.zeros(0, np.int64), np.zeros(256, bool)
    for i, parts in enumerate(joined):
        mine, letters = np.zeros(0, np.int64), np.zeros(256, bool)
        for p in parts:
            code = np.zeros(len(p) - order, np.int64)
            for j in range(order, 0, -1):
                code = (code << 8) | p[order - j : len(p) - j]
            mine = np.union1d(mine, code)
            letters[p] = True
        both = np.union1d(held, mine)
        if i > start and len(both) * int((seen | letters).sum()) * (i - start + 1) > cells:
            yield start, i
            start, held, seen = i, mine, letters
        else:
            held, seen = both, seen | letters
    if joined:
        yield start, len(joined)


class Model:
    """Frozen code lengths for all languages, in tables of a few languages, so that memory grows with their number alone."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, cells: int = CELLS):
        self.languages = sorted(k for k, v in texts.items() if any(v))
        self.order = order
        joined = [[words._LOWER[np.frombuffer(_PAD[:order] + t.encode(), np.uint8)] for t in texts[k] if t] for k in self.languages]
        self.tables = [(x, y, Table(joined[x:y], order)) for x, y in _groups(joined, order, cells)]

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        coded = [(t or "").encode() for t in texts]
        size = np.array([self.order + len(c) for c in coded], np.int64)
        data = np.frombuffer(b"".join(_PAD[: self.order] + c for c in coded), np.uint8)
        end = np.cumsum(size)
        owner = np.repeat(np.arange(len(texts)), size - self.order)
        real = np.ones(len(data), bool)
        for j in range(self.order):
            real[end - size + j] = False
        real = np.flatnonzero(real)
        for x, y, part in self.tables:
            part.add_bits(out[:, x:y], data, real, owner)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior under equal priors; ``und`` and 0 for a text without a letter."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.bits(texts)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
        letter = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], np.where(letter, np.minimum(score, 1.0), 0.0)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text modulo 4 is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model:
    """A model of the rows that aren't held out and have a language and a text; null and empty ones teach nothing.

    The driver takes about ``per_language`` pieces of at most ``max_chars`` characters of each language.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(id_col)).alias("h"), held_out(id_col).alias("out"))
    rows = rows.where(~F.col("out") & F.col("lang").isNotNull() & (F.length("t") > 0))
    more = F.greatest(F.length("t") - max_chars, F.lit(0))
    piece = F.when(more > 0, F.substring("t", F.pmod(F.xxhash64("h"), more + 1).cast("int") + 1, F.lit(max_chars))).otherwise(F.col("t"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model({})
    whole = 1 << 30
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(whole, int(whole * per_language / n) + 1))))
    texts: dict[str, list[str]] = {}
    for r in rows.where(F.pmod(F.col("h"), F.lit(whole)) < share[F.col("lang")]).select("lang", piece.alias("t")).collect():
        texts.setdefault(r["lang"], []).append(r["t"])
    return Model(texts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; only the text enters the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(id_col, F.lit(True).alias("held_out"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch, "__text", 2 << 20):
                lang, score = sent.value.predict(b.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    return docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def language_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
