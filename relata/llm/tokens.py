"""Token counts under a unigram model, by dynamic programming shared over a trie.

A pre-token is a word with a mark for the space before it. Distinct pre-tokens are inserted in a
trie; a node is one prefix, and its forward score, the best sum of piece scores over all ways to
cut that prefix, is computed once, when the node is made, from the scores on its path. The counts
of the best cut at terminal nodes are stored, and a document adds up those of its words.

The vocabulary is a public piece model given by path. It has no unigram scores, so a piece of rank
r has the Zipf score -ln(r + 1); a character outside the vocabulary is spelt in byte pieces. Of
equal scores the cut with fewer pieces is taken. Each task has its own trie and nothing is shuffled;
a trie or a table of counts that reaches its bound is begun anew, which costs time but no result.
Prefixes of more than MAX_DEPTH characters are hardly ever shared: beyond it the scores go on in a
window of as many places as the longest piece has characters, so a word of any length takes bounded
memory. Null and empty texts have no words; repeated rows and rows of one id are counted each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import WORD, table

MARK = "▁"
MAX_NODES = 400_000
MAX_COUNTS = 600_000
MAX_DEPTH = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[dict[str, float], list[float]]:
    """Scores of pieces, and those of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, float] = {}
    byte = [0.0] * 256
    for i in range(model.get_piece_size()):
        score = -math.log(i + 1)
        if model.is_byte(i):
            byte[int(model.id_to_piece(i)[3:-1], 16)] = score
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = score
    return pieces, byte


class Trie:
    """Prefixes with (score, -pieces) of their best cut."""

    def __init__(self, pieces: dict[str, float], byte: list[float]):
        self.pieces, self.byte = pieces, byte
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score = [0.0]
        self.count = [0]

    def add(self, word: str) -> int:
        """Insert a pre-token; the number of pieces of its best cut."""
        child, score, count, pieces, longest = self.child, self.score, self.count, self.pieces, self.longest
        path = [0]
        node = 0
        for i, c in enumerate(word[:MAX_DEPTH]):
            key = (node, c)
            node = child.get(key)
            if node is None:
                spelt = c.encode()
                one = pieces.get(c)
                best, n = (score[path[i]] + one, count[path[i]] + 1) if one is not None else (score[path[i]] + sum(self.byte[b] for b in spelt), count[path[i]] + len(spelt))
                for j in range(max(0, i + 1 - longest), i):
                    s = pieces.get(word[j : i + 1])
                    if s is not None:
                        s += score[path[j]]
                        if s > best or s == best and count[path[j]] + 1 < n:
                            best, n = s, count[path[j]] + 1
                node = len(score)
                child[key] = node
                score.append(best)
                count.append(n)
            path.append(node)
        return count[node] if len(word) <= MAX_DEPTH else self.beyond(word, path)

    def beyond(self, word: str, path: list[int]) -> int:
        """Go on from the trie's last node to the end of a long word."""
        pieces, longest = self.pieces, self.longest
        score, count = [self.score[n] for n in path[-longest:]], [self.count[n] for n in path[-longest:]]
        for i in range(len(path) - 1, len(word)):
            first = i + 1 - len(score)  # length of the prefix that score[0] is of
            c = word[i]
            one = pieces.get(c)
            spelt = c.encode()
            best, n = (score[-1] + one, count[-1] + 1) if one is not None else (score[-1] + sum(self.byte[b] for b in spelt), count[-1] + len(spelt))
            for j in range(max(0, i + 1 - longest), i):
                s = pieces.get(word[j : i + 1])
                if s is not None:
                    s += score[j - first]
                    if s > best or s == best and count[j - first] + 1 < n:
                        best, n = s, count[j - first] + 1
            score.append(best)
            count.append(n)
            if len(score) > 64 * longest:
                del score[:-longest], count[:-longest]
        return count[-1]


class Counts(dict):
    """Word -> pieces; a missing word is counted by the trie."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self.trie.score) > MAX_NODES:
            self.trie.clear()
        n = self.trie.add(MARK + word)
        if len(word) <= MAX_DEPTH:
            self[word] = n
        return n


def count(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens) for every row; a null or empty text has none."""
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(model or default_model()))
    schema = docs.select(id_col, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_tokens")).schema
    find = re.compile(WORD).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(Trie(*sent.value))
        for batch in batches:
            for b in words.blocks(batch, "text of it"):
                n, m = [], []
                for t in b.column("text of it").to_pylist():
                    found = find(t) if t else []
                    n.append(len(found))
                    m.append(sum(map(counts.__getitem__, found)))
                    if len(counts) > MAX_COUNTS:
                        counts.clear()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    return docs.select(id_col, F.col(text).cast("string").alias("text of it")).mapInArrow(run, schema)


def tokens_query(spark, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
