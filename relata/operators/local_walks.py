"""Walks from every node over a graph that each task holds whole, as arrays; only the best ends are sent on.

A walk of four steps meets nearly every node of a dense graph, so a row for each pair is the square of
the nodes. Here a task takes the sources in turn, spreads their mass over the links (numpy) and keeps
what can be among the ``best`` ends of each. All sources, links and ends count; the graph goes to the
tasks as a broadcast of 4 bytes a link and 16 a node, for at most EDGES directed links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EDGES = 40_000_000
BATCH = 512
CELLS = 1_000_000
#: Places from which the last two steps of a restart walk are first followed; a limit of work, not of the result.
HEAVY = 128
#: Ends whose scores are so near the last of the best go on too, as the ranking rounds to nine digits.
SLACK = 2e-9


def arrays(adj: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted nodes, where the links of each begin, and the places of their other ends in order."""
    t = adj.select("node", "nbr").toArrow()
    node, nbr = (t.column(c).to_numpy() for c in ("node", "nbr"))
    nodes = np.unique(node)
    a, b = np.searchsorted(nodes, node), np.searchsorted(nodes, nbr)
    key = np.sort(a * len(nodes) + b)
    start = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=len(nodes)))))
    return nodes, start, (key % max(1, len(nodes))).astype(np.int32)


def _links(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of ``at`` one after the other, and the number of each."""
    n = start[at + 1] - start[at]
    return np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum())), n


class Near:
    """The part of a graph within ``steps`` links of some sources, with its own places in the order of ids."""

    def __init__(self, start: np.ndarray, nbr: np.ndarray, sources: np.ndarray, steps: int):
        seen = np.zeros(len(start) - 1, bool)
        seen[sources] = True
        edge = sources
        for _ in range(steps):
            new = nbr[_links(start, edge)[0]]
            new = np.unique(new[~seen[new]])
            if not len(new):
                break
            seen[new] = True
            edge = new
        self.places = np.flatnonzero(seen)
        self.size = len(self.places)
        here = np.cumsum(seen) - 1
        links, self.degree = _links(start, self.places)
        inside = seen[nbr[links]]
        self.nbr = here[nbr[links[inside]]]
        self.start = np.concatenate(([0], np.cumsum(inside)))[np.concatenate(([0], np.cumsum(self.degree)))]
        self.source = here[sources]

    def step(self, rows: np.ndarray, at: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells row * size + place of every neighbour of ``at``, and its share of ``mass``; cells can repeat."""
        links, n = _links(self.start, at)
        return np.repeat(rows * self.size, n) + self.nbr[links], np.repeat(mass, n)


def added(cell: np.ndarray, mass: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and the sum of each, of positive masses; few cells are sorted, many counted."""
    if 16 * len(cell) > cells:
        x = np.bincount(cell, mass, cells)
        cell = np.flatnonzero(x)
        return cell, x[cell]
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    new = np.flatnonzero(np.diff(cell, prepend=-1))
    return cell[new], np.add.reduceat(mass[order], new) if len(new) else mass[:0]


def _tabled(rows: np.ndarray, value: np.ndarray, k: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values as a table of ``many`` rows, -1 beyond their number; the place of each in it; and the ``k``-th greatest of each row."""
    count = np.bincount(rows, minlength=many)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    table = np.full((many, max(k, int(count.max(initial=0)))), -1.0)
    table[rows, nth] = value
    return table, nth, np.partition(table, table.shape[1] - k, axis=1)[:, -k][:, None]


def heat(near: Near, source: np.ndarray, weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and scores: walks of 1, 2, ... steps, each divided by the degrees and counted with its weight; no links."""
    many = len(source)
    cells = many * near.size
    rows, at, mass = np.arange(many), source, np.ones(many)
    parts = []
    for w in weights:
        cell, mass = added(*near.step(rows, at, mass * (1.0 / near.degree[at])), cells)
        rows, at = cell // near.size, cell % near.size
        parts.append((cell, w * mass))
    cell, total = added(*(np.concatenate(x) for x in zip(*parts, strict=True)), cells)
    linked = np.sort(near.step(np.arange(many), source, np.zeros(many))[0])
    free = linked[np.minimum(np.searchsorted(linked, cell), len(linked) - 1)] != cell
    return cell[free], total[free]


def _pulled(near: Near, cell: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """What a step brings to each ``cell`` from all its neighbours; ``mass`` is that of every cell, over the degree."""
    links, n = _links(near.start, cell % near.size)
    total = np.concatenate((mass[np.repeat(cell - cell % near.size, n) + near.nbr[links]], [0.0]))
    begin = np.cumsum(n) - n
    return np.where(n > 0, np.add.reduceat(total, begin), 0.0) if len(cell) else mass[:0]


def restart(near: Near, source: np.ndarray, alpha: float, steps: int, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and masses, at least of the ``best`` other ends, of walks whose restart mass returns to the source at each step.

    All places go on at each step, but only ends that can be among the best are worked out after the last
    two. These two bring to v what they bring from the source and its neighbours, which is added up, and
    of the others' mass at most degree(v) times the greatest mass over degree among them, as two steps
    from all places, with their degrees as masses, bring degree(v).
    """
    many, rest = len(source), 1 - alpha
    cells = many * near.size
    home = np.arange(many) * near.size + source
    cell, mass = home, np.ones(many)
    for _ in range(max(0, steps - 2)):
        x, share = near.step(cell // near.size, cell % near.size, mass * rest / near.degree[cell % near.size])
        cell, mass = added(np.concatenate((x, home)), np.concatenate((share, np.full(many, alpha))), cells)
    last = min(2, steps)
    per = np.zeros(cells)
    per[cell] = mass * rest / near.degree[cell % near.size]
    rows = cell // near.size
    cut = np.maximum(_tabled(rows, per[cell], HEAVY, many)[2], 0.0)
    heavy = cell[per[cell] > cut[rows, 0]]
    least = per[heavy]
    for i in range(last):
        x, share = near.step(heavy // near.size, heavy % near.size, least)
        heavy, least = added(np.concatenate((x, home)), np.concatenate((share, np.full(many, alpha))), cells)
        if i + 1 < last:
            least = least * rest / near.degree[heavy % near.size]
    rows = heavy // near.size
    other = heavy != home[rows]
    nth = _tabled(rows[other], least[other], best, many)[2]
    high = cut * rest ** (last - 1) * near.degree
    high.ravel()[heavy] += least
    wanted = np.flatnonzero((high >= nth - SLACK) & (high > 0))
    for i in range(last, 1, -1):  # places a step before the wanted
        links, n = _links(near.start, wanted % near.size)
        before = np.unique(np.repeat(wanted - wanted % near.size, n) + near.nbr[links])
        value = _pulled(near, before, per) + alpha * (before % near.size == source[before // near.size])
        per = np.zeros(cells)
        per[before] = value * rest / near.degree[before % near.size]
    total = _pulled(near, wanted, per)
    found = total > 0
    return wanted[found], total[found]


def ends(adj: DataFrame, score: Callable[[Near, np.ndarray], tuple[np.ndarray, np.ndarray]], steps: int, best: int, name: str) -> DataFrame:
    """(src, dst, name): at least the ``best`` ends of every node, by ``score(near, sources)`` of a few sources at a time."""
    spark = adj.sparkSession
    graph = spark.sparkContext.broadcast(arrays(adj))
    n = len(graph.value[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, start, nbr = graph.value
        for b in batches:
            every = b.column(0).to_numpy()
            for lo in range(0, len(every), BATCH):
                sources = every[lo : lo + BATCH]
                near = Near(start, nbr, sources, steps)
                few = max(1, min(64, CELLS // near.size))
                for i in range(0, len(sources), few):
                    mine = near.source[i : i + few]
                    cell, x = score(near, mine)
                    r, c = cell // near.size, cell % near.size
                    other = c != mine[r]
                    r, c, x = r[other], c[other], x[other]
                    good = x >= _tabled(r, x, best, len(mine))[2][r, 0] - SLACK
                    r, c, x = r[good], c[good], x[good]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[sources[i + r]]), pa.array(nodes[near.places[c]]), pa.array(x)], names=["src", "dst", name])

    parts = max(1, min(-(-n // BATCH), 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).mapInArrow(run, f"src long, dst long, {name} double")
