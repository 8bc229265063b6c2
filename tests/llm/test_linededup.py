import random

import numpy as np
import pyarrow as pa

from relata.llm import linededup as L
from relata.llm.common import components

SCHEMA = "doc_id long, text string, n_chars long, line string, h1 long, __id long, __gone long, __new long, __text string, row long, gone long, size long, key long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, line, k):
    for _ in range(k):
        i = rnd.randrange(len(line) + 1)
        line = rnd.choice([line[:i] + line[i + 1 :], line[:i] + rnd.choice("abé ") + line[i:], line[:i] + "ß" + line[i + 1 :]])
    return line


def test_banded_distance():
    rnd = random.Random(1)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14)))
        b = edited(rnd, a, rnd.randint(0, 4)) if a and rnd.random() < 0.8 else "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14)))
        for tau in (0, 1, 2, 3):
            assert L.within(a, b, tau) == (distance(a, b) <= tau), (a, b, tau)


def corpus():
    rnd = random.Random(2)
    pool = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(20, 90))).strip() or "x" * 20 for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n\n"), (3, "short\nshort\nshort")]
    for i in range(4, 60):
        lines = []
        for _ in range(rnd.randint(1, 8)):
            x = rnd.choice(pool)
            lines.append(rnd.choice(["", " ", "\t"]) + (x if rnd.random() < 0.4 else edited(rnd, x, rnd.randint(1, 4))))
        rows.append((i, "\n".join(lines)))
    rows.append((60, "\n".join(edited(rnd, pool[0], 3) for _ in range(3000))))
    rows.append(rows[10])
    rows += [(61 + i, "Share this page\nLast updated: 2024-01-0%d\n" % (i % 9) + ("  " * 200 if i % 7 == 0 else "") + "own line %d of it" % i) for i in range(40)]
    rows += [(None, pool[1]), (None, pool[2] + "\n" + pool[1])]
    return rows


def order(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def plain(rows, tau=L.TAU):
    lines = {(d, k, x.strip(" \t\n\v\f\r")) for d, t in rows for k, x in enumerate((t or "").split("\n")) if len(x.strip(" \t\n\v\f\r")) >= L.MIN_CHARS}
    lines = sorted(lines, key=order)
    texts = sorted({x for _, _, x in lines})
    up = {x: x for x in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(texts):
        for y in texts[:i]:
            if min(len(x), len(y)) >= L.MIN_FUZZY and abs(len(x) - len(y)) <= tau and L.within(x, y, tau):
                up[root(x)] = root(y)
    first = {}
    for d, k, x in lines:
        first.setdefault(root(x), (d, k))
    same = {}
    for d, k, x in lines:
        same.setdefault(x, (d, k))
    return sorted(((d, k, same[x] == (d, k)) for d, k, x in lines if first[root(x)] != (d, k)), key=order)


def test_removals_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, len(t or ""), "x", 1, 2, 3, 4, "5", 6, 7, 8, 9) for d, t in rows], SCHEMA)
    want = plain(rows)
    got = sorted(((r.id, r.number, r.near) for r in L.removals(df).collect()), key=order)
    assert got == want
    # keys of over 50 rows go to the grid of blocks
    got = sorted(((r.id, r.number, r.near) for r in L.removals(df, hot_rows=50).collect()), key=order)
    assert got == want
    out = L.dedup(df)
    assert out.schema == df.schema
    gone = {(d, k) for d, k, _ in want}
    expect = []
    for d, t in rows:
        left = t
        if any((d, k) in gone for k in range(len((t or "").split("\n")))):
            left = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
            if not left.strip():
                continue
        expect.append((d, left, len(left or "")))
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_chars) for r in out.collect()))) == sorted(map(repr, expect))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert L.removals(df).collect() == []
    assert L.dedup(df).collect() == []
    assert components(L.near_links(df)).collect() == []
    assert L.dedup(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_signatures_never_exclude_a_near_line():
    rnd = random.Random(8)
    for _ in range(300):
        a = "".join(rnd.choice("abcdefg é") for _ in range(rnd.choice([40, 400, 5000]))).strip()
        b = edited(rnd, a, rnd.randint(0, 2)).replace("\n", "").strip()
        lines = L.Lines(pa.array([a + "\n" + b]), 1)
        if len(lines.n) == 2:
            s = L.Points(lines, np.arange(2)).signature()
            assert L._apart(s[:1], s[1:])[0] <= 2 * L.TAU


def test_lines_match_plain_code():
    rnd = random.Random(3)
    texts = [None, "", "\n", "a\n", "\na", " \n\t", "x" * 5, " " * 300 + "y" + "\t" * 200 + "\n" + " " * 500]
    texts += ["".join(rnd.choice("ab é😀\n\n \t") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    x = L.Lines(pa.array(texts), 1)
    got = [(o, k, x.text(i), n) for i, (o, k, n) in enumerate(zip(x.owner.tolist(), x.number.tolist(), x.n.tolist(), strict=True))]
    want = [(o, k, y.strip(" \t\v\f\r"), len(y.strip(" \t\v\f\r"))) for o, t in enumerate(texts) for k, y in enumerate((t or "").split("\n")) if y.strip(" \t\v\f\r")]
    assert got == want


def test_a_line_in_every_document_and_a_hot_segment(spark):
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    tail = lambda: "".join(rnd.choice("ijklmnop") for _ in range(30))
    rows = [(i, "the same line everywhere\n" + base[:30] + tail() + "\n" + ("" if i else base)) for i in range(400)]
    rows.append((400, edited(rnd, rows[7][1].split("\n")[1], 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, 0, False) for i in range(1, 400)] + [(400, 0, True)]
    for hot in (L.HOT_ROWS, 100):
        assert sorted((r.id, r.number, r.near) for r in L.removals(df, hot_rows=hot).collect()) == want
