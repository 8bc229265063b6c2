import random
import re

import numpy as np
import xxhash

from relata.llm import simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, fp string, label long"


def plain_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    fp = [plain_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{fp[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(n=240):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a  b"), (7, "a b"), (7, "a b")]
    base = []
    for i in range(8, n):
        if base and rnd.random() < 0.5:
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 400]))]
            base.append(w)
        rows.append((i, (" " if i % 3 else "\n").join(w)))
    rows.append((n, " ".join(rnd.choice(vocab) for _ in range(40_000))))
    return rows


def test_groups_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "s", "x", 1) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.groups(df).collect())
    assert got == plain_groups(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(df).collect() == []
    assert simhash.dedup(df).collect() == []


def test_links_are_complete_over_many_shards(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2)
    pts = set(map(int, base))
    for b in base[:60]:
        for _ in range(20):
            x = int(b)
            for bit in rng.integers(0, 64, 3):
                x ^= 1 << int(bit)
            pts.add(x)
    for bits in range(200):  # the same lower half
        pts.add((bits * 2654435761 << 32) & (1 << 64) - 1)
    pts = sorted(pts)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in pts], "fp long")
    from relata.llm.common import components

    got = {r.node: r.label for r in components(simhash.links(df, 3, leaf=16)).collect()}
    up = {x: x for x in pts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(pts):
        for y in pts[:i]:
            if (x ^ y).bit_count() <= 3:
                up[root(x)] = root(y)
    s = lambda x: x - (1 << 64) if x >> 63 else x
    want, mine = {}, {}
    for x in pts:
        want.setdefault(root(x), set()).add(x)
        mine.setdefault(got.get(s(x), s(x)), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def plain_sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_copies(rnd, n, lo, hi):
    """Pairs of texts whose shingle sets have a similarity in [lo, hi)."""
    out = []
    while len(out) < n:
        a = [f"v{rnd.randrange(10**9)}" for _ in range(300)]
        b = list(a)
        for _ in range(rnd.randint(1, 12)):
            b[rnd.randrange(300)] = f"x{rnd.randrange(10**9)}"
        x, y = plain_sets(" ".join(a)), plain_sets(" ".join(b))
        if lo <= len(x & y) / len(x | y) < hi:
            out.append((" ".join(a), " ".join(b)))
    return out


def test_dedup_of_similar_texts(spark):
    rnd = random.Random(12)
    rows, kinds = [], (("least", 0.8, 0.84, 150, 0.85), ("more", 0.84, 0.95, 150, 0.97), ("not", 0.55, 0.78, 100, 0.0))
    for name, lo, hi, n, _ in kinds:
        for a, b in near_copies(rnd, n, lo, hi):
            rows += [(len(rows), a, name), (len(rows) + 1, b, name)]
    schema = "doc_id long, text string, source string, row long, key long, id long, node long, __keep long"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema)
    kept = simhash.dedup(df)
    assert kept.schema == df.schema
    left = {r.doc_id for r in kept.collect()}
    for name, _, _, n, least in kinds:
        gone = sum(s == name and d not in left for d, _, s in rows)
        assert gone == 0 if name == "not" else gone >= least * n, (name, gone)
    assert all(d in left for d, _, _ in rows if d % 2 == 0)


def test_dedup_keeps_one_of_each_group(spark):
    rnd = random.Random(13)
    base = [f"v{rnd.randrange(10**9)}" for _ in range(200)]
    rows = [(10 + i, " ".join(base[: 1 + i % 2] + base[1 + i % 2 :])) for i in range(200)]  # copies
    for i in range(60):  # near copies, each with another word
        b = list(base)
        b[rnd.randrange(200)] = f"x{i}"
        rows.append((300 + i, " ".join(b)))
    rows += [(1, None), (2, ""), (3, " \t"), (5, "One two"), (6, "one  TWO"), (7, "three"), (7, "three"), (8, "four words are here"), (8, "and five other words here")]
    rows += [(None, "a null id"), (None, "a null id"), (9, "a null id"), (400, " ".join(rnd.choice(base) for _ in range(50_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, (r.text or "")[:9]) for r in simhash.dedup(df).collect()), key=str)
    want = [(10, " ".join(base)[:9]), (1, ""), (5, "One two"), (7, "three"), (8, "four word"), (8, "and five "), (None, "a null id"), (400, rows[-1][1][:9])]
    assert left == sorted(want, key=str)


def test_similar_links_over_many_shards(spark, monkeypatch):
    rnd = random.Random(14)
    rows = [(i, t) for i, t in enumerate(t for pair in near_copies(rnd, 150, 0.85, 0.95) for t in pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id for r in simhash.dedup(df).collect()}
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (8,))
    assert {r.doc_id for r in simhash.dedup(df).collect()} == one and len(one) <= 155
