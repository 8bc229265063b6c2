import random
import re
from collections import defaultdict

from relata.llm import anchors, suffixes

SCHEMA = "doc_id long, text string, key long, first long, other string"


def corpus(seed=4, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda k: [rnd.choice(vocab) for _ in range(k)]
    passages = [make(k) for k in (49, 50, 51, 70, 200)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b c")]
    for i in range(4, n):
        w = make(rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            a = rnd.randint(0, max(0, len(p) - 50))
            at = rnd.randint(0, len(w))
            w[at:at] = p[a:] if rnd.random() < 0.5 else p[: len(p) - a]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    rows.append((n, " ".join(["Orre"] * 3000)))
    rows.append((n + 1, " ".join(make(10) + ["Orre"] * 60)))
    rows += [(n + 2 + j, rows[10][1]) for j in range(5)] + [rows[11]]
    return rows


def plain(rows, t):
    """Words of passages that stand at two places, and the classes of documents that share one."""
    seen = defaultdict(set)
    docs = {d: re.findall(r"[^\x20\x09-\x0D]+", x or "") for d, x in rows}
    for d, w in docs.items():
        for i in range(len(w) - t + 1):
            seen[tuple(w[i : i + t])].add((d, i))
    up = {d: d for d in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    out = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d] |= set(range(i, i + t))
                a, b = root(d), root(min(places)[0])
                up[max(a, b)] = min(a, b)
    return {d: (hit, root(d)) for d, hit in out.items()}


def found(df):
    out = {}
    for r in anchors.merged(suffixes.repeats(df), "doc_id").collect():
        hit = {i for s in r.spans for i in range(s["first"], s["last"])}
        assert r.n_repeated == len(hit)
        out[r.doc_id] = (hit, r.component_id)
    return out


def test_repeats_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)
    assert found(df) == plain(rows, suffixes.MIN_WORDS)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert anchors.merged(suffixes.repeats(df), "doc_id").collect() == []


def test_without_broadcast(spark, monkeypatch):
    from relata.llm import passages

    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in corpus(n=30)], SCHEMA)
    for f in (suffixes.repeats, passages.repeats):
        want = sorted(map(tuple, anchors.merged(f(df), "doc_id").collect()))
        with monkeypatch.context() as m:
            m.setattr(anchors, "BROADCAST_KEYS", 0)
            assert sorted(map(tuple, anchors.merged(f(df), "doc_id").collect())) == want


def test_repeat_behind_nearer_neighbours(spark):
    """A and B share 68 words around a frequent passage; others with a longer side stand between them in each order."""
    rnd = random.Random(10)  # one of the seeds that put more than four rows between A and B at every anchor
    make = lambda k: [f"v{rnd.randrange(10**6)}" for _ in range(k)]
    left, mid, right = make(19), make(30), make(19)
    rows = [(0, make(60) + left + mid + right + make(60)), (1, make(60) + left + mid + right + make(60))]
    for j in range(400):
        # 30 frequent words and 19 more on one side only: fewer than 50
        rows.append((2 + j, make(60) + (left if j % 2 else make(19)) + mid + (make(19) if j % 2 else right) + make(60)))
    rows = [(d, " ".join(w)) for d, w in rows]
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)
    got = found(df)
    assert got == plain(rows, suffixes.MIN_WORDS) and set(got) == {0, 1}


def test_spans_are_exact(spark):
    for seed in (4, 5):
        rows = corpus(seed, 120)
        df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)
        assert found(df) == plain(rows, suffixes.MIN_WORDS)


def test_long_runs_and_small_batches(spark):
    """Two documents of equal paragraphs: every word repeats, whatever the size of an Arrow batch."""
    paragraph = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(d, "\n".join([paragraph] * 100)) for d in (0, 1)], "doc_id long, text string")
    for batch in ("10000", "20"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = sorted(map(tuple, anchors.merged(suffixes.repeats(df), "doc_id").select("doc_id", "n_repeated", "component_id").collect()))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert got == [(0, 6000, 0), (1, 6000, 0)]
    text = "\n".join([paragraph] * 25_000)
    df = spark.createDataFrame([(d, text) for d in (0, 1)], "doc_id long, text string")
    got = sorted(map(tuple, anchors.merged(suffixes.repeats(df), "doc_id").select("doc_id", "n_repeated", "component_id").collect()))
    assert got == [(0, 1_500_000, 0), (1, 1_500_000, 0)]


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    assert found(df) == {}
    assert found(df.unionByName(spark.createDataFrame([(2, text + " " + text)], df.schema))) == {1: (set(range(60)), 1), 2: (set(range(120)), 1)}
