import hashlib
import math
import re

from relata.llm import mixing, secrets

SCHEMA = "doc_id long, text string, source string, size long, hash string, row long, target double, mix_copy int, mix_copy_ int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "h", 2, 0.5, 3, 4) for d, t, s in rows], SCHEMA)


def plain_targets(sizes):
    """Iterative resharing, as the operator's contract words it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    got, open_, left = dict.fromkeys(order, 0.0), list(order), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += left * weight[s] / total
        left = sum(max(0.0, got[s] - 2 * sizes[s]) for s in open_)
        full = [s for s in open_ if got[s] >= 2 * sizes[s]]
        for s in full:
            got[s] = 2.0 * sizes[s]
        open_ = [s for s in open_ if s not in full]
    return got


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{i % 5}" if i % 5 else "é") for i in range(400)]
    rows += [(400, None, "s1"), (401, "", None), (402, "a b c", None), (403, "x", "\U0001f600"), (403, "x", "\U0001f600"), (404, "y " * 30000, "s2"), (405, " ", "empty")]
    df = frame(spark, rows)
    out = mixing.rated(df).select("row.doc_id", "size", "source_size", "target", "copies").collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(size)
    by_id = {d: (s, len(WORD.findall(t or ""))) for d, t, s in rows}
    assert len(out) == len(rows)
    for r in out:
        s, n = by_id[r.doc_id]
        assert (r.size, r.source_size) == (n, size[s])
        assert math.isclose(r.target, want[s], abs_tol=1e-6)
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.floor(rate) + 1 <= 3
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "mix_copy__"]
    assert mixed.count() == sum(r.copies for r in out)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, mixed.collect()))


def test_mixing_salted(spark, monkeypatch):
    df = frame(spark, [(i, "a b", None if i % 3 else "s") for i in range(60)])
    key = ("row.doc_id", "size", "target", "copies")
    want = sorted(map(str, mixing.rated(df).select(*key).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.rated(df).select(*key).collect())) == want


def test_empty(spark):
    df = frame(spark, [])
    assert mixing.rated(df).collect() == [] and mixing.mix(df).collect() == []
    assert secrets.find(df).collect() == []


def plain_spans(text):
    out = []
    for k, (_, p, g, least) in enumerate((*secrets.BASE, *secrets.ADDED)):
        # the base kinds in the words of their contract
        p = {1: r"AKIA[A-Z0-9]+", 2: r"[0-9a-f]+"}.get(k, p)
        out += [(m.start(), k, m.end(), m.group(g)) for m in re.finditer(p, text or "") if len(m.group(g)) >= least]
    return sorted(out)


def test_secrets(spark):
    ghp = "ghp_" + "a1B2" * 6
    rows = [
        (0, None, "a"), (1, "", None), (2, "plain text", "a"),
        (3, "é😀 PassWord = 'hunter22' and token:abc AKIA" + "Z" * 16 + "AKIAAKIA" + "Q" * 9, "a"),
        (4, "secret: password: abcdefg secret:token:abcdefgh ſecret=abcdefgh toKen=abcdefgh", "b"),
        (5, "x" + "0123456789abcdef" * 2 + "G deadbeef api_key=" + "f" * 24, "b"),
        (6, ghp, "a"), (7, ghp, "b"), (8, ghp, "c"), (9, "key " + ghp[:-1] + "X", None), (9, "key " + ghp[:-1] + "X", None),
        (10, ("token=abcdef1 " * 300) + "b" * 100_000, "d"),
        (11, 'apikey"\x20: "AAAAAA" api-key=AAAAAAA passwd==aaaaaa', "d"),
    ]
    got = sorted((r.doc_id, r.spans) for r in secrets.find(frame(spark, rows)).collect())
    assert len(got) == len(rows)
    owners = {}
    for _, t, s in rows:
        for *_, v in plain_spans(t):
            owners.setdefault(v, set()).add(s)
    for (d, spans), (_, t, _s) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        want = [(a, k, b, v) for a, k, b, v in plain_spans(t) if k < 3 or len(owners[v]) < 3]
        assert [(x.start, x.kind, x.end, x.hash) for x in spans] == [(a, k, b, hashlib.sha256(v.encode()).hexdigest()) for a, k, b, v in want], d
        assert [x.owners for x in spans] == [len(owners[v]) for *_, v in want]
