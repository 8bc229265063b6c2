import numpy as np

from relata.functions import vectors as V
from relata.operators import chunking, cluster, embed, mentions
from relata.operators import graph as G
from relata.operators import similarity as S
from relata.sources import index


def test_fences():
    assert [chunking.fence(x) for x in ("```py", "   ~~~~", "    ```", "``", "``` a ` b", "~~~ `x`", "text", "")] == ["```", "~~~~", "", "", "", "~~~", "", ""]
    assert chunking.closes("````", "```") and not chunking.closes("```", "````")
    assert not chunking.closes("~~~", "```") and not chunking.closes("``` x", "```")
    text = "# a\n```\n# no\n~~~\n# no\n```\n# b"
    assert [c for c, _ in chunking.sections(text)] == [["a"], ["b"]]
    assert mentions.skip_spans("x\n~~~\n```\ny\n~~~\nz")[0] == (2, 15)


def test_map_of_few_or_odd_vectors(spark):
    schema = "vec_id long, vec array<double>"
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert cluster.corpus_map(two).collect() == []
    assert cluster.corpus_map(two.where("false")).collect() == []
    assert cluster.kmeans(two.where("false"), 3)[0].collect() == []
    rng = np.random.default_rng(3)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))] + [(99, [1.0]), (98, None), (97, [])]
    got = cluster.corpus_map(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.vec_id for r in got) == list(range(40))
    assert all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in got)
    sizes = {r.cluster: r["size"] for r in got}
    assert all(n == sum(r.cluster == c for r in got) and n > 0 for c, n in sizes.items())


def test_top_k_leaves_pairs_out(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, vec array<double>")
    no = [(0, i) for i in range(1, 45)] + [(1, 2), (2, 1)]
    without = spark.createDataFrame(no, "src long, dst long")
    got = {}
    for r in S.top_k(df, df, 4, block=16, without=without).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    score = np.round(m @ m.T, 12)
    for i in range(50):
        left = sorted((-score[i, j], j) for j in range(50) if j != i and (i, j) not in no)[:4]
        assert [d for _, d in sorted(got[i])] == [j for _, j in left]


def test_pooling_and_whole_notes(spark):
    rows = [(1, 0, 0, [3.0, 0.0]), (1, 1, 0, [0.0, 1.0]), (1, 2, 1, [0.0, 2.0]), (2, 0, 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "note_id long, chunk_ix int, idea_id int, vec array<double>")
    last = {r.note_id: r.vec for r in embed.pool(df, "last").collect()}
    assert last == {1: [0.0, 1.0], 2: [0.0, 0.0]}
    mean = {r.note_id: r.vec for r in embed.pool(df, "mean").collect()}
    assert np.allclose(mean[1], np.array([1.0, 1.0]) / np.sqrt(2))
    assert sorted((r.note_id, r.granularity, r.idea) for r in embed.whole_notes(df).collect()) == [(1, "idea", 0), (1, "idea", 1), (1, "note", -1), (2, "idea", 0), (2, "note", -1)]
    assert {r.granularity for r in embed.whole_notes(df, "e5").collect()} == {"note"}


def test_surfaces_of_any_length(spark):
    long = "one two three four five six seven eight nine"
    names = spark.createDataFrame([(7, long, "title"), (8, "ab cd", "title")], "note_id long, name string, kind string")
    resolved = mentions.resolve(mentions.surfaces(names), names.selectExpr("note_id", "name as path"))
    notes = spark.createDataFrame([(1, f"here {long} and ab cd. ab cd"), (8, "ab cd")], "note_id long, body string")
    got = sorted((r.note_id, r.target, r["from"]) for r in mentions.detect(notes, resolved).collect())
    assert got == [(1, 7, 5), (1, 8, 5 + len(long) + 5)]


def test_base64_of_long_rows(spark):
    df = spark.createDataFrame([([-127, 0, 127] * 100,), ([],)], "q array<tinyint>")
    for r in df.select("q", index.to_base64(df.q).alias("s"), index.from_base64(index.to_base64(df.q)).alias("back")).collect():
        assert r.back == r.q and "\n" not in r.s


def test_bounded_variants_of_unbounded_signals(spark):
    hub = [(0, i) for i in range(1, 60)] + [(1, 2), (2, 3)]
    adj = G.adjacency(spark.createDataFrame(hub, "src long, dst long"))
    assert G.common_neighbours(adj).count() > 1700
    assert G.common_neighbours(adj, 40).count() <= 4
    assert V.dims(spark.createDataFrame([([1.0],)], "vec array<double>"), []).count() == 1
