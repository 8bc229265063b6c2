from pyspark.sql import functions as F

from relata.functions import text as T
from relata.operators import chunking, insights, mentions
from relata.sources import index, markdown
from relata.streaming import feed


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "x string").select(*cols).first()


def test_variants(spark):
    rows = [("category", "categories"), ("categories", "category"), ("boxes", "box"), ("box", None), ("bus", None), ("class", "classes"), ("embeddings", "embedding"), ("embedding", "embeddings"), ("dish", "dishes")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "w string").select("w", T.variant("w").alias("v"))
    assert {r.w: r.v for r in df.collect()} == dict(rows)


def test_text_functions(spark):
    r = one(spark, "# Head\nSee [[Note|the note]] and `code` **bold** <b>x</b>\n```\nhidden\n```", T.strip_markdown("x").alias("a"))
    assert r.a == "Head See the note and bold x"
    assert one(spark, " Ä  Ö ", T.normalize("x").alias("a")).a == "ä ö"
    assert one(spark, "Größe  Ä", T.fold("x").alias("a")).a == "groesse ae"
    assert one(spark, 'Is it?"', T.is_question("x").alias("a")).a == "qmark"


def test_sections_and_windows():
    text = "---\ntags: a\n---\nintro\n# One *x*\nbody\n```\n# not a heading\n```\n## Two\nmore\n# Three\nend"
    assert [c for c, _ in chunking.sections(text)] == [[], ["One x"], ["One x", "Two"], ["Three"]]
    s = [" ".join([f"w{i}"] * 30) + "." for i in range(7)]
    w = chunking.windows(s)
    assert all(any(x in y for y in w) for x in s) and w[1].startswith(s[2])
    assert all(len(p) <= 480 for p in chunking.to_budget("word " * 400)) and chunking.to_budget("") == []
    chunks = chunking.chunk_text("T", "\n\n".join(" ".join(s) for _ in range(4)))
    assert chunks[0] == (0, 0, "T") and [c[0] for c in chunks] == list(range(len(chunks)))
    ids = [c[1] for c in chunks[1:]]
    assert ids[0] == 1 and all(0 <= b - a <= 1 for a, b in zip(ids, ids[1:], strict=False))


def test_mentions(spark):
    notes = spark.createDataFrame([(1, "Alpha", "# Alpha Beta\nAn Alpha Beta and `Alpha Beta` [[Alpha Beta]] alpha  beta.\n```\nAlpha Beta"), (2, "Alpha Beta", "x"), (3, "Gamma", "gammas and Gamma; Twin"), (4, "Twin", ""), (5, "Twin", None)], "note_id long, title string, body string")
    names = notes.select("note_id", F.col("title").alias("name"), F.lit("title").alias("kind"))
    resolved = mentions.resolve(mentions.surfaces(names), notes.select("note_id", F.col("title").alias("path")))
    found = mentions.detect(notes, resolved)
    assert [(r.note_id, r.target, r.surface) for r in found.collect()] == [(1, 2, "alpha beta")]
    assert mentions.detect(notes, resolved, every=True).count() == 2
    out = {r.note_id: (r.body, r.links) for r in mentions.rewrite(notes, found, notes).collect()}
    assert out[1][1] == 1 and "An [[Alpha Beta]] and" in out[1][0] and out[3][1] == 0


def test_skip_spans_of_an_open_fence():
    doc = "a `b` c\n```\nrest"
    assert mentions.skip_spans(doc)[-1] == (8, len(doc))


def test_template_groups(spark):
    rows = [(n, h) for n in range(5) for h in ("A", "B")] + [(9, "A"), (10, "X"), (10, "Y"), (11, "X"), (11, "Y")]
    g = insights.template_groups(spark.createDataFrame(rows, "note_id long, heading string"))
    assert sorted((r.note_id, r.grp, r.size) for r in g.collect()) == [(n, 0, 5) for n in range(5)]
    assert insights.template_groups(spark.createDataFrame(rows, "note_id long, heading string"), ceiling=4).count() == 0


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A.md").write_text("---\ntags: [x, y]\naliases:\n  - One\n  - Two\n---\nsee [[B|bee]] and [[Nowhere]] [[b#part]]")
    (tmp_path / "sub" / "B.md").write_text("no links")
    (tmp_path / "c.txt").write_text("[[A]]")
    notes = markdown.read(spark, str(tmp_path))
    assert sorted(r.title for r in notes.collect()) == ["A", "B"]
    links = markdown.resolved_links(notes).collect()
    assert len(links) == 1 and links[0].n == 2
    assert [r.target for r in markdown.ghost_links(notes).collect()] == ["Nowhere"]
    front = markdown.front_matter(F.col("body"))
    r = notes.where("title = 'A'").select(markdown.field_list(front, "tags").alias("t"), markdown.field_list(front, "aliases").alias("a"), markdown.without_front_matter(F.col("body")).alias("b")).first()
    assert (r.t, r.a) == (["x", "y"], ["One", "Two"]) and r.b.startswith("see")


def test_index_round_trip(spark, tmp_path):
    rows = [(n, c, 1, "2024-01-01", [float((n + c + i) % 5 - 2) for i in range(4)]) for n in range(3) for c in range(2)]
    df = spark.createDataFrame(rows, "note_id long, chunk_ix int, idea_id int, mtime string, vec array<double>")
    index.write(df, str(tmp_path), "m", 4)
    means, chunks = index.read(spark, str(tmp_path), "m")
    assert means.count() == 3 and chunks.count() == 6 and index.read(spark, str(tmp_path), "other") is None
    q = spark.createDataFrame([([-128, -1, 0, 127],)], "q array<tinyint>")
    r = q.select(index.to_base64(F.col("q")).alias("t")).select("t", index.from_base64(F.col("t")).alias("b")).first()
    assert (r.t, r.b) == ("gP8Afw==", [-128, -1, 0, 127])


def test_change_feed(spark, tmp_path):
    ev = [(0, "a", "create", None), (5, "b", "create", None), (60, "b", "rename", "a"), (61, "c", "create", None), (62, "c", "delete", None)]
    df = spark.createDataFrame([(1_700_000_000 + t, p, o, q) for t, p, o, q in ev], "s long, path string, op string, old_path string").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.events for r in feed.sessions(df).collect()) == [2, 3]
    state = feed.apply_changes(spark.createDataFrame([], "path string, ts timestamp"), df)
    assert [r.path for r in state.collect()] == ["b"]
    df.select("ts", "path").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string").parquet(str(tmp_path / "in"))
    q = feed.run_feed(stream, str(tmp_path), "out", late="1 second")
    q.awaitTermination()
    q = feed.run_feed(stream, str(tmp_path), "out", late="1 second")
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.events, sorted(r.paths)) for r in out] == [(2, ["a", "b"])]
