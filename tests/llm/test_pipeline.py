import random

import corpus_pipeline
from relata.llm import mixing


def test_pipeline(spark, tmp_path):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(4000)]
    prose = lambda n: "\n".join(" ".join(rnd.choice(vocab) for _ in range(20)) for _ in range(n))
    item = " ".join(rnd.choice(vocab) for _ in range(30))
    rows = [(i, prose(6)) for i in range(60)]
    shared = " ".join(rnd.choice(vocab) for _ in range(12))
    rows += [(100 + i, prose(6) + "\n" + shared + ("x" if i % 2 else "")) for i in range(6)]  # near-equal lines
    near = prose(1).split()
    near = [*near, *prose(8).split()]
    for i in range(3):  # one long line with other words: no near-equal line, but a near copy
        w = list(near)
        for at in (20 + i, 90 + i):
            w[at] = f"other{i}word{at}"
        rows.append((200 + i, " ".join(w)))
    rows.append((300, prose(3) + "\n" + prose(1) + " " + item + "\n" + prose(2)))  # holds a test item
    rows += [(400, None), (401, ""), (402, "too short"), (403, "again and again " * 60)]
    copy = prose(7)
    rows += [(500, copy), (501, copy), (502, copy)]  # all lines go but for the first document's
    docs = spark.createDataFrame([(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        kept[name] = {r.doc_id: r for r in at.collect()}
        assert at.schema == docs.schema
    ids = {d for d, _ in rows}
    assert set(kept["quality_rules"]) == ids - {400, 401, 402, 403}
    assert set(kept["line_dedup"]) == set(kept["quality_rules"]) - {501, 502}
    lines = kept["line_dedup"]
    assert shared in lines[100].text and all(shared not in lines[100 + i].text for i in range(1, 6))
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert set(kept["near_duplicates"]) == set(lines) - {201, 202}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {300}
    want = {}
    for r in mixing.rated(at).select("row.doc_id", "copies").collect():
        want[r.doc_id] = r.copies
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    assert all(n <= 3 for n in got.values())
