import math
import os
import random
import re

import pytest

from relata.llm import decontaminate as D
from relata.llm import language as L
from relata.llm import tokens as K

SCHEMA = "doc_id long, text string, lang string, source string, score double, n_words long, item_id long, __text string, __id long, row long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 0.5, 1, 2, "u", 3, 4) for d, t, lang in rows], SCHEMA)


# --- decontamination -------------------------------------------------------------------------


def contaminated(doc, item, window=D.WINDOW, share=D.SIMILARITY):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    a, b = ((t or "").translate(low).split() for t in (doc, item))
    if len(b) < D.MIN_WORDS:
        return False
    n = min(window, len(b))
    for at in range(-len(b) + 1, len(a)):
        eq = [0 <= at + i < len(a) and a[at + i] == w for i, w in enumerate(b)]
        if any(sum(eq[i : i + n]) >= math.ceil(share * n - 1e-9) for i in range(len(b) - n + 1)):
            return True
    return False


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(200)]
    make = lambda k: [rnd.choice(vocab) for _ in range(k)]
    items = [make(k) for k in (2, 3, 4, 5, 6, 9, 10, 20, 40, 60)]
    rows = [(0, None), (1, ""), (2, " \n")]
    for i in range(3, 160):
        w = make(rnd.randint(0, 80))
        if rnd.random() < 0.7:
            p = list(rnd.choice(items))
            p = p[: rnd.choice([len(p), max(1, len(p) // 2)])]
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                p[rnd.randrange(len(p))] = "X"
            at = rnd.randint(0, len(w))
            w[at:at] = p
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else "\n".join(w)))
    rows += [rows[9], (160, " ".join(items[8] * 300))]
    df = frame(spark, [(d, t, "en") for d, t in rows])
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (7, " ".join(items[7]))], "item_id long, text string")
    for words in (D.BLOCK_WORDS, 30):
        got = {(r.doc_id, r.item_id) for r in D.find(df, bench, block_words=words).collect()}
        want = {(d, i) for d, t in rows for i, x in enumerate(items) if contaminated(t, " ".join(x))}
        assert got <= want
        # seeds may miss matches with many substitutions; with at most one in ten they find all
        sure = {(d, i) for d, t in rows for i, x in enumerate(items) if contaminated(t, " ".join(x), share=0.9)}
        assert sure <= got and len(got) >= 0.95 * len(want)
        kept = D.clean(df, bench, block_words=words)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert D.find(df.where("false"), bench).collect() == [] and D.find(df, bench.where("false")).collect() == []


# --- language --------------------------------------------------------------------------------


def plain_bits(train, text, order=L.ORDER):
    """PPM with escapes, straight from the counts."""
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
    counts = {}
    for t in train:
        b = b"\n" * order + low(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                c = counts.setdefault(b[i - k : i], {})
                c[b[i]] = c.get(b[i], 0) + 1
    total = 0.0
    b = b"\n" * order + low(text)
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts.get(b[i - k : i])
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if b[i] in c:
                total += math.log2((n + q) / c[b[i]])
                break
            total += math.log2((n + q) / q)
        else:
            total += 8.0
    return total


def test_code_lengths_match_the_definition():
    train = {"a": ["the cat and the dog", "thé end"], "b": ["der hund und die katze", "das ende"]}
    model = L.Model(train)
    texts = ["the dog", "Der Hund", "", "zzz é 漢字 \x00", "the und thé", "katze " * 50]
    bits = model.bits(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert math.isclose(bits[i, j], plain_bits(train[lang], t), rel_tol=1e-5, abs_tol=1e-4), (t, lang)


def test_tables_of_many_languages():
    """Code lengths don't depend on how languages share tables, whose size grows with their number alone."""
    rnd = random.Random(3)
    train = {}
    for k in range(100):
        word = lambda: "".join(chr(0x4E00 + 60 * k + rnd.randrange(40)) for _ in range(rnd.randint(2, 8)))
        vocab = [word() for _ in range(200)]
        train["l%03d" % k] = [" ".join(rnd.choice(vocab) for _ in range(60)) for _ in range(10)]
    few = {k: train[k] for k in list(train)[:6]}
    texts = [v[0] for v in few.values()] + [None, "", "abc", "l \n"]
    whole, split = L.Model(few, cells=1 << 30), L.Model(few, cells=1)
    assert len(whole.tables) == 1 and len(split.tables) == 6
    assert abs(whole.bits(texts) - split.bits(texts)).max() < 1e-3
    size = lambda m: sum(t.cost.nbytes + t.state.nbytes for _, _, t in m.tables)
    half = L.Model({k: v for k, v in train.items() if k < "l050"}, cells=1 << 18)
    every = L.Model(train, cells=1 << 18)
    assert size(every) < 2.5 * size(half) < 200e6
    assert every.predict([v[1] for v in train.values()])[0] == list(train)


def test_a_language_of_long_texts_only(spark):
    rows = [(i, "the house and the end of it " * 3, "en") for i in range(40)]
    rows += [(40 + i, "der hund und die katze von hier " * 2000, "de") for i in range(40)]
    df = frame(spark, rows)
    model = L.train(df)
    assert model.languages == ["de", "en"] and model.predict(["die katze", "the end"])[0] == ["de", "en"]


def test_language_operator(spark):
    rnd = random.Random(4)
    words = {"en": "the of and house with from".split(), "de": "der und das haus mit von über".split()}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(20)), k) for i in range(300) for k in [rnd.choice(["en", "de"])]]
    rows += [(300, None, "en"), (301, "", None), (302, "123 !?", "en"), (303, "the house", None), (303, "the house", None), (304, "der und " * 20_000, "de")]
    df = frame(spark, rows)
    got = L.predict(df, L.train(df)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (300, 301, 302, 303, 304)] == ["und", "und", "und", "en", "de"]
    assert all(by[d] == lang for d, _, lang in rows[:300])
    assert L.predict(df.where("false"), L.train(df)).collect() == []
    assert {r.lang_pred for r in L.predict(df, L.train(df.where("false"))).collect()} == {"und"}


FIXTURE = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(FIXTURE), reason="no fixture")
def test_held_out_accuracy(spark):
    df = spark.read.parquet(FIXTURE)
    out = L.predict(df, L.train(df)).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.99 * out.count()


# --- tokens ----------------------------------------------------------------------------------


def plain_count(word, pieces, byte):
    w = K.MARK + word
    best = [(0.0, 0)] + [None] * len(w)
    for i in range(1, len(w) + 1):
        options = [(-(best[j][0] + pieces[w[j:i]]), best[j][1] + 1) for j in range(i) if w[j:i] in pieces]
        if w[i - 1] not in pieces:
            spelt = w[i - 1].encode()
            options.append((-(best[i - 1][0] + sum(byte[b] for b in spelt)), best[i - 1][1] + len(spelt)))
        s, n = min(options)
        best[i] = (-s, n)
    return best[-1][1]


def test_counts_match_a_plain_forward_pass(spark, monkeypatch):
    pieces, byte = K.load_pieces(K.default_model())
    texts = [None, "", " \n", "Hello world", "naïve café 漢字 😀\x00", "the " * 500, "internationalisation" * 40, "a\tb\x0bc d"]
    rows = list(enumerate(texts)) + [(3, "Hello world")]
    want = sorted((d, len(w), sum(plain_count(x, pieces, byte) for x in w)) for d, t in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")])
    df = frame(spark, [(d, t, "en") for d, t in rows])
    assert sorted(map(tuple, K.count(df).collect())) == want
    assert K.count(df.where("false")).collect() == []
    # long words go on beyond the trie
    rnd = random.Random(11)
    trie = K.Trie(pieces, byte)
    for size in (63, 64, 65, 66, 200, 900):
        word = "".join(rnd.choice(["the", "ing", "a", "é", "漢", "zq"]) for _ in range(size))[:size]
        assert trie.add(K.MARK + word) == plain_count(word, pieces, byte)
    assert len(trie.score) <= 6 * K.MAX_DEPTH + 1
    # a trie that is begun anew at each word counts the same
    trie = K.Trie(pieces, byte)
    counts = K.Counts(trie)
    monkeypatch.setattr(K, "MAX_NODES", 1)
    assert [counts[w] for w in ("Hello", "world", "café")] == [plain_count(w, pieces, byte) for w in ("Hello", "world", "café")]


def test_counts_are_near_those_of_the_tokenizer_itself():
    import sentencepiece

    pieces, byte = K.load_pieces(K.default_model())
    model = sentencepiece.SentencePieceProcessor(model_file=K.default_model())
    text = "The quick brown fox jumps over the lazy dog while seventeen engineers measure the performance of distributed query engines."
    mine = sum(K.Trie(pieces, byte).add(K.MARK + w) for w in text.split())
    assert abs(mine - len(model.encode(text))) <= 3
