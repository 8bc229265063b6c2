"""Text and mining queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relata.functions import text as T

from . import relations as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def docs(spark, sf):
    return R.table(spark, sf, "documents")


def words(spark, sf):
    """Distinct lower-case words of the benchmark items."""
    b = R.table(spark, sf, "benchmark")
    return b.select(F.explode(F.split(F.lower("text"), "[^a-zäöüßéèêçñáíóú]+")).alias("word")).where("word <> ''").distinct()


_WORDS = "w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-zäöüßéèêçñáíóú]+')) AS word FROM benchmark)"
_SQ = r"trim(regexp_replace({}, '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_FOLD = _SQ.format("replace(replace(replace(replace(lower({}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')")


@query("t1_normalize", "SELECT p_partkey, " + _SQ.format("lower(nfc_normalize('  ' || p_name))") + " AS surface FROM part")
def normalize(spark, sf):
    return R.table(spark, sf, "part").select("p_partkey", T.normalize(F.concat(F.lit("  "), "p_name")).alias("surface"))


@query("t2_fold", "SELECT doc_id, md5(" + _FOLD.replace("{}", "text") + ") AS folded FROM documents")
def fold(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.fold("text").cast("binary")).alias("folded"))


@query("t3_variants", f"""WITH {_WORDS} SELECT word, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, length(word) - 1) || 'ies' WHEN regexp_matches(word, 'ies$') THEN left(word, length(word) - 3) || 'y'
WHEN regexp_matches(word, '(ss|x|z|ch|sh)es$') THEN left(word, length(word) - 2) WHEN regexp_matches(word, '(ss|us|is)$') THEN word || 'es' WHEN regexp_matches(word, 's$') THEN left(word, length(word) - 1)
WHEN regexp_matches(word, '(x|z|ch|sh)$') THEN word || 'es' ELSE word || 's' END AS variant FROM w WHERE length(word) >= 4""")
def variants(spark, sf):
    return words(spark, sf).withColumn("variant", T.variant("word")).where("variant is not null")


@query("t4_stem", f"WITH {_WORDS} SELECT word, CASE WHEN regexp_matches(word, '^.{{4,}}(en|er|es|em)$') THEN left(word, length(word) - 2) WHEN regexp_matches(word, '^.{{4,}}(e|n|s)$') THEN left(word, length(word) - 1) ELSE word END AS stem FROM w WHERE word <> ''")
def stem(spark, sf):
    return words(spark, sf).withColumn("stem", T.stem("word"))


@query("t5_strip_html", "SELECT page_id, md5(" + _SQ.format(r"regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')") + ") AS stripped FROM pages")
def strip_html(spark, sf):
    return R.table(spark, sf, "pages").select("page_id", F.md5(T.strip_html("html").cast("binary")).alias("stripped"))


def _plain(text: str) -> str:
    """SQL of the plain text of Markdown."""
    out = text
    for pattern, by in T.MARKDOWN:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return _SQ.format(out)


@query("t5_strip_markdown", f"SELECT doc_id, length({_plain('text')})::INT AS n_plain FROM documents")
def strip_markdown(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(T.strip_markdown("text")).alias("n_plain"))


@query("t6_sentences", r"""SELECT doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r\f\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 0)) AS n_sentences FROM documents""")
def sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.sentences("text")).cast("long").alias("n_sentences"))


@query("t7_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')) AS n_words FROM documents")
def word_count(spark, sf):
    return docs(spark, sf).select("doc_id", T.count_words("text").cast("long").alias("n_words"))


_TOK = "list_filter(regexp_split_to_array(" + _FOLD.replace("{}", "text") + ", '[^a-z0-9]+'), lambda x: length(x) >= 3)"


@query("t8_tokenise", f"SELECT item_id, array_to_string({_TOK}, ' ') AS tokens FROM benchmark")
def tokenise(spark, sf):
    return R.table(spark, sf, "benchmark").select("item_id", F.array_join(T.tokens("text"), " ").alias("tokens"))


@query("t9_snippet", f"SELECT doc_id, left({_plain('text')}, 160) AS snippet FROM documents")
def snippet(spark, sf):
    return docs(spark, sf).select("doc_id", T.snippet("text").alias("snippet"))


@query("t10_age_label", """WITH s AS (SELECT o_orderkey, (epoch(TIMESTAMP '2030-01-01') - epoch(o_orderdate))::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 0 THEN '' WHEN s < 3600 THEN 'just now' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 2592000 THEN (s // 86400) || 'd' WHEN s < 31536000 THEN (s // 2592000) || 'mo' ELSE (s // 31536000) || 'y' END AS age FROM s""")
def age_label(spark, sf):
    return R.table(spark, sf, "orders").select("o_orderkey", T.age_label("o_orderdate", F.lit("2030-01-01 00:00:00")).alias("age"))


@query("t11_change_hash")
def change_hash(spark, sf):
    return docs(spark, sf).select("doc_id", F.xxhash64("text").alias("hash"))


@query("t12_safe_name", r"""SELECT page_id, trim(regexp_replace(url, '[\\/:*?"<>|#^\[\]]', ' ', 'g')) AS name FROM pages""")
def safe_name(spark, sf):
    return R.table(spark, sf, "pages").select("page_id", T.safe_name("url").alias("name"))


_LIST = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"


@query("t13_language_probe", f"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-zäöüß]+') AS t FROM documents),
n AS (SELECT doc_id, len(list_filter(t, lambda w: list_contains({_LIST(T.GERMAN)}, w))) AS de, len(list_filter(t, lambda w: list_contains({_LIST(T.ENGLISH)}, w))) AS en FROM t)
SELECT doc_id, CASE WHEN de >= 2 * greatest(1, en) THEN 'de' WHEN en >= 2 * greatest(1, de) THEN 'en' ELSE 'mixed' END AS probe FROM n""")
def language_probe(spark, sf):
    return docs(spark, sf).select("doc_id", T.language("text").alias("probe"))


@query("t14_paragraphs", r"""WITH k AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '(?s)```.*?(```|$)', '', 'g'), '\n[ \t]*\n'), lambda p: NOT regexp_matches(p, '^\s*[#|]') AND len(regexp_extract_all(p, '[^ \t\n\r\f\x0b]+')) >= 25) AS ps FROM documents)
SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS ix, length(left(trim(unnest(ps)), 3500))::INT AS n FROM k""")
def paragraphs(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.paragraphs("text")).alias("ix", "paragraph")).select("doc_id", "ix", F.length("paragraph").alias("n"))


@query("t16_first_paragraph", "SELECT doc_id, left(trim(list_filter(string_split(text, chr(10)), lambda p: length(trim(p)) >= 60)[1]), 320) AS lead FROM documents")
def first_paragraph(spark, sf):
    return docs(spark, sf).select("doc_id", T.first_paragraph("text").alias("lead"))


@query("t17_math_share", r"SELECT doc_id, round(len(regexp_extract_all(text, '[=+<>^\\$∑∫√]'))::DOUBLE / greatest(1, length(text)), 6) AS share FROM documents")
def math_share(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(T.math_share("text"), 6).alias("share"))


@query("t18_question", r"""WITH t AS (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(regexp_replace(t, '["''»”)]+$', ''), '[?]$') THEN 'qmark'
WHEN regexp_matches(t, '(wonder|not sure|unclear|frage mich|unsicher)') AND regexp_matches(t, '(what|why|how|when|who|whether|was|warum|wie|wann|wer|ob)') THEN 'uncert' END AS kind FROM t""")
def question(spark, sf):
    return R.table(spark, sf, "conversations").select("conv_id", "turn", T.is_question("text").alias("kind"))


@query("t19_second_person", "SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z])(you|your|yours|du|dich|dir|dein|deine)([^a-z]|$)') AS you FROM conversations")
def second_person(spark, sf):
    return R.table(spark, sf, "conversations").select("conv_id", "turn", T.second_person("text").alias("you"))


@query("t20_jaccard", f"""WITH t AS (SELECT item_id, list_distinct({_TOK}) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def jaccard(spark, sf):
    t = R.table(spark, sf, "benchmark").select("item_id", F.array_distinct(T.tokens("text")).alias("t"))
    b = t.select(F.col("item_id").alias("b"), F.col("t").alias("u"))
    return t.join(b, F.col("b") == F.col("item_id") + 1).select(F.col("item_id").alias("a"), "b", F.round(T.jaccard("t", "u"), 6).alias("jaccard"))


@query("t22_header_like", f"WITH {R.LINES}, n AS (SELECT *, len(regexp_extract_all(trim(line), '[^ \\t\\n\\r\\f\\x0b]+')) AS n FROM lines) SELECT doc_id, line_no, n > 0 AND (n <= 3 OR (ends_with(trim(line), ':') AND n <= 5)) AS header FROM n")
def header_like(spark, sf):
    return R.doclines(spark, sf).select("doc_id", "line_no", T.header_like("line").alias("header"))


@query("io2_exclude_folder", "SELECT page_id, url FROM pages WHERE NOT (url = 'https://example.com/a' OR starts_with(url, 'https://example.com/a/'))")
def exclude_folder(spark, sf):
    from relata.sources.markdown import outside

    return outside(R.table(spark, sf, "pages").select("page_id", "url"), ["https://example.com/a/"], "url")


@query("j9_title_resolution", f"WITH p AS (SELECT p_partkey, {_FOLD.replace('{}', 'p_name')} AS f FROM part), o AS (SELECT f, min(p_partkey) AS first FROM p GROUP BY 1) SELECT p_partkey, first AS resolved FROM p JOIN o USING (f)")
def title_resolution(spark, sf):
    p = R.table(spark, sf, "part").select("p_partkey", T.fold("p_name").alias("f"))
    return p.join(p.groupBy("f").agg(F.min("p_partkey").alias("resolved")), "f").select("p_partkey", "resolved")


@query("j10_owners", f"WITH p AS (SELECT p_partkey, {_FOLD.replace('{}', 'p_name')} AS f FROM part) SELECT f AS surface, count(*) AS owners, count(*) > 1 AS ambiguous FROM p GROUP BY 1")
def owners(spark, sf):
    p = R.table(spark, sf, "part").select(T.fold("p_name").alias("surface"))
    return p.groupBy("surface").agg(F.count(F.lit(1)).alias("owners")).withColumn("ambiguous", F.col("owners") > 1)


@query("j16_copied_lines", f"""WITH {R.LINES}, f AS (SELECT doc_id, {_FOLD.replace('{}', 'line')} AS l FROM lines), k AS (SELECT DISTINCT doc_id, md5(l) AS h FROM f WHERE length(l) >= 30),
o AS (SELECT h, min(doc_id) AS first FROM k GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, first, count(*) AS lines FROM k JOIN o USING (h) WHERE doc_id <> first GROUP BY 1, 2""")
def copied_lines(spark, sf):
    """Documents that share a folded line of 30 characters with an earlier one, linked to the line's first holder."""
    lines = R.doclines(spark, sf).select("doc_id", T.fold("line").alias("l")).where(F.length("l") >= 30).select("doc_id", F.md5(F.col("l").cast("binary")).alias("h")).distinct()
    first = lines.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return lines.join(first.drop("n"), "h").where("doc_id <> first").groupBy("doc_id", "first").agg(F.count(F.lit(1)).alias("lines"))


@query("i4_exact_duplicates", "SELECT md5(text) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    h = docs(spark, sf).select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return h.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("i5_stale", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def stale(spark, sf):
    return R.table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("i7_boilerplate", f"""WITH {R.LINES}, f AS (SELECT doc_id, {_FOLD.replace('{}', 'line')} AS l FROM lines), df AS (SELECT l FROM f WHERE length(l) >= 6 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS lines, count(df.l) AS boilerplate FROM f LEFT JOIN df USING (l) GROUP BY 1""")
def boilerplate(spark, sf):
    """Lines of each document that at least three documents have."""
    f = R.doclines(spark, sf).select("doc_id", T.fold("line").alias("l"))
    common = f.where(F.length("l") >= 6).distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("l", F.lit(1).alias("hit"))
    return f.join(common, "l", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count("hit").alias("boilerplate"))


_DTOK = f"tok AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS t FROM documents)"


@query("i9_continuity", f"""WITH {_DTOK}, df AS (SELECT t, count(*) AS df FROM tok WHERE length(t) >= 6 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3), n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.t, ln(n::DOUBLE / df) AS w FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id JOIN df ON df.t = a.t, n)
SELECT a, b, round(max(w), 6) AS score, count(*) AS shared FROM p GROUP BY 1, 2 HAVING count(*) <= 10""")
def continuity(spark, sf):
    """Pairs that share tokens which only two or three documents have; at most ten, else they are copies."""
    d = docs(spark, sf)
    tok = d.select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t"))
    df = tok.where(F.length("t") >= 6).groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df between 2 and 3")
    n = F.broadcast(d.agg(F.count(F.lit(1)).alias("n")))
    rare = tok.join(df, "t").crossJoin(n).select("t", "doc_id", F.log(F.col("n") / F.col("df")).alias("w"))
    pairs = rare.select("t", F.col("doc_id").alias("a"), "w").join(rare.select("t", F.col("doc_id").alias("b")), "t").where("a < b")
    return pairs.groupBy("a", "b").agg(F.round(F.max("w"), 6).alias("score"), F.count(F.lit(1)).alias("shared")).where("shared <= 10")


@query("i13_question_battery", r"""WITH q AS (SELECT conv_id, turn, regexp_matches(trim(text), '[?]$') AS q FROM conversations)
SELECT conv_id, turn, coalesce(lag(q) OVER w, false) OR coalesce(lead(q) OVER w, false) AS battery FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def question_battery(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = R.table(spark, sf, "conversations").select("conv_id", "turn", F.trim("text").rlike("[?]$").alias("q"))
    return q.select("conv_id", "turn", (F.coalesce(F.lag("q").over(w), F.lit(False)) | F.coalesce(F.lead("q").over(w), F.lit(False))).alias("battery"))


@query("i16_keyphrases", f"""WITH tk AS (SELECT doc_id, unnest({_TOK}) AS t FROM documents), tf AS (SELECT doc_id, t, count(*) AS n FROM tk GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS c FROM documents),
s AS (SELECT doc_id, t, round(n * ln(1 + c::DOUBLE / df), 6) AS s FROM tf JOIN df USING (t), c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, t) AS r FROM s)
SELECT doc_id, string_agg(t, ' · ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY 1""")
def keyphrases(spark, sf):
    """Three tokens of greatest tf * ln(1 + N / df) of each document."""
    d = docs(spark, sf)
    tf = d.select("doc_id", F.explode(T.tokens("text")).alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = F.broadcast(d.agg(F.count(F.lit(1)).alias("c")))
    s = tf.join(df, "t").crossJoin(n).withColumn("s", F.round(F.col("n") * F.log1p(F.col("c") / F.col("df")), 6))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("s").desc(), "t"))).where("r <= 3")
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " · ")
    return r.groupBy("doc_id").agg(label.alias("label"))


@query("r11_bm25", f"""WITH tk AS (SELECT item_id, unnest({_TOK}) AS t FROM benchmark), dt AS (SELECT doc_id, unnest({_TOK}) AS t FROM documents), tf AS (SELECT doc_id, t, count(*) AS n FROM dt GROUP BY 1, 2),
len AS (SELECT doc_id, sum(n)::DOUBLE AS l FROM tf GROUP BY 1), av AS (SELECT avg(l) AS a, count(*) AS c FROM len), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), qa AS (SELECT DISTINCT item_id, t FROM tk), q AS (SELECT item_id, t FROM (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY df, t) AS r FROM qa JOIN df USING (t)) WHERE r <= 60),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (c - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 6) AS score FROM q JOIN tf USING (t) JOIN len USING (doc_id) JOIN df USING (t), av GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def bm25(spark, sf):
    d = docs(spark, sf)
    tf = d.select("doc_id", F.explode(T.tokens("text")).alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    length = tf.groupBy("doc_id").agg(F.sum("n").cast("double").alias("l"))
    av = length.agg(F.avg("l").alias("a"), F.count(F.lit(1)).alias("c"))
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    q = R.table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t"))
    rarest = Window.partitionBy("item_id").orderBy("df", "t")
    q = q.join(df, "t").withColumn("r", F.row_number().over(rarest)).where("r <= 60").drop("r")
    terms = q.join(tf, "t").join(length, "doc_id").crossJoin(F.broadcast(av))
    idf = F.log1p((F.col("c") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = terms.groupBy("item_id", "doc_id").agg(F.round(F.sum(idf * F.col("n") * 2.2 / (F.col("n") + 1.2 * (0.25 + 0.75 * F.col("l") / F.col("a")))), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("r13_keyword_fallback", f"""WITH q AS (SELECT DISTINCT item_id, unnest({_TOK}) AS t FROM benchmark), {_DTOK}, nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), nd AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
s AS (SELECT item_id, doc_id, count(*) AS k FROM q JOIN tok USING (t) GROUP BY 1, 2), j AS (SELECT item_id, doc_id, round(k::DOUBLE / (nq.n + nd.n - k), 6) AS score FROM s JOIN nq USING (item_id) JOIN nd USING (doc_id))
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM j) WHERE rank <= 10""")
def keyword_fallback(spark, sf):
    tok = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t"))
    q = R.table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t"))
    nq, nd = q.groupBy("item_id").agg(F.count(F.lit(1)).alias("nq")), tok.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nd"))
    s = q.join(tok, "t").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("k")).join(nq, "item_id").join(nd, "doc_id")
    s = s.select("item_id", "doc_id", F.round(F.col("k") / (F.col("nq") + F.col("nd") - F.col("k")), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("r16_recent", "SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 80")
def recent(spark, sf):
    top = R.table(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(80)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.col("o_orderdate").desc(), "o_orderkey")).cast("long").alias("rank"))


@query("k1_suggest_k", "SELECT label, greatest(3, least(16, floor(sqrt(count(*) / 2.0::DOUBLE) + 0.5::DOUBLE)))::BIGINT AS k FROM embeddings GROUP BY 1")
def suggest_k(spark, sf):
    n = R.table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", F.greatest(F.lit(3), F.least(F.lit(16), F.floor(F.sqrt(F.col("n") / 2) + 0.5))).cast("long").alias("k"))


@query("k6_cluster_labels", f"""WITH t AS (SELECT vec_id, label, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM embeddings JOIN part ON p_partkey = vec_id), f AS (SELECT * FROM t WHERE length(w) >= 3 AND regexp_matches(w, '[a-z]')),
tf AS (SELECT label, w, count(*) AS n FROM f GROUP BY 1, 2), tot AS (SELECT label, count(*) AS m FROM f GROUP BY 1), df AS (SELECT w, count(DISTINCT vec_id) AS df FROM f GROUP BY 1), c AS (SELECT count(*) AS c FROM embeddings JOIN part ON p_partkey = vec_id),
s AS (SELECT label, w, round(n::DOUBLE / m * ln(1 + c::DOUBLE / df), 9) AS s FROM tf JOIN tot USING (label) JOIN df USING (w), c)
SELECT label, w AS word, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, w) AS rank FROM s) WHERE rank <= 10""")
def cluster_terms(spark, sf):
    from relata.operators.cluster import term_scores

    t = R.table(spark, sf, "embeddings").join(R.table(spark, sf, "part"), F.col("p_partkey") == F.col("vec_id")).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("p_name").alias("title"))
    s = term_scores(t)
    w = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "word")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(F.col("cluster").alias("label"), "word", "rank")


@query("k8_purity", """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM n), a AS (SELECT lang, sum(n) AS na FROM n GROUP BY 1), b AS (SELECT source, sum(n) AS nb, max(n) AS top FROM n GROUP BY 1),
mi AS (SELECT sum(n::DOUBLE / t * ln(n::DOUBLE * t / (na * nb))) AS mi FROM n JOIN a USING (lang) JOIN b USING (source), t), ha AS (SELECT -sum(na::DOUBLE / t * ln(na::DOUBLE / t)) AS h FROM a, t), hb AS (SELECT -sum(nb::DOUBLE / t * ln(nb::DOUBLE / t)) AS h FROM b, t)
SELECT round((SELECT sum(top) FROM b)::DOUBLE / t, 6) AS purity, round(2 * mi / (ha.h + hb.h), 6) AS nmi FROM t, mi, ha, hb""")
def purity(spark, sf):
    from relata.operators.cluster import agreement

    return agreement(docs(spark, sf).select(F.col("source").alias("cluster"), F.col("lang").alias("truth")))


@query("st2_debounce", """WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 20 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM t) SELECT epoch_us(min(ts)) AS start_us, count(*) AS events, count(DISTINCT user_id) AS paths FROM s GROUP BY s""")
def debounce(spark, sf):
    from relata.streaming.feed import sessions

    e = R.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("path"))
    s = sessions(e)
    return s.select(F.unix_micros("start").alias("start_us"), "events", F.size("paths").cast("long").alias("paths"))


@query("st1_latest_state", "SELECT user_id AS path, event_type AS op FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark, sf):
    from relata.streaming.feed import latest

    e = R.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").alias("path"), F.col("event_type").alias("op"))
    return latest(e, "event_id").select("path", "op")
