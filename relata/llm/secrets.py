"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is scanned once a kind where it is; only spans and hashes of values go on. Hashes
are counted over distinct owners (sources) and repositories (documents): a value that many owners
have is a copied example, one that a single owner has looks live. Spans of the base kinds always
stay; further kinds add spans only where the corpus doesn't show their value to be a copied example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, table

# fixed values: base patterns in their listed order; (kind, pattern, group of the value, least length of that group)
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 6),
    # a run is maximal whether or not it is long enough, so the length can be in the pattern
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# vendor formats that the base kinds don't cover
ADDED = (("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,})", 0, 1),)
KINDS = tuple(k for k, *_ in (*BASE, *ADDED))

#: A value that this many owners have is an example; one with a single owner is live-looking.
EXAMPLE_OWNERS = 3

_SPAN = "array<struct<start:long,kind:int,end:long,hash:string>>"


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, hash of the value), in code points.

    The gaps between matches are what ``split`` leaves, so starts are running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), F.sha2(x["v"].cast("binary"), 256).alias("hash"))
        kept = F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.cast("long").alias("at"), kept.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(id, owner, spans) of every row; a null text is empty."""
    t = F.coalesce(F.col("__text"), F.lit(""))
    found = [spans_of(t, i, p, g, n) for i, (_, p, g, n) in enumerate((*BASE, *ADDED))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner).cast("string").alias("owner"), F.col(text).cast("string").alias("__text"))
    return rows.select("id", "owner", F.array_sort(F.concat(*found)).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over (id, owner, hash); null owners are one owner.

    Sums are combined before each shuffle, so a value in a third of all documents is one row a task.
    """
    owner = F.coalesce(F.concat(F.lit("="), "owner"), F.lit(""))
    each = spans.select("hash", owner.alias("owner"), "id").distinct()
    by = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each row of ``docs``: id and ``spans``, structs (start, kind, end, hash, owners,
    repositories, verdict) by start and then kind. Verdicts: live (one owner), shared, example.

    Null and empty texts have no spans; repeated rows are scanned each and count as one repository.
    """
    rows = materialize(scan(docs, id_col, text, owner).withColumn("row", F.monotonically_increasing_id()), "spans")
    each = rows.where(F.size("spans") > 0).select("row", "id", "owner", F.explode("spans").alias("s")).select("row", "id", "owner", "s", F.col("s.hash").alias("hash"))
    counts = materialize(ownership(each), "owners")
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    total = counts.agg(F.sum("repositories")).first()[0] or 0
    judged = join_counted(each, counts, "hash", "repositories", total).withColumn("verdict", verdict)
    judged = judged.where((F.col("s.kind") < len(BASE)) | (F.col("verdict") != "example"))
    full = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("hash"), F.col("owners"), F.col("repositories"), F.col("verdict"))
    back = judged.select("row", full.alias("s")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long,hash:string,owners:long,repositories:long,verdict:string>>")
    out = rows.select("row", F.col("id").alias(id_col)).join(back, "row", "left")
    return out.select(id_col, F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def n(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(kind: int):
        return lambda s: s["kind"] == kind

    return out.select(
        "doc_id",
        *(n(of_kind(i)).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        n(lambda s: s["verdict"] == "live").alias("n_live"),
        n(lambda s: s["verdict"] == "example").alias("n_example"),
    )


def _sql() -> str:
    parts = []
    for i, (_, p, g, least) in enumerate((*BASE, *ADDED)):
        p = p.replace("'", "''")
        parts.append(f"""
  SELECT row_, doc_id, source, {i} AS kind, unnest(range(len(m))) AS j, m, v, g, {least} AS least FROM (
    SELECT row_, doc_id, source, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS g FROM texts)""")
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS row_, doc_id, source, coalesce(text, '') AS t FROM documents
), matches AS ({" UNION ALL ".join(parts)}
), spans AS (
  SELECT row_, doc_id, source, kind, v[j + 1] AS value,
    (coalesce(list_sum(list_transform(g[1:j + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:j], lambda x: length(x))), 0))::BIGINT AS start_,
    length(m[j + 1]) AS size, {kinds}[kind + 1] AS name
  FROM matches WHERE length(v[j + 1]) >= least
), owned AS (
  SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners FROM spans GROUP BY value
), judged AS (
  SELECT s.*, owners, name || ':' || start_ || ':' || (start_ + size) AS said FROM spans s JOIN owned USING (value)
  WHERE kind < {len(BASE)} OR owners < {EXAMPLE_OWNERS}
), per_row AS (
  SELECT row_, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, (k, *_) in enumerate(BASE))},
    sha256(coalesce(string_agg(said, ',' ORDER BY start_, kind) FILTER (kind < {len(BASE)}), '')) AS base_sha256,
    string_agg(said, ',' ORDER BY start_, kind) AS spans,
    count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_example
  FROM judged GROUP BY row_
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k, *_ in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM texts LEFT JOIN per_row USING (row_)
"""


SECRETS_SQL = _sql()
