"""Secret scans with corpus-wide ownership frequency, in DataFrame and SQL functions only.

Candidates are cut from whole texts by regular expressions; a match's place follows from the lengths of
the pieces between matches. All candidates are hashed and counted over the corpus by distinct
repositories and owners. A value held by ``COMMON_OWNERS`` owners or more, or in ``COMMON_REPOSITORIES``
repositories or more of whatever owners, is a widely copied example; one held by fewer, with ``VARIETY`` distinct characters or more, looks live. Base kinds (assign, access, hex)
are always reported; the method's own kind ``owned`` (long mixed strings that no base pattern asks for)
is reported only where it looks live and belongs to one owner.

Counting is by partial aggregation and the join with the counts reads written tables on both sides, so a
value copied into a third of all documents is counted before it moves and its join partition can be split.

Defined results: null text counts as empty and has no spans; base_sha256 and spans of no span are those
of the empty string. Places are code points, from 0, end exclusive. Repeated rows give repeated results
and count once per repository. A null owner or repository counts as one more. Extra columns are ignored
(``scan``) or kept (``redact``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import Scratch, table

#: kind -> (pattern, group that is the value, least length of the value). Base kinds first, in their order.
_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),  # as AKIA[A-Z0-9]+ of 18 characters or more
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "owned": (r"[A-Za-z0-9_+/-]{24,}", 0, 24),
}
BASE = ("assign", "access", "hex")
COMMON_OWNERS, COMMON_REPOSITORIES, VARIETY = 3, 100, 8

_SPAN = "array<struct<first:int,ord:int,last:int,kind:string,value:string>>"


def _spans(kind: str, order: int) -> str:
    """SQL for the spans of one kind. Only texts in which the pattern occurs are cut into pieces."""
    pattern, group, least = KINDS[kind]
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    mixed = "AND x.v RLIKE '[0-9]' AND x.v RLIKE '[a-z]' AND x.v RLIKE '[A-Z]'" if kind == "owned" else ""
    zipped = f"arrays_zip(slice(split(text, {p}, -1), 1, size(regexp_extract_all(text, {p}, 0))), regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {group}))"
    zipped = f"transform({zipped}, x -> named_struct('p', length(x['0']), 'm', length(x['1']), 'v', x['2']))"
    one = f"array(named_struct('first', acc.pos + x.p, 'ord', {order}, 'last', acc.pos + x.p + x.m, 'kind', '{kind}', 'value', x.v))"
    return f"""CASE WHEN text RLIKE {p} THEN aggregate({zipped}, named_struct('pos', 0, 'out', cast(array() AS {_SPAN})),
      (acc, x) -> named_struct('pos', acc.pos + x.p + x.m, 'out', CASE WHEN length(x.v) >= {least} {mixed} THEN concat(acc.out, {one}) ELSE acc.out END),
      acc -> acc.out) ELSE cast(array() AS {_SPAN}) END"""


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", common: int = COMMON_OWNERS, copies: int = COMMON_REPOSITORIES) -> DataFrame:
    """Per row: doc_id, rid (hash of the text), n_assign, n_access, n_hex, base_sha256, and found: all
    spans (first, ord, last, kind, value, owners, repositories, live), sorted by place and kind."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("rid"), "owner", "repository", *(F.expr(_spans(k, i)).alias(k) for i, k in enumerate(KINDS)))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-1)))
    rows = scratch.put("spans", rows)
    every = rows.select("k", "rid", "owner", "repository", F.explode(F.concat(*KINDS)).alias("s")).select("k", "rid", "owner", "repository", "s", F.sha2("s.value", 256).alias("hash"))
    held = every.select("hash", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("="), "repository"), F.lit("")).alias("repository")).distinct()
    counts = held.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    counts = scratch.put("held", counts)
    variety = F.size(F.array_distinct(F.split("s.value", "")))
    judged = every.join(counts, "hash").withColumn("live", (F.col("owners") < common) & (F.col("repositories") < copies) & (variety >= VARIETY))
    judged = judged.where((F.col("s.kind") != "owned") | (F.col("live") & (F.col("owners") == 1)))
    span = F.struct(*(F.col(f"s.{c}").alias(c) for c in ("first", "ord", "last", "kind", "value")), "owners", "repositories", "live")
    per = judged.groupBy("k", "rid").agg(F.sort_array(F.collect_set(span)).alias("found"))
    base = F.concat(*BASE)
    out = rows.select("doc_id", "k", "rid", *(F.size(b).cast("long").alias(f"n_{b}") for b in BASE), F.sha2(_joined(base), 256).alias("base_sha256"))
    return scratch.last("secrets", out.join(per, ["k", "rid"], "left").drop("k"))


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mask: str = "[SECRET]") -> DataFrame:
    """The documents with each run of live-looking spans replaced by ``mask``. Widely copied examples stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(x)] for x in ("doc_id", "text"))
    found = scan(docs, owner, repository)
    live = F.filter("found", lambda x: x["live"])
    found = found.where(F.size(live) > 0).select(F.coalesce("doc_id", F.lit(-1)).alias("k"), "rid", live.alias("live")).dropDuplicates(["k", "rid"])
    masked = f"""aggregate(live, named_struct('at', 0, 'out', ''),
      (acc, x) -> CASE WHEN x.last <= acc.at THEN acc WHEN x.first < acc.at THEN named_struct('at', x.last, 'out', acc.out)
        ELSE named_struct('at', x.last, 'out', concat(acc.out, substring({text}, acc.at + 1, x.first - acc.at), '{mask}')) END,
      acc -> concat(acc.out, substring({text}, acc.at + 1)))"""
    rows = docs.toDF(*names)
    same = (F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)) == F.col("k")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("rid"))
    joined = rows.join(found, same, "left")
    return joined.withColumn(text, F.when(F.col("live").isNotNull(), F.expr(masked)).otherwise(F.col(text))).select(*names).toDF(*docs.columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    spans = F.coalesce(_joined("found"), F.lit(""))
    n = lambda keep: F.coalesce(F.size(F.filter("found", keep)), F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"),
        n(lambda x: x["live"]).alias("n_live"), n(lambda x: (x["owners"] >= COMMON_OWNERS) | (x["repositories"] >= COMMON_REPOSITORIES)).alias("n_example"),
    )


def _oracle() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    cuts = "\nUNION ALL ".join(
        f"SELECT r, {i} AS ord, '{k}' AS kind, string_split_regex(t, {q(p)}) AS p, regexp_extract_all(t, {q(p)}, 0) AS m, regexp_extract_all(t, {q(p)}, {g}) AS v, {least} AS least FROM docs"
        for i, (k, (p, g, least)) in enumerate(KINDS.items())
    )
    joined = "string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, ord)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
cuts AS ({cuts}),
each AS (SELECT r, ord, kind, least, p, m, v, unnest(range(1, len(m) + 1)) AS i FROM cuts WHERE len(m) > 0),
placed AS (
  SELECT r, ord, kind, least, v[i] AS value, length(m[i]) AS n,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS first
  FROM each
),
spans AS (
  SELECT r, ord, kind, value, cast(first AS bigint) AS first, cast(first + n AS bigint) AS last, doc_id, source FROM placed JOIN docs USING (r)
  WHERE length(value) >= least AND (kind <> 'owned' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')))
),
held AS (SELECT value, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS repositories FROM spans GROUP BY value),
judged AS (
  SELECT *, owners < {COMMON_OWNERS} AND repositories < {COMMON_REPOSITORIES} AND len(list_distinct(string_split(value, ''))) >= {VARIETY} AS live FROM spans JOIN held USING (value)
),
kept AS (SELECT * FROM judged WHERE kind <> 'owned' OR (live AND owners = 1)),
per AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    {joined} FILTER (kind <> 'owned') AS base, {joined} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (owners >= {COMMON_OWNERS} OR repositories >= {COMMON_REPOSITORIES}) AS n_example
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN per USING (r)
"""


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES = {"op3_secret_scan": _oracle()}
