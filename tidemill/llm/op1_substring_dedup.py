"""Substring dedup by level-wise doubling.

A window of ``window`` words that occurs in two documents holds a half-length window that does too.
Level one hashes half-length windows, but only at positions that every copy of a full window selects
alike: the smallest hash among the half windows of each full window. Half windows that stand in one
document alone end there. Those that repeat are extended to twice their length: all full windows
around them are told apart by the SHA-256 of their words (its first 128 bits), so that equal keys mean
equal words, and the smallest doc_id of each is found. The loop goes on, pairing neighbouring windows that
repeat into ones of twice the length until no candidate survives; ``longest`` tells the longest length
reached. Hashes of level one that collide only make more candidates.

Documents of equal word sequences (by SHA-256) count as one class, whose smallest row alone goes through
the levels, so that a group of copies of any size costs one document. All members of a class repeat whole:
their ``longest`` is the longest doubling that fits.

Defined results: null text has no words; a document of fewer words than the window keeps all. A row
with null doc_id is neither source nor target and keeps all its words. Rows that share a doc_id are
separate documents none of which is smaller than the other. An empty table gives an empty result.
Extra columns of the input are ignored (``repeated_spans``) or kept (``remove_repeats``), whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import Scratch, column, lean, slices, table, tune
from tidemill.llm._text import SPACED, Windows, fits, sliding, word_hashes, words

WINDOW = 50

_SCAN = "doc_id long, rid long, gram long, n_words long, sha string"
_FULL = "h1 long, h2 long, doc_id long, rid long, pos long"
#: Rows of one batch of windows that a worker gives back.
_ROWS = 50_000


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchors(hashes: np.ndarray, valid: np.ndarray, half: int, window: int) -> np.ndarray:
    """Positions of half windows that are the smallest of some valid full window."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = Windows(hashes).all(half)
    width = window - half + 1
    least = sliding(h, width, np.minimum)
    least[~valid[:n]] = 0
    pad = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero((best == h) & (h != 0))


def _scan(window: int):
    half = window - window // 2

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(column(part, "text"), SPACED)
                h = word_hashes(w)
                ids, rid, n = column(part, "doc_id"), column(part, "rid"), w.counts
                raw = w.buf.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(*_ends(w), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, rid, pa.nulls(len(ids), pa.int64()), pa.array(n.astype(np.int64)), pa.array(sha, pa.string())], names=["doc_id", "rid", "gram", "n_words", "sha"])
                every, sums = anchors(h, fits(w, window), half, window), Windows(h)
                for a in range(0, len(every), _ROWS):
                    at = every[a : a + _ROWS]
                    row = pa.array(np.searchsorted(w.row, at, "right") - 1)
                    pos = _i64((at - w.row[row.to_numpy()]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([ids.take(row), rid.take(row), _i64(sums.of(at, half)), pos, pa.nulls(len(at), pa.string())], names=["doc_id", "rid", "gram", "n_words", "sha"])

    return run


def _ends(w) -> tuple[list[int], list[int]]:
    """First and last word byte of each row; equal where a row has no word."""
    n = len(w.first)
    a = [int(w.first[i]) if i < j else 0 for i, j in zip(w.row[:-1], w.row[1:], strict=True)] if n else [0] * (len(w.row) - 1)
    b = [int(w.last[j - 1]) if i < j else 0 for i, j in zip(w.row[:-1], w.row[1:], strict=True)] if n else a
    return a, b


def _covered(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of n places lie in [p - before, p + after) of some p."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(at - before, 0, n), 1)
    np.add.at(edge, np.clip(at + after, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _ragged(col: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in col.to_pylist()]


def _windows(window: int):
    """The full windows around repeated half windows, by the first 128 bits of the SHA-256 of their words."""
    reach = window - (window - window // 2)

    @lean
    def run(batches):
        for batch in batches:
            for text, at, doc_id, rid in zip(column(batch, "text").to_pylist(), _ragged(column(batch, "at")), column(batch, "doc_id").to_pylist(), column(batch, "rid").to_pylist(), strict=True):
                own = (text or "").encode().split()
                n = len(own) - window + 1
                if n <= 0:
                    continue
                joined = b" ".join(own)
                first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)])
                every = np.flatnonzero(_covered(at, reach, 1, n))
                for a in range(0, len(every), _ROWS):
                    pos = every[a : a + _ROWS]
                    raw = b"".join([hashlib.sha256(joined[s : e - 1]).digest()[:16] for s, e in zip(first[pos].tolist(), first[pos + window].tolist(), strict=True)])
                    key = np.frombuffer(raw, "<i8").reshape(-1, 2)
                    fill = lambda x, n=len(pos): pa.array(np.full(n, x, np.int64))
                    yield pa.RecordBatch.from_arrays([_i64(key[:, 0]), _i64(key[:, 1]), fill(doc_id), fill(rid), pa.array(pos.astype(np.int64))], names=["h1", "h2", "doc_id", "rid", "pos"])

    return run


def _cut(window: int):
    """Word spans covered by removed windows, and the digest of what is left."""

    @lean
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_removed", "spans", "kept_sha256")}
            for text, at in zip(column(batch, "text").to_pylist(), _ragged(column(batch, "at")), strict=True):
                own = (text or "").encode().split()
                gone = _covered(at, 0, window, len(own))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out["n_removed"].append(int(gone.sum()))
                out["spans"].append([{"first": int(a), "last": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                out["kept_sha256"].append(hashlib.sha256(b" ".join(own[i] for i in np.flatnonzero(~gone))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "rid"), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(out["kept_sha256"], pa.string())],
                names=["doc_id", "rid", "n_removed", "spans", "kept_sha256"],
            )

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, rid (hash of the text), n_words, n_removed, kept_sha256, spans (of
    removed words, from 0, end exclusive) and longest (words of the longest doubling that repeats; null if
    nothing does)."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), F.col("text").cast("string").alias("text"))
    key = ["doc_id", "rid"]

    # Level one: half windows, and the class of each document's whole word sequence.
    found = scratch.put("half", docs.mapInArrow(_scan(window), _SCAN))
    half = found.where(F.col("gram").isNotNull() & F.col("doc_id").isNotNull()).select("gram", *key, F.col("n_words").alias("pos"))
    whole = scratch.put("whole", found.where(F.col("sha").isNotNull()).select(*key, "n_words", "sha"))
    classes = whole.where("doc_id is not null").groupBy("sha").agg(F.min(F.struct("doc_id", "rid")).alias("least"), F.max("doc_id").alias("top"))
    classes = scratch.put("classes", classes)
    again = scratch.put("again", half.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram"))

    # Level two: the survivors, of one document per class, extended to twice the length.
    stand = classes.select("least.*", "sha")
    places = half.join(again, "gram", "left_semi").join(stand, key, "left_semi")
    places = scratch.put("places", places.groupBy(*key).agg(F.collect_list("pos").alias("at")))
    scratch.drop("half", "again")
    near = scratch.put("near", docs.join(places, key).dropDuplicates(key))
    full = scratch.put("full", near.mapInArrow(_windows(window), _FULL))
    owner = scratch.put("owner", full.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top")).where("owner < top").drop("top"))
    level = scratch.put("level0", full.join(owner, ["h1", "h2"]))
    scratch.drop("full", "owner", "places")
    gone = level.where("doc_id > owner").groupBy(*key).agg(F.collect_list("pos").alias("at"))
    cut = near.drop("at").join(gone, key).mapInArrow(_cut(window), "doc_id long, rid long, n_removed long, spans array<struct<first:long,last:long>>, kept_sha256 string")
    cut = scratch.put("cut", cut)
    longest = _longest(scratch, level.drop("owner"), key, window)
    stand = scratch.put("stand", stand.join(cut, key, "left").join(longest, key, "left").select("sha", "n_removed", "kept_sha256", "spans", "longest"))

    # A copy of a whole document goes entirely, if it is long enough to hold a window.
    n = F.col("n_words")
    twice = F.expr(f"cast({window} * power(2, length(bin(n_words div {window})) - 1) as long)")
    out = whole.join(classes.withColumnRenamed("least", "_least"), "sha", "left").join(stand, "sha", "left")
    known = F.col("doc_id").isNotNull()
    copy = known & (F.col("doc_id") > F.col("_least.doc_id")) & (n >= window)
    none = F.expr("cast(array() as array<struct<first:long,last:long>>)")
    out = out.select(
        *key, "n_words",
        F.when(copy, n).when(known, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(known, F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("first"), n.alias("last")))).when(known, F.coalesce("spans", none)).otherwise(none).alias("spans"),
        F.when(known & (F.col("top") > F.col("_least.doc_id")) & (n >= window), twice).when(known, F.col("longest")).alias("longest"),
    )
    return scratch.last("spans", out)


def _longest(scratch: Scratch, level: DataFrame, key: list[str], length: int) -> DataFrame:
    """Doubling beyond the window: pair survivors one length apart until none is left. (key, longest)"""
    best, k = None, 0
    while not level.isEmpty():
        now = level.groupBy(*key).agg(F.lit(length).cast("long").alias("longest"))
        best = now if best is None else best.unionByName(now).groupBy(*key).agg(F.max("longest").alias("longest"))
        best = scratch.put(f"best{k}", best)
        right = level.select(*key, (F.col("pos") - length).alias("pos"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
        pair = level.join(right, [*key, "pos"]).select(F.xxhash64("h1", "h2", "r1", "r2").alias("h1"), F.xxhash64("r2", "r1", "h2", "h1").alias("h2"), *key, "pos")
        pair = scratch.put("pair", pair)
        alive = scratch.put("alive", pair.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2"))
        length, k = 2 * length, k + 1
        level = scratch.put(f"level{k}", pair.join(alive, ["h1", "h2"], "left_semi"))
        scratch.drop("pair", "alive", f"level{k - 1}", *([f"best{k - 2}"] if k > 1 else []))
    return level.select(*key, F.lit(0).cast("long").alias("longest")) if best is None else best


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with every removed word cut out; what is left is joined by one space."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    i, j = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = docs.toDF(*names)
    spans = repeated_spans(docs, window).where("n_removed > 0").select("doc_id", "rid", "spans").dropDuplicates(["doc_id", "rid"])
    word = F.filter(F.split(names[j], r"[\x20\x09-\x0D]+"), lambda x: x != "")
    kept = F.array_join(F.filter(word, lambda x, i: ~F.exists("spans", lambda s: (i >= s["first"]) & (i < s["last"]))), " ")
    joined = rows.join(spans, (F.col(names[i]).cast("long") == F.col("doc_id")) & (F.xxhash64(names[j]) == F.col("rid")), "left")
    return joined.withColumn(names[j], F.when(F.col("rid").isNull(), F.col(names[j])).otherwise(kept)).select(*names).toDF(*docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"), "longest")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}


def _oracle(levels: int = 12) -> str:
    """The same rows; ``longest`` up to 50 * 2^levels words."""
    lists = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    doubled = "".join(
        f""",
l{k} AS (SELECT a.r, a.doc_id, a.i, md5(a.h || b.h) AS h FROM l{k - 1} a JOIN l{k - 1} b ON a.r = b.r AND b.i = a.i + {WINDOW << (k - 1)})"""
        for k in range(1, levels + 1)
    )
    longest = " UNION ALL ".join(f"SELECT r, {WINDOW << k} AS n FROM l{k} WHERE h IN (SELECT h FROM l{k} GROUP BY h HAVING min(doc_id) < max(doc_id))" for k in range(levels + 1))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {lists} AS w FROM documents),
l0 AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM docs WHERE len(w) >= {WINDOW} AND doc_id IS NOT NULL)
){doubled},
least AS (SELECT h, min(doc_id) AS owner FROM l0 GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS j FROM l0 JOIN least USING (h) WHERE doc_id > owner),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS t FROM each ANTI JOIN gone USING (r, j) GROUP BY r),
runs AS (SELECT r, count(*) AS n_removed, count(*) FILTER (NOT again) AS n_spans FROM (SELECT r, coalesce(lag(j) OVER (PARTITION BY r ORDER BY j) = j - 1, false) AS again FROM gone) GROUP BY r),
longest AS (SELECT r, max(n) AS longest FROM ({longest}) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans, cast(longest AS bigint) AS longest
FROM docs LEFT JOIN runs USING (r) LEFT JOIN kept USING (r) LEFT JOIN longest USING (r)
"""


ORACLES = {"op1_substring_dedup": _oracle()}
