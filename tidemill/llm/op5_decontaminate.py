"""Benchmark decontamination against a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words. Every run of ``n`` words of a benchmark item (the whole
item if it has fewer words) is a window; the hashes of all windows are broadcast, each document's own
windows are looked up in one pass over its word hashes, and each hit is verified word by word. The index is
a few flat arrays, some five times the size of the items' text. A benchmark larger than ``BLOCK_BYTES`` is cut into
blocks of about that size, each of which the documents pass in a job of its own, so that a worker never
holds more than one block; what the blocks found is put together by document.

Defined results: null texts have no words; items without words have no window; rows of one item_id are
one item, and a null item_id counts as the item with the empty name. Empty tables give no rows or no
hits. Extra columns are passed through by ``clean`` and ignored by ``scan``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import Scratch, column, lean, slices, table, tune
from tidemill.llm._text import ALNUM, Windows, fits, word_hashes, words

N = 10
#: Bytes of benchmark text whose windows are broadcast at once.
BLOCK_BYTES = 32 << 20

_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


class Index:
    """The distinct windows of some items, by length: sorted hashes, a filter, where each window's words stand, and the
    items that hold it (those of window g are item[cut[g] : cut[g + 1]])."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        w = words(pa.array([text for _, text in items], pa.string()), ALNUM, lower=True)
        self.names = [item for item, _ in items]
        self.buf, self.first, self.last = w.buf.copy(), w.first.astype(np.uint32), w.last.astype(np.uint32)
        sums = Windows(word_hashes(w))
        size, owner = np.minimum(n, w.counts), w.rows()
        self.of: dict[int, tuple] = {}
        for k in sorted(set(size.tolist()) - {0}):
            start = np.flatnonzero(fits(w, k) & (size[owner] == k))
            h = sums.of(start, k)
            order = np.argsort(h, kind="stable")
            start, h = start[order], h[order]
            # Windows of equal hash are one if their words are equal: told apart where a hash stands more than once.
            group = np.arange(len(h))
            kinds: dict[bytes, int] = {}
            for i in (np.flatnonzero(h[1:] == h[:-1]) + 1).tolist():
                if h[i - 1] != h[i - 2] or i < 2 or not kinds:
                    kinds = {self.text(start[i - 1], k): i - 1}
                group[i] = kinds.setdefault(self.text(start[i], k), i)
            order = np.lexsort((owner[start], group))
            own, which = owner[start][order], group[order]
            new = np.ones(len(which), bool)
            new[1:] = (which[1:] != which[:-1]) | (own[1:] != own[:-1])
            own, which = own[new], which[new]
            head = np.flatnonzero(np.diff(which, prepend=-1))
            seen = np.zeros(1 << 16, bool)
            seen[h >> np.uint64(48)] = True
            self.of[k] = (h[which[head]], seen, start[which[head]].astype(np.uint32), np.append(head, len(own)), own.astype(np.uint32))

    def text(self, a: int, size: int) -> bytes:
        return b" ".join(self.buf[self.first[i] : self.last[i]].tobytes() for i in range(int(a), int(a) + size))

    def hits(self, w, sums: Windows):
        """(first word, number of words, items) of every verified occurrence."""
        for size, (known, seen, start, cut, item) in self.of.items():
            h = sums.all(size)
            at = np.flatnonzero(seen[h >> np.uint64(48)] & fits(w, size)[: len(h)])
            a = np.searchsorted(known, h[at])
            ok = known[np.minimum(a, len(known) - 1)] == h[at]
            for i, g in zip(at[ok].tolist(), a[ok].tolist(), strict=True):
                run = w.text(i, i + size)
                while g < len(known) and known[g] == h[i]:
                    if self.text(start[g], size) == run:
                        yield i, size, [self.names[x] for x in item[cut[g] : cut[g + 1]].tolist()]
                    g += 1


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """(item, text) of the benchmark, cut into parts of at most about BLOCK_BYTES of text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    return [items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) for k in range(blocks)]


def _broadcast(items: DataFrame, n: int):
    return items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], n))


def _find(col: pa.Array, index: Index):
    w = words(col, ALNUM, lower=True)
    sums = Windows(word_hashes(w))
    hit = np.zeros(len(w.first) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for i, size, found in index.hits(w, sums):
        hit[i] += 1
        hit[i + size] -= 1
        items.setdefault(int(np.searchsorted(w.row, i, "right")) - 1, set()).update(found)
    return w, np.cumsum(hit[:-1]) > 0, items


def _hit_words(w, covered: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[w.row[1:]] - total[w.row[:-1]]


def _by_blocks(docs: DataFrame, blocks: list[DataFrame], n: int) -> DataFrame:
    """key (doc_id, rid) of contaminated documents, with the spans and items that each block found."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("rid"), F.col("text").cast("string").alias("text"))
    every = None
    for k, block in enumerate(blocks):
        index = _broadcast(block, n)

        @lean
        def run(batches, index=index):
            for batch in batches:
                for part in slices(batch, "text"):
                    w, covered, items = _find(column(part, "text"), index.value)
                    at = pa.array(sorted(items), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [column(part, "doc_id").take(at), column(part, "rid").take(at), pa.array([_edges(covered[w.row[i] : w.row[i + 1]]) for i in at.to_pylist()], _SPAN), pa.array([sorted(items[i]) for i in at.to_pylist()], pa.list_(pa.string()))],
                        names=["doc_id", "rid", "spans", "items"],
                    )

        one = rows.mapInArrow(run, "doc_id long, rid long, spans array<struct<first:long,last:long>>, items array<string>")
        one = scratch.put(f"block{k}", one.groupBy("doc_id", "rid").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        index.destroy()
        every = one if every is None else every.unionByName(one)
    every = every.groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return scratch.last("blocks", every)


def _known(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns of docs, renamed, with the spans and items found; and the new names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(x)]) for x in ("doc_id", "text"))
    same = doc_id.cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text.cast("string")) == F.col("rid"))
    return docs.toDF(*names).join(found, same, "left").drop("doc_id", "rid"), names


def _told(part: pa.RecordBatch, text: str):
    """As ``_find``, from spans and items found before."""
    w = words(column(part, text), ALNUM, lower=True)
    hit = np.zeros(len(w.first) + 1, np.int64)
    items = {}
    for k, (spans, found) in enumerate(zip(column(part, "spans").to_pylist(), column(part, "items").to_pylist(), strict=True)):
        if spans:
            items[k] = set(found)
        for x in spans or ():
            hit[w.row[k] + x["first"]] += 1
            hit[w.row[k] + x["last"]] -= 1
    return w, np.cumsum(hit[:-1]) > 0, items


def _edges(x: np.ndarray) -> list[dict]:
    e = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b)} for a, b in zip(e[::2], e[1::2], strict=True)]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted), spans (hit words, from 0, end exclusive)."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, names, index = _prepared(docs, benchmark, n)

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, names[1]):
                w, covered, items = _find(column(part, names[1]), index.value) if index else _told(part, names[1])
                n_hit = _hit_words(w, covered)
                spans = [_edges(covered[w.row[k] : w.row[k + 1]]) if n_hit[k] else [] for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [column(part, names[0]), pa.array(w.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([sorted(items.get(k, ())) for k in range(part.num_rows)], pa.list_(pa.string())), pa.array(spans, _SPAN)],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return rows.mapInArrow(run, "doc_id long, " + _FOUND)


def _prepared(docs: DataFrame, benchmark: DataFrame, n: int):
    """The rows to go through, the names of docs' columns there, and the index; None if the rows carry what was found."""
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        return docs, docs.columns, _broadcast(blocks[0], n)
    return *_known(docs, _by_blocks(docs, blocks, n)), None


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, spans: bool = False) -> DataFrame:
    """The documents without contaminated ones, or with ``spans`` all of them without the hit words (from
    the first byte of each run of hit words to its last). All columns stay."""
    tune(docs.sparkSession)
    rows, names, index = _prepared(docs, benchmark, n)
    place, wide = docs.columns.index("text"), len(docs.columns)

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, names[place]):
                w, covered, _ = _find(part.column(place), index.value) if index else _told(part, names[place])
                n_hit = _hit_words(w, covered)
                part = pa.RecordBatch.from_arrays(part.columns[:wide], names=docs_names)
                if not spans:
                    yield part.filter(pa.array(n_hit == 0))
                    continue
                texts = part.column(place).to_pylist()
                for k in np.flatnonzero(n_hit).tolist():
                    raw, base = texts[k].encode(), int(w.row[k])
                    skip = _start(texts, k)
                    out, at = [], 0
                    for e in _edges(covered[base : w.row[k + 1]]):
                        out.append(raw[at : int(w.first[base + e["first"]]) - skip])
                        at = int(w.last[base + e["last"] - 1]) - skip
                    texts[k] = b"".join([*out, raw[at:]]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if j == place else c for j, c in enumerate(part.columns)], schema=part.schema)

    docs_names = docs.columns
    return rows.mapInArrow(run, docs.schema)


def _start(texts: list, k: int) -> int:
    """Bytes of all texts before row k."""
    return sum(len((t or "").encode()) for t in texts[:k])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = rf"""
WITH items AS (SELECT coalesce(cast(item_id AS varchar), '') AS item, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
runs AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM grams) AS sizes WHERE len(w) >= n)
),
hits AS (SELECT r, i, n, item FROM runs JOIN grams USING (n, gram)),
hit_words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {"op5_decontaminate": ORACLE}
