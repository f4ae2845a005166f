"""Language identification with a string kernel.

The kernel is a blended spectrum: for n-grams of 1, 2 and 3 bytes of the lower-cased (A-Z) text, the
presence vectors of two texts (hashed to ``BINS`` places) are compared by their cosine, and the lengths
are added up. Landmarks drawn from the sample give Nystroem features, on which one-versus-rest kernel
ridge regression is solved. Since the kernel is linear in the presence vectors, landmarks and weights
fold into one matrix per n, and a batch of texts is scored by one matrix product each.

The classifier is fitted on at most ``SAMPLE`` labelled texts (doc_ids with the smallest hash) of each of the
``LANGUAGES`` commonest labels; everything else covers all texts, whole. Presence vectors are made on the
executors, so what reaches the driver is of fixed size per sampled doc_id, however long its text and however
often its rows repeat.

``accept`` keeps the texts whose language is known: the score (a softmax over the languages' regression
values) is ``LEAST_SCORE`` or more, so that one language outweighs all others together, and the best value is
``LEAST_VALUE`` or more, so that its own classifier (1 for its texts, -1 for others) doesn't reject the text.
Others, as text in a language that wasn't learned, strings of digits or letters at random, go. On held-out
texts of the learned languages both bounds lie below every value seen but for texts of a word or two.

Defined results: a text that is null or holds no letter has language ``und`` and score 0, as has every
text if no labelled row can be learned from. Ties go to the language that sorts first. Null labels, texts or
ids are never learned from; of a doc_id's different texts the one with the smallest vector is. Repeated rows
get repeated results; extra columns are ignored (``predict``) or kept (``accept``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import column, lean, slices, table, tune
from tidemill.llm._text import LOWER, buffers

BINS = {1: 256, 2: 4096, 3: 16384}
#: Bounds of the fit: labelled texts per language, landmarks in all; ridge and softmax scale.
SAMPLE, LANDMARKS, RIDGE, SHARP = 150, 240, 1e-3, 6.0
LANGUAGES = 64
#: What ``accept`` asks of a text's score and of its best regression value.
LEAST_SCORE, LEAST_VALUE = 0.5, -0.2
UNKNOWN = "und"
FOLDS = 5
_ROWS = 128
#: Bytes of text whose n-grams are coded at once.
_AT_ONCE = 1 << 18


def presence(col: pa.Array) -> dict[int, np.ndarray]:
    """For each n, which bins the n-grams of each text fill (rows of 0 and 1)."""
    buf, off = buffers(col)
    buf = LOWER[buf].astype(np.uint32)
    row = np.repeat(np.arange(len(col)), np.diff(off))
    end = np.repeat(off[1:], np.diff(off))
    out = {}
    for n, bins in BINS.items():
        got = np.zeros((len(col), bins), np.float32)
        m = len(buf) - n + 1
        if m > 0:
            code = buf[:m].copy()
            for j in range(1, n):
                code = code << np.uint32(8) | buf[j : j + m]
            if n > 1:
                code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bins.bit_length() + 1)
            inside = np.arange(m) + n <= end[:m]
            got[row[:m][inside], code[inside]] = 1
        out[n] = got
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def has_letter(col: pa.Array) -> np.ndarray:
    buf, off = buffers(col)
    low = LOWER[buf]
    total = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[i] = any(c.isalpha() for c in col[i].as_py())
    return out


class Model:
    """languages (sorted) and, for each n, the matrix that turns a scaled presence vector into values."""

    def __init__(self, languages: list[str], weights: dict[int, np.ndarray]):
        self.languages, self.weights = languages, weights

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.zeros((len(col), len(self.languages)), np.float32)
        for a in range(0, len(col), _ROWS):
            for n, x in presence(col[a : a + _ROWS]).items():
                out[a : a + _ROWS] += (x @ self.weights[n]) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and best regression value of each text."""
        n = len(col)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.full(n, -1.0)
        known = has_letter(col)
        raw = self.scores(col).astype(np.float64)
        best = raw.argmax(1)
        score = 1 / np.exp(SHARP * (raw - raw.max(1, keepdims=True))).sum(1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0), raw.max(1)


def solve(vectors: dict[int, np.ndarray], labels: list[str]) -> Model:
    """Nystroem features from landmarks spread over the languages, then ridge regression on +1 and -1."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], {})
    y = np.array([[1.0 if x == g else -1.0 for g in languages] for x in labels])
    turn: dict[str, int] = {}
    order = []
    for i, x in enumerate(labels):
        order.append((turn.setdefault(x, 0), i))
        turn[x] += 1
    mark = [i for _, i in sorted(order)[:LANDMARKS]]
    scaled = {n: _scaled(v.astype(np.float32)) for n, v in vectors.items()}
    k = sum(v @ v[mark].T for v in scaled.values()).astype(np.float64)
    values, vectors_ = np.linalg.eigh(k[mark])
    keep = values > 1e-8 * values.max()
    root = vectors_[:, keep] / np.sqrt(values[keep])
    phi = k @ root
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(labels) * np.eye(phi.shape[1]), phi.T @ y)
    fold = (root @ w).astype(np.float32)
    return Model(languages, {n: v[mark].T @ fold for n, v in scaled.items()})


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Learn from rows where ``train`` holds and text and lang aren't null."""
    tune(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    counts = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model([], {})
    # Hashes under a bound that lets through about twice the sample; all rows of a language that has few.
    bound = F.coalesce(*(F.when(F.col("lang") == x, F.lit(int((1 << 30) * min(1.0, 2 * sample / n + 1e-6)))) for x, n in counts.items()))
    near = ids.where(F.col("h") < bound).distinct().collect()
    chosen: dict[str, list] = {}
    for r in sorted(near, key=lambda r: (r["h"], r["doc_id"])):
        got = chosen.setdefault(r["lang"], [])
        if len(got) < sample and (not got or got[-1] != r["doc_id"]):
            got.append(r["doc_id"])
    picked = spark.createDataFrame([(d,) for x in chosen.values() for d in x], "_pick long").distinct()

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _AT_ONCE):
                for a in range(0, part.num_rows, _ROWS):
                    some = part.slice(a, _ROWS)
                    bits = [np.packbits(x.astype(bool), axis=1) for x in presence(column(some, "text")).values()]
                    yield pa.RecordBatch.from_arrays([column(some, "doc_id"), column(some, "lang"), pa.array([b.tobytes() for b in np.concatenate(bits, axis=1)], pa.binary())], names=["doc_id", "lang", "bits"])

    seen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    seen = seen.join(F.broadcast(picked), F.col("doc_id") == F.col("_pick"), "left_semi").mapInArrow(run, "doc_id long, lang string, bits binary")
    seen = seen.where(F.col("lang").isin(list(counts))).groupBy("doc_id", "lang").agg(F.min("bits").alias("bits"))
    got = sorted((r["doc_id"], r["lang"], bytes(r["bits"])) for r in seen.collect())
    bits = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, _, b in got]), axis=1)
    at, vectors = 0, {}
    for n, bins in BINS.items():
        vectors[n] = bits[:, at : at + bins]
        at += bins
    return solve(vectors, [g for _, g, _ in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    tune(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _AT_ONCE):
                names, score, _ = known.value.predict(column(part, "text"))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, languages: list[str] | None = None, least: float = LEAST_SCORE, value: float = LEAST_VALUE) -> DataFrame:
    """The documents, all columns, whose language is known (see above) and, if ``languages`` is given, one of these.
    Where a string column lang is null, it gets the language found."""
    tune(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    fill = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else -1

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _AT_ONCE):
                names, score, best = known.value.predict(column(part, "text"))
                keep = [g != UNKNOWN and s >= least and v >= value and (languages is None or g in languages) for g, s, v in zip(names, score.tolist(), best.tolist(), strict=True)]
                if fill >= 0 and part.column(fill).null_count:
                    got = pa.array([g if x is None else x for g, x in zip(names, part.column(fill).to_pylist(), strict=True)], part.column(fill).type)
                    part = pa.RecordBatch.from_arrays([got if j == fill else c for j, c in enumerate(part.columns)], schema=part.schema)
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves remainder 0; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
