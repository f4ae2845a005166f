"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Counting covers all training texts: every word's count, how often each class of words follows each pair of
hashed contexts (the previous word in ``PREV`` buckets, the skipped one before it in ``SKIP``), and how often
each pair of a previous word and a word outside the head occurs.

P(word) = P(class | context) * P(word | class, context). The ``HEAD`` commonest words are dealt to 32 classes
by rank, all others to 32 tail classes by hash. The class level has features for the class, the previous
word, the skip word and their hashed pair; the word level of a head class has those for the word, the previous
word and the skip word. These weights are trained by full-batch gradient updates (scaled by the diagonal of
the curvature): each update is one job over the table of contexts, whose tasks add up the gradients of their
share of the contexts side by side.

Tail classes hold the whole rest of the vocabulary, in ``SUBS`` sub-classes by hash. Their n-gram features are
pairs of previous word and word, hashed to 64 bits, one for each pair seen twice or more, so their table grows
with the corpus. A feature of one context and one word alone has its maximum-entropy weight in closed form:
within its context (previous word and sub-class) a pair has (count - ``LESS``) / n, and all other words of
the sub-class share what is left in proportion to (c + 1), c the word's count (the mean of their sub-class for
words outside the broadcast counts). A seen pair takes its own weight alone, so the probabilities of a
context sum to a little less than one. This table is never broadcast: pairs are counted within tasks, packed
into compressed blocks by hash range, and merged range by range; the texts' own tail tokens travel to these
ranges in the same form, ``flush`` by ``flush``, and what comes back is one sum a text. The number of ranges grows
with the corpus, and tokens of a range that has many are dealt over several copies of its features, so a pair,
word or context of any frequency fills no task. (No pair of a tail word can hold more than 1 / ``HEAD`` of all tokens.)

Texts are scored in numpy batches that gather the few log probabilities each token needs. The counts of the
``HOT`` commonest words are broadcast as pairs of hash and count, a table of bounded size; for the base score all
other words go through a join with the whole count table.

Defined results: null text is empty and has the end token alone. A null doc_id counts as training and is
not held out. Repeated rows count and are scored each by itself. Without training rows every score is 0.
Ties in rank go by the word's hash. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._packed import pack, ranges_of, unpack
from tidemill.llm._spark import Scratch, column, kept, lean, slices, table, tune
from tidemill.llm._text import U64, cut, mix

FOLDS, HELD = 7, 2
HOT = 1 << 17
HEADS, MEMBERS, TAILS = 32, 32, 32  # classes of common words, words in each; classes of all other words
HEAD, CLASSES, SUBS = HEADS * MEMBERS, HEADS + TAILS, 1024
PREV, SKIP = 128, 64
CONTEXTS = PREV * SKIP
PARTS = 16  # slices of the table of contexts
UPDATES, RIDGE, LESS = 10, 2.0, 0.8
#: Tail tokens that a task holds before it packs them, texts they may belong to, and tokens of a range of pairs.
FLUSH, TEXTS, RANGE = 1 << 20, 60_000, 1 << 21
_SMOOTH = 0.5
_STEP = 3000.0  # a packed logarithm's unit is 1 / 3000
#: The end token; no word holds a line feed.
END = b"\n"


def word_hash(word: bytes) -> int:
    """XXH64 with seed 42, as Spark's xxhash64."""
    return xxhash.xxh64_intdigest(word, 42)


START = U64(word_hash(b"\n\n"))


class Vocabulary:
    """Counts of the common words by hash, and target, buckets and masses."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, subs: list[tuple[int, int, int]]):
        """hashes, counts: the common words; n, v: tokens and distinct tokens of training; subs: (sub-class,
        tokens, distinct tokens) of all words."""
        self.n, self.v = n, v
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], counts[order]
        self.rank = np.full(len(order), HEAD, np.int64)
        top = np.lexsort((self.hash, -self.count))[:HEAD]
        self.rank[top] = np.arange(len(top))
        tokens, types = np.zeros(SUBS), np.zeros(SUBS)
        for s, a, b in subs:
            tokens[s], types[s] = a, b
        sub = (self.hash >> U64(54)).astype(np.int64)
        head, rest = self.rank < HEAD, self.rank == HEAD
        tokens -= np.bincount(sub[head], self.count[head], SUBS)
        types -= np.bincount(sub[head], minlength=SUBS)
        self.mass = tokens + types + 1  # of (c + 1) over a sub-class's words, and one for words never seen
        self.log_mass = np.log10(self.mass)
        self.log_class = np.log10(self.mass.reshape(TAILS, -1).sum(1))
        out = types - np.bincount(sub[rest], minlength=SUBS) + 1
        self.log_rare = np.log10((tokens - np.bincount(sub[rest], self.count[rest], SUBS) + out) / out)

    def seen(self) -> np.ndarray:
        """Counts of the head words by rank."""
        out = np.zeros(HEAD)
        head = self.rank < HEAD
        out[self.rank[head]] = self.count[head]
        return out

    def columns(self, words: list[bytes]) -> dict[str, np.ndarray]:
        """Of each word (and of the end, last): hash, target, previous-word and skip bucket, count (-1: not common), and
        log10 of what stands for c + 1."""
        h = np.array([*map(word_hash, words), word_hash(END)], np.uint64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = self.hash[at] == h
        rank, count = np.where(hit, self.rank[at], HEAD), np.where(hit, self.count[at], -1)
        sub = (h >> U64(54)).astype(np.int64)

        def bucket(size: int) -> np.ndarray:
            # The commonest words have a bucket each, others share a third of the buckets; the last is the text's start.
            own = size - size // 3 - 1
            return np.where(rank < own, rank, own + (h % U64(size // 3)).astype(np.int64))

        return {
            "h": h, "sub": sub, "target": np.where(rank < HEAD, rank, HEAD + sub * TAILS // SUBS), "prev": bucket(PREV), "skip": bucket(SKIP),
            "count": count, "log": np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), self.log_rare[sub]),
        }


class Stream:
    """The tokens of some texts, the end of each included: which word each is, its context, and where texts start."""

    def __init__(self, col: pa.Array, vocabulary: Vocabulary):
        which, self.words, rows = cut(col)
        self.of = c = vocabulary.columns(self.words)
        n = np.diff(rows) + 1
        self.at = at = np.concatenate([[0], np.cumsum(n)])
        token = self.token = np.full(at[-1], len(self.words), np.int64)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        token[inside] = which
        p, s = np.full(at[-1], PREV - 1, np.int64), np.full(at[-1], SKIP - 1, np.int64)
        p[1:], s[2:] = c["prev"][token[:-1]], c["skip"][token[:-2]]
        p[at[:-1]], s[at[:-1]] = PREV - 1, SKIP - 1
        s[at[:-1][n > 1] + 1] = SKIP - 1
        self.context = p * SKIP + s
        self.target = c["target"][token]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tail tokens, and the key of each with its previous word: 40 bits of the context (previous
        word and sub-class), 24 of the word."""
        tail = np.flatnonzero(self.target >= HEAD)
        h = self.of["h"]
        before = np.empty(len(self.token), np.uint64)
        before[1:] = h[self.token[:-1]]
        before[self.at[:-1]] = START
        word = h[self.token[tail]]
        context = mix(before[tail] + (word >> U64(54)) * U64(0x9E3779B97F4A7C15))
        return tail, (context & ~U64(0xFFFFFF)) | (word >> U64(20) & U64(0xFFFFFF))


def _group(target: np.ndarray) -> np.ndarray:
    return np.where(target < HEAD, target // MEMBERS, target - HEAD + HEADS)


# ---- counting ------------------------------------------------------------------------------------


def _merge(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


@lean
def _word_counts(batches):
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "text"):
            which, words, rows = cut(column(part, "text"))
            n = np.bincount(which, minlength=len(words))
            got = pa.table({"word": pa.array([*words, END], pa.binary()), "n": np.append(n, part.num_rows)})
            got = got.filter(pc.greater(got["n"], 0))
            held.append(got)
            size += got.num_rows
            if size > 1 << 20:
                held = [_merge(held, ["word"])]
                size = held[0].num_rows
                if size > 1 << 19:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, size = [], 0
    if held:
        yield from _merge(held, ["word"]).to_batches(max_chunksize=50_000)


def _context_counts(vocabulary, ranges: int):
    """Rows (part, raw): packed counts of pairs for each range; the class counts of each slice of contexts as part
    -1 - slice; head words by previous and by skip word as part -1 - PARTS."""

    @lean
    def run(batches):
        v = vocabulary.value
        classes, by_prev, by_skip = np.zeros(CONTEXTS * CLASSES, np.int64), np.zeros(PREV * HEAD, np.int64), np.zeros(SKIP * HEAD, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def packed():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            got = [(k, pack(key[a:b], n[a:b].astype("<u4"))) for k, a, b in ranges_of(key, ranges)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["part", "raw"])

        for batch in batches:
            for part in slices(batch, "text"):
                s = Stream(column(part, "text"), v)
                t = s.target
                classes += np.bincount(s.context * CLASSES + _group(t), minlength=len(classes))
                head = np.flatnonzero(t < HEAD)
                p, k = np.divmod(s.context[head], SKIP)
                by_prev += np.bincount(p * HEAD + t[head], minlength=len(by_prev))
                by_skip += np.bincount(k * HEAD + t[head], minlength=len(by_skip))
                held.append(s.pairs()[1])
                size += len(held[-1])
                if size > FLUSH:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()
        dense = [*classes.reshape(PARTS, -1), np.concatenate([by_prev, by_skip])]
        yield pa.RecordBatch.from_arrays([pa.array([-1 - i for i in range(len(dense))], pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in dense], pa.binary())], names=["part", "raw"])

    return run


def _gather(rows: pa.Table) -> pa.Table:
    """One part's counts added up: dense ones as they are, pairs as features (see ``features``)."""
    part = rows["part"][0].as_py()
    blocks = [x.as_buffer() for c in rows["raw"].chunks for x in c]
    if part < 0:
        total = 0
        for x in blocks:
            total = total + np.frombuffer(zstandard.decompress(x), np.int64)
        tokens, raw = 0, total.tobytes()
    else:
        key, n = (np.concatenate(x) for x in zip(*(unpack(x, "<u8", "<u4") for x in blocks), strict=True))
        tokens, raw = int(n.sum(dtype=np.int64)), features(key, n.astype(np.int64))
    return pa.table({"part": pa.array([part], pa.int32()), "tokens": pa.array([tokens], pa.int64()), "raw": pa.array([raw], pa.binary())})


def features(key: np.ndarray, n: np.ndarray) -> bytes:
    """Two packed tables: keys of the pairs seen twice or more and the log10 of each within its context; such
    contexts and the log10 of what they leave to other words."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, n = key[new], np.add.reduceat(n, new)
    context = key >> U64(24)
    new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    kept = n >= 2
    total, own = np.add.reduceat(n, new), np.add.reduceat(np.where(kept, n - LESS, 0.0), new)
    size = np.diff(np.append(new, len(key)))
    pairs = pack(key[kept], np.log10((n[kept] - LESS) / np.repeat(total, size)[kept]).astype("<f4"))
    some = own > 0
    rest = pack(context[new][some], np.log10((total[some] - own[some]) / total[some]).astype("<f4"))
    return struct.pack("<Q", len(pairs)) + pairs + rest


class Features:
    def __init__(self, raw: bytes):
        n = struct.unpack_from("<Q", raw)[0]
        self.key, self.log = unpack(raw[8 : 8 + n], "<u8", "<f4")
        self.context, self.left = unpack(raw[8 + n :], "<u8", "<f4")

    def gain(self, key: np.ndarray, without: np.ndarray) -> np.ndarray:
        """By how much each token's log10 exceeds ``without``, that within its sub-class by the word's count alone."""
        out = np.zeros(len(key))
        if len(self.context):
            context = key >> U64(24)
            at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
            hit = self.context[at] == context
            out[hit] = self.left[at[hit]]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            out[hit] = self.log[at[hit]] - without[hit]
        return out


# ---- the model -----------------------------------------------------------------------------------


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


class Weights:
    """Class level: bias, previous, skip, pair. Word level (class, member): bias, previous, skip."""

    def __init__(self, by_class: np.ndarray, head: np.ndarray):
        self.c0 = np.log((by_class + _SMOOTH) / (by_class + _SMOOTH).sum())
        self.c1, self.c2, self.c12 = np.zeros((PREV, CLASSES)), np.zeros((SKIP, CLASSES)), np.zeros((CONTEXTS, CLASSES))
        self.w0 = np.log(head + 1e-6).reshape(HEADS, MEMBERS)
        self.w0[head.reshape(HEADS, MEMBERS) == 0] = -40.0  # no such word
        self.w1, self.w2 = np.zeros((PREV, HEADS, MEMBERS)), np.zeros((SKIP, HEADS, MEMBERS))

    def classes(self, context: np.ndarray) -> np.ndarray:
        p, s = np.divmod(context, SKIP)
        return _log_softmax(self.c0 + self.c1[p] + self.c2[s] + self.c12[context])

    def words(self, context: np.ndarray) -> np.ndarray:
        p, s = np.divmod(context, SKIP)
        return _log_softmax(self.w0 + self.w1[p] + self.w2[s])


NAMES = ("c1", "c2", "c12", "w1", "w2")


def gradient(w: Weights, context: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Over some contexts with their class counts (rows of ``CLASSES``): gradient and curvature of the class
    weights, and expected word counts and curvature of the word weights."""
    out = {x + k: np.zeros_like(getattr(w, x)) for x in NAMES for k in ("g", "h")}
    for a in range(0, len(context), 512):
        c, m = context[a : a + 512], n[a : a + 512].astype(np.float64)
        p, s = np.divmod(c, SKIP)
        prob = np.exp(w.classes(c))
        total = m.sum(1, keepdims=True)
        g, h = m - total * prob, total * prob * (1 - prob)
        for x, at in (("c1", p), ("c2", s), ("c12", c)):
            np.add.at(out[x + "g"], at, g)
            np.add.at(out[x + "h"], at, h)
        prob = np.exp(w.words(c))
        e = m[:, :HEADS, None] * prob
        h = e * (1 - prob)
        for x, at in (("w1", p), ("w2", s)):
            np.add.at(out[x + "g"], at, e)
            np.add.at(out[x + "h"], at, h)
    return out


def _rows(name: str, first: int) -> tuple[int, int]:
    """From and to which row of a weight the slice of contexts that begins at ``first`` adds: those of its contexts, of
    its previous words, or all."""
    if name == "c12":
        return first, first + CONTEXTS // PARTS
    return (first // SKIP, (first + CONTEXTS // PARTS) // SKIP) if name in ("c1", "w1") else (0, SKIP)


def train(counts: DataFrame, w: Weights, by_prev: np.ndarray, by_skip: np.ndarray, updates: int = UPDATES) -> Weights:
    """counts: (part, raw), the class counts of each slice of contexts; by_prev, by_skip: head words after each bucket.

    The driver's memory is the same for any corpus, and small: a task sends the rows of its slices alone, as Arrow
    buffers, and an update's broadcast ends with it."""
    spark = counts.sparkSession
    have = {"w1": by_prev.reshape(PREV, HEADS, MEMBERS), "w2": by_skip.reshape(SKIP, HEADS, MEMBERS)}
    size = CONTEXTS // PARTS
    for _ in range(updates):
        now = spark.sparkContext.broadcast(w)

        @lean
        def run(batches, now=now):
            total: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                for part, raw in zip(column(batch, "part").to_pylist(), column(batch, "raw"), strict=True):
                    n = np.frombuffer(raw.as_buffer(), np.int64).reshape(size, CLASSES)
                    first = (-1 - part) * size
                    at = np.flatnonzero(n.any(1))
                    for k, x in gradient(now.value, first + at, n[at]).items():
                        a, b = _rows(k[:-1], first)
                        total[k, a] = total[k, a] + x[a:b] if (k, a) in total else x[a:b]
            if total:
                names, starts = zip(*total, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(starts, pa.int32()), pa.array([v.astype("<f4").tobytes() for v in total.values()], pa.binary())], names=["name", "at", "raw"])

        sums = {x + k: np.zeros(getattr(w, x).shape) for x in NAMES for k in ("g", "h")}
        got = counts.mapInArrow(run, "name string, at int, raw binary").toArrow()  # some 1 MB a task, PARTS tasks at most
        for k, a, raw in zip(got["name"].to_pylist(), got["at"].to_pylist(), (x for c in got["raw"].chunks for x in c), strict=True):
            x = np.frombuffer(raw.as_buffer(), "<f4").reshape(-1, *sums[k].shape[1:])
            sums[k][a : a + len(x)] += x
        now.destroy()
        for x in NAMES:
            g, h = sums[x + "g"], sums[x + "h"]
            if x in have:
                g = have[x] - g
            # A step of Newton's kind on each weight alone, shared among the features active together.
            setattr(w, x, getattr(w, x) + np.clip((g - RIDGE * getattr(w, x)) / (3 * (h + RIDGE)), -1.0, 1.0))
    return w


# ---- scoring -------------------------------------------------------------------------------------


class Scorer:
    """Log10 probabilities of every context's classes and common words, from the weights."""

    def __init__(self, w: Weights):
        every = np.arange(CONTEXTS)
        self.by_class = (w.classes(every) / math.log(10)).astype(np.float32)
        self.by_word = np.empty((CONTEXTS, HEAD), np.float32)
        for a in range(0, CONTEXTS, 512):
            self.by_word[a : a + 512] = (w.words(every[a : a + 512]) / math.log(10)).reshape(-1, HEAD)

    def of(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of P(class) and, in head classes, of P(word | class)."""
        out = self.by_class[context, _group(target)].astype(np.float64)
        head = np.flatnonzero(target < HEAD)
        out[head] += self.by_word[context[head], target[head]]
        return out


_SCORERS: dict[str, Scorer] = kept(__name__)
_ROWS = "part int, deal long, flush long, local int, doc_id long, n_tokens long, known long, base double, model double, rare array<struct<word:binary,n:long>>, raw binary"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])), pa.binary()]
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(n, k)) if not isinstance(columns.get(x), int) else pa.array(np.full(n, columns[x]), k) for x, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _score(vocabulary, weights, copies, key: str):
    """A row for each text (part -1, dealt by flush) and packed tail tokens for each range of pairs."""

    @lean
    def run(batches):
        v = vocabulary.value
        if weights is not None and key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(weights.value)
        scorer = _SCORERS.get(key) if weights is not None else None
        flush, texts, size = TaskContext.get().partitionId() << 24, 0, 0
        held: list[list[np.ndarray]] = []

        def packed():
            pairs, local, log = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(pairs, kind="stable")
            pairs, local, log = pairs[order], local[order], log[order]
            got = [(k, pack(pairs[a:b], local[a:b], log[a:b])) for k, a, b in ranges_of(pairs, len(copies.value))]
            deal = [xxhash.xxh64_intdigest(struct.pack("<q", flush)) % copies.value[k] for k, _ in got]
            return _batch(len(got), part=pa.array([k for k, _ in got], pa.int32()), deal=pa.array(deal, pa.int64()), flush=flush, raw=pa.array([x for _, x in got], pa.binary()))

        for batch in batches:
            for part in slices(batch, "text"):
                s = Stream(column(part, "text"), v)
                token, at, c = s.token, s.at, s.of
                add = lambda x, at=at: np.add.reduceat(x, at[:-1]) if len(x) else np.zeros(0)
                base = add(np.log10(np.maximum(c["count"], 0) + 1.0)[token])
                known = add((c["count"] > 0)[token].astype(np.int64))
                model = np.zeros(part.num_rows)
                if scorer is not None:
                    tail, pairs = s.pairs()
                    log = scorer.of(s.context, s.target)
                    log[tail] += c["log"][token[tail]] - v.log_class[s.target[tail] - HEAD]
                    model = add(log)
                    word = token[tail]
                    without = np.clip(np.rint((c["log"][word] - v.log_mass[c["sub"][word]]) * _STEP), -32768, 32767)
                    held.append([pairs, (texts + np.searchsorted(at, tail, "right") - 1).astype("<u2"), without.astype("<i2")])
                    size += len(tail)
                # Words that aren't common, with how often each stands in each text.
                rare = np.flatnonzero(c["count"][token] < 0)
                row = np.searchsorted(at, rare, "right") - 1
                pair, many = np.unique(row * (len(s.words) + 1) + token[rare], return_counts=True)
                row, word = np.divmod(pair, len(s.words) + 1)
                names = pa.array([*s.words, END], pa.binary()).take(pa.array(word))
                each = pa.StructArray.from_arrays([names, pa.array(many.astype(np.int64))], ["word", "n"])
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                yield _batch(
                    part.num_rows, part=-1, deal=flush, flush=flush, local=pa.array(np.arange(texts, texts + part.num_rows, dtype=np.int32)), doc_id=column(part, "doc_id"), n_tokens=pa.array(np.diff(at)),
                    known=pa.array(known.astype(np.int64)), base=pa.array(base.astype(np.float64)), model=pa.array(model.astype(np.float64)), rare=pa.ListArray.from_arrays(offsets, each),
                )
                texts += part.num_rows
                if size > FLUSH or texts > TEXTS:
                    if size:
                        yield packed()
                    held, size, texts = [], 0, 0
                    flush += 1
        if size:
            yield packed()

    return run


def _answer(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    """Rows of texts as they are; for each block of tail tokens the gain of each of its texts."""
    if rows.num_rows == 0 or rows["part"][0].as_py() < 0:
        return rows
    found = Features(pairs["feature"][0].as_buffer().to_pybytes()) if pairs.num_rows else None
    flush, out = [], []
    for f, raw in zip(rows["flush"].to_pylist(), (x for c in rows["raw"].chunks for x in c), strict=True):
        key, local, log = unpack(raw.as_buffer(), "<u8", "<u2", "<i2")
        total = np.bincount(local, found.gain(key, log / _STEP) if found else np.zeros(len(key)))
        at = np.flatnonzero(total)
        if len(at):
            flush.append(f)
            out.append(pack(at.astype(np.uint64), total[at].astype("<f8")))
    return pa.Table.from_batches([_batch(len(out), flush=pa.array(flush, pa.int64()), raw=pa.array(out, pa.binary()))])


def _sum(rows: pa.Table) -> pa.Table:
    """(uid, gain) of the texts of a flush."""
    total = np.zeros(1 << 16)
    for x in (x for c in rows["raw"].chunks for x in c):
        at, gain = unpack(x.as_buffer(), "<u8", "<f8")
        total[at.astype(np.int64)] += gain
    at = np.flatnonzero(total)
    return pa.table({"uid": pa.array((rows["flush"][0].as_py() << 16) + at, pa.int64()), "gain": total[at]})


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


def _release(scratch: Scratch) -> None:
    """Delete the shuffles of what has been written, once neither Python's wrappers of those plans, which may stand in
    cycles, nor the driver's JVM hold them."""
    gc.collect()
    scratch.release()


def score(docs: DataFrame, train_on: Column, updates: int = UPDATES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), train_on.alias("learn"))
    texts = rows.where("learn").select("text")

    counts = texts.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.put("counts", counts)
    sub = F.shiftrightunsigned(F.xxhash64("word"), 54).cast("int")
    subs = [tuple(r) for r in counts.groupBy(sub).agg(F.sum("n"), F.count("*")).collect()]
    n, v = sum(r[1] for r in subs), sum(r[2] for r in subs)
    hot = _common(counts).select(F.xxhash64("word").alias("h"), "n").toArrow()
    hashes, many = (hot[c].to_numpy() for c in ("h", "n"))
    if n:
        vocabulary = spark.sparkContext.broadcast(Vocabulary(hashes.view(np.uint64), many, n, v, subs))
    else:  # one word that never occurs
        vocabulary = spark.sparkContext.broadcast(Vocabulary(np.zeros(1, np.uint64), np.zeros(1, np.int64), 0, 0, [(0, 0, 1)]))

    weights = copies = None
    if n:
        ranges = -(-n // RANGE)
        parts = texts.mapInArrow(_context_counts(vocabulary, ranges), "part int, raw binary").groupBy("part").applyInArrow(_gather, "part int, tokens long, raw binary")
        parts = scratch.put("parts", parts)
        both = np.frombuffer(bytes(parts.where(F.col("part") == -1 - PARTS).first()["raw"]), np.int64)
        by_prev, by_skip = both[: PREV * HEAD], both[PREV * HEAD :]
        dense = scratch.put("classes", parts.where((F.col("part") < 0) & (F.col("part") > -1 - PARTS)).select("part", "raw").repartition(PARTS, "part"))
        _release(scratch)
        head = vocabulary.value.seen()
        by_class = np.concatenate([head.reshape(HEADS, MEMBERS).sum(1), 10**vocabulary.value.log_class])
        weights = spark.sparkContext.broadcast(train(dense, Weights(by_class, head), by_prev, by_skip, updates))
        tokens = {r["part"]: r["tokens"] for r in parts.where("part >= 0").select("part", "tokens").collect()}
        copies = spark.sparkContext.broadcast([1 + 2 * tokens.get(k, 0) // RANGE for k in range(ranges)])

    found = rows.drop("learn").mapInArrow(_score(vocabulary, weights, copies, uuid.uuid4().hex), _ROWS)
    if n:
        deal = F.explode(F.sequence(F.lit(0).cast("long"), (2 * F.col("tokens") / RANGE).cast("long"))).alias("deal")
        pairs = parts.where("part >= 0").select("part", F.col("raw").alias("feature"), deal)
        found = pairs.groupBy("part", "deal").cogroup(found.groupBy("part", "deal")).applyInArrow(_answer, _ROWS)
    found = scratch.put("scored", found.withColumn("uid", F.shiftleft("flush", 16) + F.col("local")))
    if n:
        scratch.drop("parts", "classes")
    rare = found.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", F.col("r.n").alias("tf"))
    more = rare.join(counts.withColumnRenamed("n", "c"), "word")
    more = more.groupBy("uid").agg(F.sum("tf").alias("k2"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("s2"))
    gain = scratch.put("gain", found.where("raw is not null").select("flush", "raw").groupBy("flush").applyInArrow(_sum, "uid long, gain double"))
    _release(scratch)  # not right after the table before, whose shuffles (the largest) were then seen to stay
    k2, s2 = F.coalesce("k2", F.lit(0)), F.coalesce("s2", F.lit(0.0))
    out = found.where("local is not null").join(more, "uid", "left").join(gain, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + k2).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + s2 - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("model") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
    out = scratch.last("scores", out)
    for x in filter(None, (vocabulary, weights, copies)):  # the result stands in its table
        x.destroy()
    return out


def _common(counts: DataFrame) -> DataFrame:
    """The commonest words, about ``HOT`` of them: all whose count lies above a bound found from a histogram of
    eighths of a power of two, and of the step below it an even share by hash."""
    step = F.floor(F.log2("n") * 8)
    total, keep = 0, F.lit(False)
    for r in sorted(counts.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"]):
        if total + r["count"] > HOT:
            share = int((HOT - total) / r["count"] * (1 << 30))
            return counts.where(keep | ((step == r["b"]) & (F.pmod(F.xxhash64(F.lit(7), "word"), F.lit(1 << 30)) < share)))
        total, keep = total + r["count"], step >= r["b"]
    return counts.where(keep)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_lm_score": op8_lm_score}
ORACLES: dict[str, str] = {}
