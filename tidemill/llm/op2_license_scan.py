"""License scans by a positional index of rare words.

Templates are the texts of public licences and the notices that refer to them, each with the phrases that must
stand in it. A word's inverse document frequency is taken over the templates. For each file and each template
whose rare words (see ``RARE``) it holds enough of, the file's own ``LOOKUP`` rare words of the highest frequency value
are looked up: their postings in the template, taken from their places in the file, each give a place where
the template would start, and places that enough different words agree on are candidates. A candidate counts
if all mandatory phrases of the template stand within it, word by word. No template is left out for lack of
look-ups, however many licences a file holds.

Besides, the base phrases are found wherever their words stand consecutively; their labels are always
kept. ``score`` is the largest share of a template's words that stand at their positions, at least 0.5
if a base phrase stands in the text, else 0.

Defined results: null or empty text has no words, no labels (empty strings), null first_word and
last_word, score 0. Rows are treated one by one, so repeated rows and empty tables need no rule; extra
columns are ignored. All words of a text are looked at, however long it is.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._licences import TEMPLATES
from tidemill.llm._spark import column, lean, slices, table, tune
from tidemill.llm._text import ALNUM, word_hash, word_hashes, words

#: phrase -> label
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Rare words of a template: those whose idf is within this share of the template's highest.
RARE = 0.6
#: Words of a file that are looked up for a template, and least number of different ones that agree on a place (fewer
#: if the template has fewer rare words).
LOOKUP, VOTES = 12, 2


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


class Licenses:
    """The vocabulary of templates and phrases, the postings of rare words, and the phrases as word ids."""

    def __init__(self, templates=TEMPLATES, phrases=None):
        texts = [_words(t) for _, t, _ in templates]
        self.labels = [label for label, _, _ in templates]
        self.phrases = [(p.split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        vocabulary = sorted({x for t in texts for x in t} | {x for p, _ in self.phrases for x in p})
        self.id = {x: i for i, x in enumerate(vocabulary)}
        self.bytes = [x.encode() for x in vocabulary]
        h = np.array([word_hash(x) for x in self.bytes], np.uint64)
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.hash >> np.uint64(48)] = True
        self.templates = [np.array([self.id[x] for x in t]) for t in texts]
        self.mandatory = [[np.array([self.id[x] for x in p.split()]) for p in must] for _, _, must in templates]
        df = np.zeros(len(vocabulary))
        for t in self.templates:
            df[np.unique(t)] += 1
        idf = np.array([math.log((1 + len(texts)) / (1 + x)) for x in df])
        self.idf = idf
        #: Whether a word (column) is rare in a template (row), and the words' places in each template.
        self.rare = np.zeros((len(texts), len(vocabulary)), bool)
        for k, t in enumerate(self.templates):
            self.rare[k, [x for x in t if idf[x] >= RARE * idf[t].max()]] = True
        self.any = np.append(self.rare.any(0), False)  # -1 is no word
        self.need = np.minimum(VOTES, self.rare.sum(1))
        self.postings = [{x: np.flatnonzero(t == x) for x in np.unique(t).tolist()} for t in self.templates]

    def ids(self, w) -> np.ndarray:
        """The vocabulary id of each word, -1 for others; equal hashes are checked byte by byte."""
        h = word_hashes(w)
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.filter[h >> np.uint64(48)])
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        for i, j in zip(at[same := self.hash[k] == h[at]].tolist(), self.order[k[same]].tolist(), strict=True):
            if w.buf[w.first[i] : w.last[i]].tobytes() == self.bytes[j]:
                out[i] = j
        return out

    def candidates(self, ids: np.ndarray):
        """(template, place) on which enough of the file's rarest words agree that the template starts there."""
        at = np.flatnonzero(self.any[ids])
        held = np.unique(ids[at])
        for k in np.flatnonzero(self.rare[:, held].sum(1) >= self.need).tolist() if len(held) else ():
            own = held[self.rare[k, held]]
            own = own[np.lexsort((own, -self.idf[own]))][:LOOKUP]
            places = []
            for x in own.tolist():
                here = at[ids[at] == x]
                places.append(np.unique(here[:, None] - self.postings[k][x][None, :]))
            place, votes = np.unique(np.concatenate(places), return_counts=True)
            for start in place[votes >= self.need[k]].tolist():
                yield k, start

    def match(self, ids: np.ndarray):
        """(label, share of words in place, first word) of each verified template."""
        for k, place in self.candidates(ids):
            t = self.templates[k]
            lo, hi = max(0, place), min(len(ids), place + len(t))
            if all(len(_places(ids[lo:hi], p)) for p in self.mandatory[k]):
                yield self.labels[k], float((ids[lo:hi] == t[lo - place : hi - place]).sum()) / len(t), lo


def _places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for j, x in enumerate(phrase.tolist()):
        ok &= ids[j : j + n] == x
    return np.flatnonzero(ok)


def scan(docs: DataFrame, templates=None, phrases=None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays),
    score, and matches: (label, first, share) of every verified template."""
    tune(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(Licenses(templates or TEMPLATES, phrases))

    @lean
    def run(batches):
        lic = known.value
        base = [(np.array([lic.id[x] for x in p]), label) for p, label in lic.phrases]
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(column(part, "text"), ALNUM, lower=True)
                every = lic.ids(w)
                out: dict[str, list] = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
                for k in range(part.num_rows):
                    ids = every[w.row[k] : w.row[k + 1]]
                    if not len(ids) or ids.max() < 0:
                        found, hits = [], []
                    else:
                        found = [(at, label) for p, label in base for at in _places(ids, p).tolist()]
                        hits = sorted(set(lic.match(ids)))
                    labels = {label for _, label in found}
                    out["n_base"].append(len(found))
                    out["first_word"].append(min((a for a, _ in found), default=None))
                    out["last_word"].append(max((a for a, _ in found), default=None))
                    out["base_labels"].append(sorted(labels))
                    out["labels"].append(sorted(labels | {x[0] for x in hits}))
                    out["score"].append(max([0.5 if found else 0.0, *(x[1] for x in hits)]))
                    out["matches"].append([{"label": a, "first": c, "share": b} for a, b, c in hits])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("share", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(w.counts.astype(np.int64)), *(pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True))], names=["doc_id", "n_words", *out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, matches array<struct<label:string,first:long,share:double>>"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
