"""From raw documents to token ids: language, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents. Nulls, empty texts, repeated rows,
empty tables and further columns are dealt with as the operators' own docstrings say:

* language: the classifier is fitted on a bounded sample of the labelled rows of the table itself; documents
  whose language isn't known (null text, no letter, or none of the learned languages claims the text: see
  ``op7_language_id.accept``) go, and a null lang gets the language found.
* near_duplicates: one document of each group of similar texts stays (sets of five-word shingles with a Jaccard
  similarity of 0.8 or more, found by Golay keys of SimHash fingerprints and, for the rest, exactly).
* decontamination: documents that hold a benchmark window go.
* secrets: live-looking secrets are masked, widely copied examples stay; no document goes.
* tokens: doc_id, lang, source, the text's byte-level BPE ids, their number, and the decoded text's digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import op3_secret_scan, op4_simhash, op5_decontaminate, op7_language_id, op9_bpe
from tidemill.llm._spark import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_language_id.accept(docs, op7_language_id.fit(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = op9_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: No SQL gives the classifier's and the fingerprints' decisions; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written in the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
