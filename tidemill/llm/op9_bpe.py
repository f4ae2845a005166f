"""Byte-level BPE encoding with a contiguous rank array, and decoding.

A text is cut at special tokens, then into the pieces of the public pattern. A piece's bytes are held as
a list of parts beside a list of the ranks of neighbouring pairs; the smallest rank (leftmost on ties) is
looked for again and again, its boundary is deleted and the ranks on both sides are refreshed. Pieces of
more than ``SHORT`` bytes use the same merges through a heap, so that junk without spaces stays cheap.

No piece reaches from a character outside white space into white space, so ids are remembered for each
run of white space and what follows it.

Defined results: null text is empty and has no ids; decoding gives the empty text. Rows are treated one
by one: ties, repeated rows and empty tables need no rule; extra columns are kept, but one of the name
of the result gives way to it. Texts are never cut.
Ids that no vocabulary entry has decode to nothing; invalid UTF-8 decodes to replacement characters.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._spark import column, kept, lean, slices, table, tune

#: Unicode white space, and the public pattern with it spelt out.
_W = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
RUNS = re.compile(f"[{_W}]*[^{_W}]+|[{_W}]+")
SHORT = 64
#: Bytes of runs and their ids (and an allowance for each) that a worker remembers.
REMEMBER, ENTRY = 48 << 20, 160
_NONE = 1 << 60


def _bytes_of_characters() -> dict[str, int]:
    """The public byte alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _bytes_of_characters()
        vocab = spec["model"]["vocab"]
        self.single = [vocab[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        self.pair: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pair[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.known: dict[str, bytes] = {}
        self.left = REMEMBER

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        single, pair = self.single, self.pair
        part = [single[b] for b in raw]
        if len(part) < 2:
            return part
        if len(part) > SHORT:
            return self._long(part)
        rank = [pair.get(x, _NONE) for x in zip(part, part[1:], strict=False)]
        while rank:
            low = min(rank)
            if low == _NONE:
                break
            i = rank.index(low)
            part[i] = self.merged[low]
            del part[i + 1], rank[i]
            if i < len(rank):
                rank[i] = pair.get((part[i], part[i + 1]), _NONE)
            if i:
                rank[i - 1] = pair.get((part[i - 1], part[i]), _NONE)
        return part

    def _long(self, part: list[int]) -> list[int]:
        n, pair = len(part), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pair[x], i, *x) for i, x in enumerate(zip(part, part[1:], strict=False)) if x in pair]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = self.merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := (part[i], part[k])) in pair:
                    heapq.heappush(heap, (pair[x], i, *x))
            if (h := before[i]) >= 0 and (x := (part[h], part[i])) in pair:
                heapq.heappush(heap, (pair[x], h, *x))
        return [x for x in part if x >= 0]

    def run(self, text: str) -> bytes:
        ids = [x for p in PATTERN.findall(text) for x in self.piece(p.encode())]
        out = np.array(ids, "<i4").tobytes()
        if (size := len(text) + len(out) + ENTRY) <= self.left:
            self.known[text] = out
            self.left -= size
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        out, known = [], self.known
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                out.append(np.array([self.special[part]], "<i4").tobytes())
            else:
                for x in RUNS.findall(part):
                    got = known.get(x)
                    out.append(self.run(x) if got is None else got)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        table, n = self.bytes, len(self.bytes)
        try:
            raw = b"".join([table[i] for i in ids])
        except IndexError:
            raw = b"".join([table[i] for i in ids if 0 <= i < n])
        return raw.decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = kept(__name__)


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The rows with an array column ``ids`` and, if named, what those ids decode to in the same pass."""
    tune(docs.sparkSession)
    docs = docs.drop(ids, *([decoded] if decoded else []))
    names = docs.columns
    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    @lean
    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                raw = [bpe.encode(t) for t in column(part, text).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))])
                got = [pa.ListArray.from_arrays(pa.array(offsets), values)]
                if decoded:
                    got.append(pa.array([bpe.decode(np.frombuffer(r, "<i4").tolist()) for r in raw], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *got], names=[*names, *(f.name for f in more)])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *more]))


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with a text column ``decoded``; special tokens are kept."""
    tune(rows.sparkSession)
    rows = rows.drop(decoded)
    names = rows.columns

    @lean
    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            col = column(batch, ids)
            off = col.offsets.to_numpy()
            flat = col.values.to_numpy()
            got = [bpe.decode(flat[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*names, decoded])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(decoded, T.StringType())]))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = encode(rows, tokenizer, decoded="decoded").drop("text")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
