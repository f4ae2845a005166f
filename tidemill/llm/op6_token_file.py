"""Token ids in seekable files: one zstandard frame per document, a document index and a seek table.

File: frames of little-endian ids (2 bytes where the vocabulary allows, else 4), each readable alone;
then a skippable frame with the doc ids; then the seek table, a skippable frame with the compressed and
uncompressed size and the checksum (low half of XXH64) of every frame, as in the public seekable format.
A reader fetches both tables from the end and decompresses only the frames it was asked for.

Documents are dealt by ranges of doc_id, sorted, encoded and written by one task per range, under a name
that depends on the range alone: a task that runs again replaces its file by the same one. Only one row
per file goes to the driver.

The ids of a text are those the tokenizers library gives. The vocabulary's pre-tokenizer never joins
characters across white space, so the library is asked once for each distinct run of other characters
and the ids of a text are put together from those.

Defined results: null text is empty and holds the end id alone. Null doc_ids come first; rows of one
doc_id are ordered by the hash of their text and each keeps its own frame. An empty table gives no
files and no rows. Extra columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import io
import os
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import column, kept, lean, new_path, slices, table, tune

END_ID = 2
_INDEX, _SEEK, _FOOT = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Bytes of distinct parts, and of distinct runs in them, with their ids and an allowance for each, that a worker
#: remembers: the first ones, so common ones.
REMEMBER, ENTRY = 112 << 20, 130
#: Rows of a batch: the more, the fewer times a part is looked up.
BATCH_ROWS = 3000
#: Letters and marks whose runs the pre-tokenizer takes as one word, in lower case too. No apostrophe, and
#: no "<", which special tokens start with.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "!-&(-/:;=-@\\[-`{-~"
PLAIN = re.compile(f"[{_LETTERS}{_MARKS}]+")
RUNS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")


class Encoder:
    """Ids of whole texts as bytes, from the library's ids of their parts between white space.

    A part of plain letters and marks is cut further, into lower-cased runs each of which is one word of the
    vocabulary's pre-tokenizer: new runs go to the library many at a time, and its ids are cut apart where
    a token ends a word. Any other part goes to the library as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.parts: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.left = {"parts": REMEMBER, "runs": REMEMBER}

    def _keep(self, which: str, new: dict) -> bool:
        """Remember all of these, if there is room for them."""
        size = sum(map(len, new)) + sum(map(len, new.values())) + ENTRY * len(new)
        if size > self.left[which]:
            return False
        self.left[which] -= size
        getattr(self, which).update(new)
        return True

    def _ask(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs that are one word each."""
        out: dict[str, bytes] = {}
        groups = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.kind)
            cut = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()]
            raw = ids.tobytes()
            out.update((x, raw[a:b]) for x, a, b in zip(group, cut[:-1], cut[1:], strict=True))
        return out

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        plain, other = {}, []
        for p in new:
            text = p.decode()
            if PLAIN.fullmatch(text):
                plain[p] = RUNS.findall(text.lower())
            else:
                other.append((p, text))
        runs = self.runs
        fresh = self._ask(list({r for x in plain.values() for r in x if r not in runs}))
        if self._keep("runs", fresh):
            fresh = runs
        found = {p: b"".join([fresh[r] if r in fresh else runs[r] for r in x]) for p, x in plain.items()}
        for (p, _), got in zip(other, self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False), strict=True):
            found[p] = np.array(got.ids, self.kind).tobytes()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts one after the other, and where each text's ids start and end."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        told = cut.flatten().dictionary_encode()
        parts = told.dictionary.cast(pa.binary()).to_pylist()
        got = list(map(self.parts.get, parts))
        if None in got:
            found = self._learn({p for p, g in zip(parts, got, strict=True) if g is None})
            self._keep("parts", found)
            got = [found[p] if g is None else g for p, g in zip(parts, got, strict=True)]
        flat = np.frombuffer(b"".join(got), self.kind)
        size = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        which = told.indices.to_numpy()
        each = size[which]
        at = np.concatenate([[0], np.cumsum(each)])
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        ids = flat[np.repeat(first[which] - at[:-1], each) + np.arange(at[-1])]
        rows = cut.offsets.to_numpy().astype(np.int64)
        return ids, at[rows - rows[0]]


_ENCODERS: dict[str, Encoder] = kept(__name__)


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class Writer:
    """Writes documents to a binary stream; ``close`` adds the two tables."""

    def __init__(self, out, kind: np.dtype):
        self.out, self.kind = out, kind
        self.ids: list[int | None] = []
        self.table: list[tuple[int, int, int]] = []
        self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1, write_content_size=True)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.tokens += len(raw) // self.kind.itemsize

    def close(self) -> None:
        null = np.packbits([x is None for x in self.ids]).tobytes()
        ids = np.array([x or 0 for x in self.ids], "<i8").tobytes()
        self.out.write(_skippable(_INDEX, self.pack.compress(bytes([self.kind.itemsize]) + null + ids)))
        rows = np.array(self.table, "<u4").tobytes()
        self.out.write(_skippable(_SEEK, rows + struct.pack("<IBI", len(self.table), 0x80, _FOOT)))


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, src):
        self.src = src
        size = src.seek(0, 2)
        src.seek(size - 9)
        n, flags, foot = struct.unpack("<IBI", src.read(9))
        if foot != _FOOT or flags != 0x80:
            raise ValueError("not a seekable token file")
        at = size - 9 - 12 * n
        src.seek(at)
        self.table = np.frombuffer(src.read(12 * n), "<u4").reshape(n, 3)
        self.first = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.unpack = zstandard.ZstdDecompressor()
        src.seek(int(self.first[-1]))
        magic, length = struct.unpack("<II", src.read(8))
        if magic != _INDEX:
            raise ValueError("the document index is missing")
        body = self.unpack.decompress(src.read(length))
        self.kind = np.dtype("<u2" if body[0] == 2 else "<u4")
        nulls = -(-n // 8)
        self.null = np.unpackbits(np.frombuffer(body, np.uint8, nulls, 1), count=n).astype(bool)
        self.ids = np.frombuffer(body, "<i8", n, 1 + nulls)

    def raw(self, k: int) -> bytes:
        """The ids of frame k; decompresses that frame alone and checks it."""
        self.src.seek(int(self.first[k]))
        got = self.unpack.decompress(self.src.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(got) != self.table[k, 1] or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return got

    def document(self, k: int) -> np.ndarray:
        return np.frombuffer(self.raw(k), self.kind)

    def frames(self, doc_id: int) -> range:
        """The frames of a doc_id; ids are ascending behind the nulls."""
        base = int(self.null.sum())
        a, b = np.searchsorted(self.ids[base:], doc_id, "left"), np.searchsorted(self.ids[base:], doc_id, "right")
        return range(base + int(a), base + int(b))


def _store(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])
    return fs, path


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Encode ``text`` and write files into ``folder``; (path, documents, tokens) of each, in doc_id order."""
    spark = docs.sparkSession
    tune(spark)

    @lean
    def run(batches):
        task = TaskContext.get().partitionId()
        enc, out, fs, name, tmp, stream = _encoder(tokenizer), None, None, "", "", None
        end = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            if out is None:
                fs, base = _store(folder)
                fs.create_dir(base, recursive=True)
                name = f"{base}/part-{task:06d}.tok"
                tmp = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                stream = fs.open_output_stream(tmp)
                out = Writer(stream, enc.kind)
            for part in slices(batch, "text", 12 << 20):
                ids, at = enc.encode(column(part, "text"))
                raw, step = ids.tobytes(), enc.kind.itemsize
                for doc_id, a, b in zip(column(part, "doc_id").to_pylist(), (at[:-1] * step).tolist(), (at[1:] * step).tolist(), strict=True):
                    out.add(doc_id, raw[a:b] + end)
        if out is not None:
            out.close()
            stream.close()
            fs.move(tmp, name)
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([f"{folder}/part-{task:06d}.tok"]), pa.array([len(out.ids)], pa.int64()), pa.array([out.tokens], pa.int64())], names=["part", "path", "documents", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows_of = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_of)
    spark.conf.set(rows_of, str(BATCH_ROWS))
    try:
        files = dealt.mapInArrow(run, "part long, path string, documents long, tokens long").collect()
    finally:
        spark.conf.set(rows_of, before)
    return [(r.path, r.documents, r.tokens) for r in sorted(files, key=lambda r: r.part)]


def read(spark: SparkSession, files: Iterable[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (as little-endian unsigned 32-bit integers), in
    one task per file. ``files`` as ``write`` returns them."""
    rows, base = [], 0
    for path, _, tokens in files:
        rows.append((path, base))
        base += tokens
    listed = spark.createDataFrame(rows, "path string, base long")
    if len(rows) > 1:
        listed = listed.repartition(len(rows))

    @lean
    def run(batches):
        for batch in batches:
            for path, base in zip(column(batch, "path").to_pylist(), column(batch, "base").to_pylist(), strict=True):
                fs, place = _store(path)
                with fs.open_input_file(place) as src:
                    r, at = Reader(src), base
                    held: tuple[list, list, list] = ([], [], [])
                    size = 0
                    for k in range(len(r.table)):
                        ids = r.document(k).astype("<u4")
                        for x, v in zip(held, (None if r.null[k] else int(r.ids[k]), at, ids.tobytes()), strict=True):
                            x.append(v)
                        at += len(ids)
                        size += ids.nbytes
                        if size >= 4 << 20:
                            yield _rows(held)
                            held, size = ([], [], []), 0
                    if held[0]:
                        yield _rows(held)

    return listed.mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(held: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.binary())], names=["doc_id", "start", "ids"])


def lookup(path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of every row of a doc_id in one file; only their frames are decompressed."""
    fs, place = _store(path)
    with fs.open_input_file(place) as src:
        r = Reader(src)
        return [r.document(k) for k in r.frames(doc_id)]


def roundtrip(raw: list[tuple[int | None, np.ndarray]], kind: str = "<u2") -> bytes:
    """A file's bytes for some documents, without Spark."""
    out = io.BytesIO()
    w = Writer(out, np.dtype(kind))
    for doc_id, ids in raw:
        w.add(doc_id, np.asarray(ids, kind).tobytes())
    w.close()
    return out.getvalue()


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "tokens"))
    found = read(spark, files)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_file": op6_token_file}
ORACLES: dict[str, str] = {}
