"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints of 64 bits (or several 64-bit words) are cut into segments of at most 23 bits. The perfect
Golay code [23,12,7] decodes every segment to one codeword; the codewords of the segment itself and of
all its one-bit neighbours (one or six of them) are its keys, and two segments at most two bits apart
always share one, namely that of a segment between them. Four differing bits over three segments leave,
by pigeonhole, two segments with at most two errors together, so a key of each of two segments (24 bits)
meets every linked pair. Rows are dealt by that pair of keys; within a bin the distinct fingerprints are
verified by their exact distance and tied to each other by a spanning forest, never by all pairs.
Components of the verified links are found in the cluster by alternating stars.

Equal fingerprints are one node, so copies of any number cost one row per fingerprint after counting. A bin holds
different fingerprints alone, so a group of near copies fills it with as many rows as it has patterns of changed bits
(at most some 700,000 of four bits or fewer around one text), not with its documents.

``similar`` joins documents by the exact similarity (Jaccard) of their sets of word shingles. Documents of equal
sets are one node. First the nodes' fingerprints go through the same keys, bins and distance, and each node is
compared with the smallest of those linked to it: that brings most near copies together at one comparison a
node. What fingerprints can't see, since sets of similarity 0.8 differ in some ten bits of 64, an exact way
finds: two sets that alike share one of their rarest shingles at least (prefix filter; any order of shingles is
exact, the one used has the commonest last, by a table of counts of fixed size). Nodes that share such a
shingle are a bin. Bins are searched in rounds: some rows of each are compared with all others of another
component, those with most links first, and leave it, until each bin is empty or one component. So no pair
of that similarity is lost, none is joined without its sets having been compared, and nothing is capped. Pairs are compared by parities of their sets first (2,048 bits, which can only tell sets
apart that are), then by the sets.

Defined results: null or empty texts have fingerprint zero and link like any other. Rows with a null
doc_id take part in links but are never a component_id unless all of a component's ids are null (then it
is null). Repeated rows are kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._components import components
from tidemill.llm._packed import pack, ranges_of, unpack
from tidemill.llm._spark import Scratch, bounded, column, lean, slices, table, tune
from tidemill.llm._text import U64, cut, mix

SHINGLE, BITS, DISTANCE, SEED = 4, 64, 4, 42
PARITY = 2048
#: Generator of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0xAE3


def _remainders() -> np.ndarray:
    """x^i modulo the generator, for each of the 23 bits."""
    out = []
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= _GENERATOR << (j - 11)
        out.append(r)
    return np.array(out, np.uint32)


def _errors(rem: np.ndarray) -> np.ndarray:
    """The error of at most three bits that belongs to each of the 2048 syndromes."""
    out = np.zeros(2048, np.uint32)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            out[np.bitwise_xor.reduce(rem[list(bits)])] = sum(1 << b for b in bits)
    return out


class Golay:
    def __init__(self):
        rem = _remainders()
        self.error = _errors(rem)
        self.low, self.high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
        for b in range(12):
            self.low[np.arange(1 << 12) >> b & 1 == 1] ^= rem[b]
        for b in range(11):
            self.high[np.arange(1 << 11) >> b & 1 == 1] ^= rem[12 + b]

    def index(self, x: np.ndarray) -> np.ndarray:
        """The 12 data bits of the codeword nearest to each 23-bit number."""
        return (x ^ self.error[self.low[x & 0xFFF] ^ self.high[x >> 12]]) >> 11

    def keys(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, whether they count): the distinct indices around each number of ``width`` bits, smallest first."""
        near = np.concatenate([x[:, None], x[:, None] ^ (np.uint32(1) << np.arange(width, dtype=np.uint32))[None, :]], axis=1)
        k = np.sort(self.index(near), axis=1)
        new = np.ones_like(k, bool)
        new[:, 1:] = k[:, 1:] != k[:, :-1]
        most = int(new.sum(1).max(initial=1))
        order = np.argsort(~new, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(k, order, 1), np.take_along_axis(new, order, 1)


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: the fewest of at most 22 bits, nearly equal."""
    n = -(-bits // 22)
    cut = [round(bits * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def pairs(bits: int) -> list[tuple[int, int]]:
    """The pairs of segments that give keys: neighbours in a ring, which for three segments are all pairs."""
    n = len(segments(bits))
    return sorted({tuple(sorted((i, (i + 1) % n))) for i in range(n)})


def _segment(fp: list[np.ndarray], first: int, width: int) -> np.ndarray:
    w, b = divmod(first, 64)
    x = fp[w] >> np.uint64(b)
    if b + width > 64:
        x = x | (fp[w + 1] << np.uint64(64 - b))
    return (x & np.uint64((1 << width) - 1)).astype(np.uint32)


def _shingles(text: str | None, shingle: int):
    """XXH64 of each word shingle (of the whole sequence, if it has fewer words), a long text in pieces."""
    raw = b" ".join((text or "").encode().lower().split())
    if not raw:
        return
    gap = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    first, last = [0, *(gap + 1).tolist()], [*gap.tolist(), len(raw)]
    k = min(shingle, len(first))
    n = len(first) - k + 1
    for a in range(0, n, 1 << 16):
        b = min(a + (1 << 16), n)
        yield np.array([xxhash.xxh64_intdigest(raw[s:e], SEED) for s, e in zip(first[a:b], last[a + k - 1 : b + k - 1], strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, bits: int = BITS) -> list[int]:
    """The fingerprint's 64-bit words: the first from each shingle's XXH64, others from that number mixed again."""
    ones, n = np.zeros((bits // 64, 64), np.int64), 0
    for h in _shingles(text, shingle):
        n += len(h)
        for word in range(bits // 64):
            if word:
                h = mix(h + U64(0x9E3779B97F4A7C15))
            ones[word] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [sum(1 << j for j in np.flatnonzero(2 * x > n).tolist()) for x in ones]


def _names(bits: int) -> list[str]:
    return [f"f{i}" for i in range(bits // 64)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, rid (hash of the text) and the fingerprint's words f0, f1, ... (as signed 64-bit numbers)."""
    tune(docs.sparkSession)
    names = _names(bits)

    @lean
    def run(batches):
        for batch in batches:
            got = [fingerprint(t, shingle, bits) for t in column(batch, "text").to_pylist()]
            cols = [pa.array(np.array([g[i] for g in got], np.uint64).view(np.int64)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "rid"), *cols], names=["doc_id", "rid", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, rid long, " + ", ".join(f"{n} long" for n in names))


def _keys(bits: int, carry: list[str]):
    """Each distinct fingerprint (the words in ``carry``) with every pair of its segments' keys."""
    cuts, use = segments(bits), pairs(bits)
    names = _names(bits)

    @lean
    def run(batches):
        golay = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fp = [column(part, n).to_numpy().view(np.uint64) for n in names]
                seg = [golay.keys(_segment(fp, *c), c[1]) for c in cuts]
                rows, keys = [], []
                for p, (i, j) in enumerate(use):
                    (a, oka), (b, okb) = seg[i], seg[j]
                    ok = oka[:, :, None] & okb[:, None, :]
                    both = (a[:, :, None].astype(np.int64) << 12 | b[:, None, :]) + (p << 24)
                    rows.append(np.nonzero(ok)[0])
                    keys.append(both[ok])
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(f.view(np.int64)[row]) for f in fp[: len(carry)])], names=["key", *carry])

    return run


def _apart(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(x ^ y).astype(np.int64) for x, y in zip(a, b, strict=True))


def forest(fp: list[np.ndarray], most: int) -> list[tuple[int, int]]:
    """Links that join the same rows as all pairs at most ``most`` bits apart: one for each row reached."""
    left = np.arange(len(fp[0]))
    out = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _apart([f[left] for f in fp], [f[x : x + 1] for f in fp]) <= most
            out += [(x, int(y)) for y in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return out


def _link(names: list[str], most: int, short: int = 12):
    """Links within each bin by distance. Rows come sorted by key; short bins are compared all at once."""

    def done(key, fp):
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([new, [len(key)]]))
        of = np.repeat(size, size)
        a, b = [], []
        for lag in range(1, min(short, int(size.max(initial=1)))):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & (of[lag:] <= short))
            i = i[_apart([f[i] for f in fp], [f[i + lag] for f in fp]) <= most]
            a.append(i)
            b.append(i + lag)
        for s, n in zip(new[size > short].tolist(), size[size > short].tolist(), strict=True):
            ties = forest([f[s : s + n] for f in fp], most)
            a.append(np.array([s + x for x, _ in ties], np.int64))
            b.append(np.array([s + y for _, y in ties], np.int64))
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(i):
            both = np.unique(np.stack([*(f[i] for f in fp), *(f[j] for f in fp)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in both], names=[*(f"a{n}" for n in names), *(f"b{n}" for n in names)])

    @lean
    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [column(batch, "key").to_numpy(), *(column(batch, n).to_numpy().view(np.uint64) for n in names)]
            held.append(now)
            rows += batch.num_rows
            if rows < 1 << 17 or now[0][-1] == held[0][0][0]:
                continue
            key, *fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))  # the last bin may go on in the next batch
            if cut:
                yield from done(key[:cut], [f[:cut] for f in fp])
            held, rows = [[key[cut:], *(f[cut:] for f in fp)]], len(key) - cut
        if held:
            key, *fp = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from done(key, fp)

    return run


def _links(nodes: DataFrame, bits: int, most: int, carry: list[str]) -> DataFrame:
    """Links (a f0, ..., b f0, ...) between distinct fingerprints that share a bin, at most ``most`` bits of
    the carried words apart."""
    keyed = nodes.select(*_names(bits)).mapInArrow(_keys(bits, carry), "key long, " + ", ".join(f"{n} long" for n in carry))
    schema = ", ".join(f"{s}{n} long" for s in "ab" for n in carry)
    return keyed.repartition("key").sortWithinPartitions("key", *carry).mapInArrow(_link(carry, most), schema)


def _grouped(scratch: Scratch, found: DataFrame, nodes: DataFrame, root: DataFrame, names: list[str]) -> DataFrame:
    """Every row of ``found`` with its component: root (a node) and component_id; root: (u, root) of nodes."""
    roots = nodes.join(root.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = scratch.put("roots", roots)
    least = scratch.put("least", roots.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = scratch.put("classes", roots.join(least, "root").select(*names, "root", "component_id"))
    return found.join(classes, names)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, rid, the fingerprint f0, and component_id: the smallest doc_id reachable over links of at most
    ``DISTANCE`` bits, all of which are found."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.put("fingerprints", fingerprints(docs))
    nodes = scratch.put("nodes", found.groupBy("f0").agg(F.min("doc_id").alias("least"))).withColumn("node", F.col("f0"))
    links = _links(nodes, BITS, DISTANCE, ["f0"])
    edges = links.select(F.greatest("af0", "bf0").alias("u"), F.least("af0", "bf0").alias("v")).where("u > v")
    out = _grouped(scratch, found, nodes, components(scratch, edges), ["f0"])
    return scratch.last("near", out.select("doc_id", "rid", "f0", "component_id"))


def _near(similarity: float):
    """The pairs whose sets may have at least that Jaccard similarity by their parities."""

    @lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bu", "bv"))
                apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
                n = column(batch, "nu").to_numpy() + column(batch, "nv").to_numpy()
                yield batch.select(["u", "v"]).filter(pa.array(apart * (1 + similarity) <= (1 - similarity) * n + 1e-6))

    return run


def _alike(similarity: float):
    """The rows whose two shingle sets have at least that Jaccard similarity."""

    @lean
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "su"), column(batch, "sv"), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(b, a), len(b) - 1) if len(b) else a
                both = int((b[at] == a).sum()) if len(b) else 0
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def shingle_sets(col: pa.Array, shingle: int) -> list[np.ndarray]:
    """For each text the distinct word shingles (the whole sequence, if it has fewer words) as sorted 64-bit hashes,
    mixed from the XXH64 of their lower-cased words."""
    which, words, rows = cut(col)
    word = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)[which]

    def run(first: np.ndarray, count: int, n: int) -> np.ndarray:
        x = mix(first + U64(count))
        for j in range(1, count):
            x = mix(x * U64(0x9E3779B97F4A7C15) ^ word[j + at : j + at + n])
        return x

    at = 0
    n = max(0, len(word) - shingle + 1)
    every = run(word[:n], shingle, n)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(every[a : b - shingle + 1]))
        elif a == b:
            out.append(np.zeros(0, np.uint64))
        else:
            at = a
            out.append(run(word[a : a + 1], b - a, 1))
    return out


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of some hashes: a bit is 1 if set in over half of them."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def parity(hashes: np.ndarray) -> bytes:
    """``PARITY`` bits, each the parity of how many hashes fall to it: two sets differ in at least as many elements as
    their parities in bits."""
    n = np.bincount(hashes & U64(PARITY - 1), minlength=PARITY)
    return np.packbits(n & 1).tobytes()


def _i64(x: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


_SKETCH = "doc_id long, rid long, node long, n long, f0 long, b binary, part int"


def _sketches(shingle: int):
    """doc_id, rid, node (XXH64 of the set), n (its size), f0 (its fingerprint) and b (its parities). After a task's rows come
    16 with a part each of how often shingles of each bucket (the hash's first 16 bits) stand in its sets (as b)."""

    @lean
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                got = shingle_sets(column(part, "text"), shingle)
                total += np.bincount(np.concatenate([*got, np.zeros(0, np.uint64)]) >> U64(48), minlength=1 << 16)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "rid"), _i64([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in got]), pa.array([len(s) for s in got], pa.int64()), _i64([majority(s) for s in got]), pa.array([parity(s) for s in got], pa.binary()), pa.nulls(len(got), pa.int32())],
                    names=["doc_id", "rid", "node", "n", "f0", "b", "part"],
                )
        none = pa.nulls(16, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array([x.tobytes() for x in total.reshape(16, -1)], pa.binary()), pa.array(range(16), pa.int32())], names=["doc_id", "rid", "node", "n", "f0", "b", "part"])

    return run


def _common(parts: DataFrame) -> np.ndarray:
    """The sums of all tasks' counts: 2^16 numbers, whatever the corpus."""

    @lean
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(column(batch, "part").to_pylist(), column(batch, "b"), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "b"])

    out = np.zeros((16, 1 << 12), np.int64)
    for r in parts.repartition(16, "part").mapInArrow(add, "part int, b binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["b"]), np.int64)
    return out.ravel()


def _sets(shingle: int):
    """node and the bytes of its set, from its text."""

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([column(part, "node"), pa.array([s.tobytes() for s in shingle_sets(column(part, "text"), shingle)], pa.binary())], names=["node", "s"])

    return run


#: Entries that a task holds before it packs them, and entries of a range of hashes.
FLUSH = RANGE = 1 << 20
_MARK = 0xFFFFFFFF


def _prefixes(shingle: int, common, similarity: float, ranges: int):
    """Each text's rarest shingles with node, size and place (pos). Sets alike share ceil(similarity * n) shingles of the
    larger at least, hence one of the n - ceil(similarity * n) + 1 that come first in any order that is the same for
    all. Rows (part, raw): shingles that several nodes of a task's share hold are known to be shared and go as part -1
    - share; they send one mark, others their only entry, to their range of hashes. So a range gets at most one
    entry of a shingle from each share, however many nodes hold it."""

    @lean
    def run(batches):
        share, size = TaskContext.get().partitionId() << 24, 0
        held: list[list[np.ndarray]] = []

        def packed():
            h, node, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((node, h))
            h, node, n, pos = h[order], node[order], n[order], pos[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])  # a node's copies have the same entries
            h, node, n, pos = h[new], node[new], n[new], pos[new]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(first, len(h)))
            many = np.repeat(count, count) > 1
            parts, raws = [], []
            if many.any():
                parts.append(-1 - share)
                raws.append(pack(h[many], node[many], n[many], pos[many]))
            h, node, n, pos = h[first], node[first], n[first], np.where(count > 1, np.uint32(_MARK), pos[first]).astype("<u4")
            for k, a, b in ranges_of(h, ranges):
                parts.append(k)
                raws.append(pack(h[a:b], node[a:b], n[a:b], pos[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(raws, pa.binary())], names=["part", "raw"])

        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                for s in shingle_sets(column(part, "text"), shingle):
                    n, node = len(s), np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)
                    first = np.lexsort((s, common.value[s >> U64(48)]))[: n - math.ceil(similarity * n - 1e-9) + 1]
                    held.append([s[first], np.full(len(first), node, "<i8"), np.full(len(first), n, "<u4"), np.arange(len(first), dtype="<u4")])
                    size += len(first)
                if size > FLUSH:
                    yield packed()
                    held, size, share = [], 0, share + 1
        if size:
            yield packed()

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """(bin, node, n, pos) of the shingles of a part that several nodes hold."""
    h, node, n, pos = (np.concatenate(x) for x in zip(*(unpack(x.as_buffer(), "<u8", "<i8", "<u4", "<u4") for c in rows["raw"].chunks for x in c), strict=True))
    if rows["part"][0].as_py() >= 0:
        order = np.lexsort((node, h))
        h, node, n, pos = h[order], node[order], n[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        several = (node[first] != node[first + size - 1]) | np.logical_or.reduceat(pos == _MARK, first)
        keep = np.repeat(several, size) & (pos != _MARK)
        h, node, n, pos = h[keep], node[keep], n[keep], pos[keep]
    return pa.table({"bin": h.view(np.int64), "node": node.astype(np.int64), "n": n.astype(np.int64), "pos": pos.astype(np.int64)})


def _may(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles may be alike whose first common shingle is the pos-th and at-th: no more than
    what follows it can be shared. (Sets alike always meet in the bin of their first common shingle.)"""
    return np.minimum(n - pos, m - at) * (1 + similarity) >= similarity * (n + m) - 1e-6


def _stars(many: int, similarity: float):
    """Rows sorted by bin: pairs (null, u, v) of the first ``many`` rows of each bin with all others of it that
    lie in another component and may be alike, and the rows after them (bin, node, null)."""
    names = ("bin", "node", "comp", "n", "pos")

    @lean
    def run(batches):
        head = [np.zeros(0, np.int64)] * len(names)  # the first rows of the bin that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(head[0])
            key, node, comp, n, pos = every = [np.concatenate([h, column(batch, c).to_numpy()]) for h, c in zip(head, names, strict=True)]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            start = np.repeat(first, size)
            rank = np.arange(len(key)) - start
            fresh = np.arange(len(key)) >= old
            u, v = [], []
            for j in range(min(many, int(size.max()) - 1)):
                i = np.flatnonzero(fresh & (rank > j))
                k = start[i] + j
                ok = (comp[i] != comp[k]) & _may(n[i], pos[i], n[k], pos[k], similarity)
                u.append(node[i[ok]])
                v.append(node[k[ok]])
            if sum(map(len, u)):
                u, v = np.concatenate(u), np.concatenate(v)
                u, v = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
                for a in range(0, len(u), 50_000):
                    m = len(u[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(u[a : a + 50_000]), pa.array(v[a : a + 50_000]), *(pa.nulls(m, pa.int64()) for _ in range(2))], names=["bin", "u", "v", "n", "pos"])
            i = np.flatnonzero(fresh & (rank >= many))
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(node[i]), pa.nulls(len(i), pa.int64()), pa.array(n[i]), pa.array(pos[i])], names=["bin", "u", "v", "n", "pos"])
            head = [x[first[-1] : first[-1] + many] for x in every]

    return run


def _proposed(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(u, v): each node with the smallest of those whose fingerprints are ``DISTANCE`` bits apart at most, or with
    the smallest of an equal fingerprint. One pair a node at most."""
    prints = scratch.put("prints", nodes.groupBy("f0").agg(F.min("node").alias("node")))
    ties = _links(prints, BITS, DISTANCE, ["f0"])
    ties = ties.groupBy(F.greatest("af0", "bf0").alias("a")).agg(F.min(F.least("af0", "bf0")).alias("b")).where("a > b")
    ties = scratch.put("ties", ties)
    a, b = (prints.select(F.col("f0").alias(x), F.col("node").alias(f"n{x}")) for x in "ab")
    near = ties.join(a, "a").join(b, "b").select("na", "nb")
    same = nodes.select(F.col("node").alias("na"), F.col("f0").alias("b")).join(b, "b").where("na <> nb").select("na", "nb")
    pairs = scratch.put("proposed", near.unionByName(same).select(F.greatest("na", "nb").alias("u"), F.least("na", "nb").alias("v")).distinct())
    scratch.drop("prints", "ties")
    return pairs


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, rid, root (one number for each component) and component_id: the smallest doc_id reachable over
    pairs of documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Documents of equal shingle sets (a 64-bit hash of the whole set) are one node; no two others are joined
    unless their sets have been compared.
    """
    tune(docs.sparkSession)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), F.col("text").cast("string").alias("text"))
    every = scratch.put("sketches", rows.mapInArrow(_sketches(shingle), _SKETCH).withColumn("uid", F.monotonically_increasing_id()))
    counts = _common(every.where("part is not null").select("part", "b"))
    every = every.where("part is null")
    found = every.select("doc_id", "rid", "node")
    nodes = scratch.put("nodes", every.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("f0").alias("f0"), F.min("uid").alias("uid")))

    # Bins of the exact way: shingles that stand in the prefixes of several nodes.
    common = spark.sparkContext.broadcast(counts)
    ranges = 1 + int(counts.sum() * (1 - similarity)) // RANGE
    packed = rows.select("text").mapInArrow(_prefixes(shingle, common, similarity, ranges), "part long, raw binary")
    shared = packed.groupBy("part").applyInArrow(_shared, "bin long, node long, n long, pos long")
    left = scratch.put("bins", shared.groupBy("bin", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos")))
    scratch.release()

    def ends(some: DataFrame, *columns: str) -> DataFrame:
        """The pairs with these columns (n and b, or the set s) of both their nodes, of one row each."""
        both = some.select(F.col("u").alias("node")).unionByName(some.select(F.col("v").alias("node"))).distinct()
        asked = scratch.put("asked", both.join(nodes, "node").select("uid"))
        told = every.join(bounded(asked, 16), "uid", "left_semi")
        if columns == ("s",):
            stand = scratch.put("stand", told.select("node", F.col("doc_id").alias("stand_id"), F.col("rid").alias("stand_rid")))
            same = F.col("doc_id").eqNullSafe(F.col("stand_id")) & (F.col("rid") == F.col("stand_rid"))
            told = rows.join(bounded(stand, 40), same).select("node", "text").mapInArrow(_sets(shingle), "node long, s binary").groupBy("node").agg(F.first("s").alias("s"))
        told = scratch.put("ends", told.select("node", *columns))
        for x in "uv":
            some = some.join(told.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in columns)), x)
        return some

    def settle(name: str, some: DataFrame) -> DataFrame:
        near = scratch.put("near", ends(some, "n", "b").mapInArrow(_near(similarity), "u long, v long"))
        scratch.drop("asked", "ends")
        found = scratch.put(name, ends(near, "s").select("u", "v", "su", "sv").mapInArrow(_alike(similarity), "u long, v long"))
        scratch.drop("asked", "stand", "ends", "near")
        scratch.release()
        return found

    tried = _proposed(scratch, nodes)
    links = settle("links0", tried)
    root = components(scratch, links)
    many, k = 4, 0
    while True:
        k += 1
        tied = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
        told = left.join(root.withColumnRenamed("u", "node"), "node", "left").join(tied.groupBy("node").agg(F.count("*").alias("ties")), "node", "left")
        told = scratch.put(f"told{k}", told.select("bin", "node", "n", "pos", F.coalesce("root", "node").alias("comp"), F.coalesce("ties", F.lit(0)).alias("ties")))
        if k > 1:
            apart = told.groupBy("bin").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("bin")
            told = told.join(scratch.put(f"apart{k}", apart), "bin", "left_semi")
        stars = told.repartition("bin").sortWithinPartitions("bin", F.desc("ties"), "node").mapInArrow(_stars(many, similarity), "bin long, u long, v long, n long, pos long")
        stars = scratch.put(f"stars{k}", stars)
        scratch.drop(f"told{k}", *([f"apart{k}"] if k > 1 else []))
        left = stars.where("bin is not null").select("bin", F.col("u").alias("node"), "n", "pos")
        pairs = stars.where("bin is null").select("u", "v").distinct()
        pairs = scratch.put(f"pairs{k}", pairs.join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionByName(pairs)
        more = settle(f"links{k}", pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            root = components(scratch, root.select("u", F.col("root").alias("v")).unionByName(more))
        if left.isEmpty():
            break
        if k > 1:
            scratch.drop(f"stars{k - 1}")
        many = min(16 * many, 1024)
    return scratch.last("similar", _grouped(scratch, found, nodes, root, ["node"]).select("doc_id", "rid", "root", "component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, with one row of each group of near duplicates (see ``similar``): that of the
    smallest doc_id, of one doc_id's rows that with the smallest hash of the text. A null id comes last."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(x)]) for x in ("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")
    stay = similar(docs, shingle, similarity).groupBy("root").agg(first).select("first.doc_id", "first.rid")
    stay = Scratch(docs.sparkSession).put("stay", stay.select(F.col("doc_id").alias("stay_id"), F.col("rid").alias("stay_rid")))
    rows = docs.toDF(*names).withColumns({"own_id": doc_id.cast("long"), "own_rid": F.xxhash64(text.cast("string"))})
    once = rows.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_rid") == F.col("stay_rid")), "left_semi")
    return once.dropDuplicates(["own_id", "own_rid"]).select(*names).toDF(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
