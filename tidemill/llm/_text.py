"""Words of whole Arrow text columns as numpy arrays, and hashes of words and word windows.

Texts stay UTF-8 bytes. Both word classes used here are closed under UTF-8 (every byte of a
character outside ASCII is a word byte), so words can be cut byte by byte.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    buf: np.ndarray  #: bytes of all rows, lower-cased if asked for
    first: np.ndarray  #: byte where each word starts
    last: np.ndarray  #: byte after each word
    row: np.ndarray  #: index of the first word of each row, with the total at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), self.counts)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive), joined by one space."""
        return b" ".join(self.buf[self.first[i] : self.last[i]].tobytes() for i in range(a, b))


def words(col: pa.Array, kind: np.ndarray, lower: bool = False) -> Words:
    buf, off = buffers(col)
    if lower:
        buf = LOWER[buf]
    is_word = kind[buf]
    before = np.empty_like(is_word)
    before[1:] = is_word[:-1]
    starts = off[:-1][off[:-1] < len(buf)]
    if len(buf):
        before[0] = False
        before[starts] = False
    first = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[:-1] = is_word[1:]
    if len(buf):
        after[-1] = False
        after[(e := off[1:][off[1:] > 0]) - 1] = False
    last = np.flatnonzero(is_word & ~after) + 1
    return Words(buf, first, last, np.searchsorted(first, off))


@lru_cache(maxsize=8)
def _secrets(seed: int) -> tuple[np.ndarray, int]:
    """A table of 256 numbers and an odd base, both from the seed."""
    raw = hashlib.shake_256(f"tidemill{seed}".encode()).digest(8 * 257)
    x = np.frombuffer(raw, np.uint64)
    return x[:256].copy(), (int(x[256]) & ~7) | 5


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, U64(b))
            x[0] = 1
            out.append(np.cumprod(x))
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(w: Words, seed: int = 1, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word's bytes, worked out in blocks so that long texts need little memory."""
    table, base = _secrets(seed)
    out = np.empty(len(w.first), np.uint64)
    for a in range(0, len(out), block):
        b = min(a + block, len(out))
        s, e = w.first[a:b], w.last[a:b]
        lo = int(s[0])
        up, down = powers(base, int(e[-1]) - lo + 1)
        total = np.zeros(int(e[-1]) - lo + 1, np.uint64)
        np.cumsum(table[w.buf[lo : int(e[-1])]] * up[:-1], out=total[1:])
        out[a:b] = mix((total[e - lo] - total[s - lo]) * down[s - lo] + (e - s).astype(np.uint64))
    return out


class Windows:
    """Hashes of runs of consecutive words, from one running sum."""

    def __init__(self, hashes: np.ndarray, seed: int = 1):
        _, base = _secrets(seed + 1000)
        up, self.down = powers(base, len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.total[1:])

    def of(self, first: np.ndarray, length) -> np.ndarray:
        return mix((self.total[first + length] - self.total[first]) * self.down[first] + np.asarray(length).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.total) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.total[length:] - self.total[:n]) * self.down[:n] + U64(length))


def word_hash(word: bytes, seed: int = 1) -> int:
    w = Words(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), np.array([0, 1]))
    return int(word_hashes(w, seed)[0])


def fits(w: Words, length: int) -> np.ndarray:
    """For each word whether a window of that many words starts there and stays in its row."""
    end = np.repeat(w.row[1:], w.counts)
    return np.arange(len(w.first)) + length <= end


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of ``width`` values."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def cut(col: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A-Z lower-cased and cut at white space: which word stands at each place, the distinct words, and where
    each text starts (and the last ends)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(col, "")))
    flat, rows = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    rows = rows - rows[0]
    told = flat.dictionary_encode()
    which, words = told.indices.to_numpy().astype(np.int64), told.dictionary.cast(pa.binary()).to_pylist()
    if b"" in words:  # white space at the ends of a text gives empty words
        void = words.index(b"")
        keep = which != void
        rows = np.concatenate([[0], np.cumsum(keep)])[rows]
        which = which[keep]
    return which, words, rows
