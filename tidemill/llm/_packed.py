"""Columns of one length as compressed bytes, for shuffles of many small rows in few large ones."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from tidemill.llm._text import U64



def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, the first of ascending 64-bit numbers, byte plane by byte plane."""
    first, *more = columns
    planes = [np.diff(first, prepend=U64(0)), *more]
    body = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in planes)
    return struct.pack("<Q", len(first)) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(raw, *kinds: str) -> list[np.ndarray]:
    raw = bytes(raw)
    n = struct.unpack_from("<Q", raw)[0]
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=max(1, n * sum(np.dtype(k).itemsize for k in kinds))), np.uint8)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def ranges_of(key: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of ascending keys: ranges of equal width of the keys' upper 32 bits."""
    k = ((key >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    new = np.flatnonzero(np.diff(k, prepend=-1))
    return list(zip(k[new].tolist(), new.tolist(), [*new[1:].tolist(), len(key)], strict=True))
