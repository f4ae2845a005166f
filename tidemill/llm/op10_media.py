"""Media columns: payloads kept losslessly in progressive JPEGs, decoded to full-resolution RGB tensors.

A payload byte is one quantised coefficient of an 8 x 8 block (three components, 4:2:0, so 4 + 1 + 1 blocks a
unit): 256 + b as the DC, and b (if 128 or more) or b - 255 as an AC coefficient, so that all AC coefficients
have the same magnitude class, either sign, and mean 0. Nothing is lost: JPEG loses only in quantising, which is
done by tables of ones here. The file is a progressive one: a DC scan by successive approximation (one first
pass and a bit plane each pass), and for each component spectral bands of AC coefficients, each with a first
pass and a refinement pass. A comment segment holds the number of payload bytes; padding beyond the payload is
byte 0. A picture is 64 units wide, or as wide as it takes to keep its height within the format's limit (6.4 GB
of payload; a Spark string holds at most 2 GB).

The decoder accumulates the scans of any baseline-precision progressive JPEG with Huffman coding, no
restart markers and the component count of a greyscale or colour picture into coefficient arrays. Scans in
which all symbols are alike (as those written here) are taken apart by numpy at once; others go symbol by
symbol. Then it inverse-transforms in numpy, upsamples chroma by repetition, and stores an RGB tensor.

Defined results: null text is empty; its payload is 576 bytes of 255. Equal texts have equal values. Rows
are treated one by one, so ties, repeated rows and empty tables need no rule; extra columns are ignored.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import column, lean, slices, table, tune

UNIT, PAD = 576, 255
#: Spectral bands of the AC scans.
BANDS = ((1, 5), (6, 63))
#: Order of a block's coefficients in a scan: index in the zigzag -> row * 8 + column.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))
_MCU_WIDE, _MCU_HIGH = 64, 4095  # units in a row of blocks, and rows at most
_BASE = 256


def padded(raw: bytes) -> bytes:
    """The payload: raw and bytes 255 up to a positive multiple of 576."""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + bytes([PAD]) * (size - len(raw))


# ---- writing -------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int]) -> bytes:
    """A Huffman table in which symbol i has a code of i + 1 bits: 0, 10, 110, ..."""
    counts = [1 if i < len(symbols) else 0 for i in range(16)]
    return _segment(0xC4, bytes([kind, *counts, *symbols]))


def _scan(components: list[int], first: int, last: int, high: int, low: int, bits: np.ndarray | bytes) -> bytes:
    """A scan of bits, or of whole bytes."""
    head = bytes([len(components), *(x for c in components for x in (c, 0)), first, last, high << 4 | low])
    if not isinstance(bits, bytes):
        bits = np.packbits(np.concatenate([bits, np.ones((-len(bits)) % 8, np.uint8)])).tobytes()
    return _segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def _layout(size: int) -> tuple[int, int]:
    """Units across and down for so many payload bytes (384 a unit)."""
    units = -(-size // 384)
    wide = min(units, max(_MCU_WIDE, -(-units // _MCU_HIGH)))
    return wide, -(-units // wide)


def _orders(wide: int, high: int) -> np.ndarray:
    """For luma, the raster index of each block in the order of units (4 blocks each)."""
    y, x = np.divmod(np.arange(wide * high), wide)
    return ((2 * y[:, None] + np.array([0, 0, 1, 1])) * (2 * wide) + 2 * x[:, None] + np.array([0, 1, 0, 1])).ravel()


def _eob(blocks: int) -> np.ndarray:
    """Code and extra bits of one end-of-band run over so many blocks, with the table of ``encode``."""
    r = blocks.bit_length() - 1
    code = [1] * r + [0]
    return np.array(code + [blocks - (1 << r) >> k & 1 for k in reversed(range(r))], np.uint8)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload."""
    wide, high = _layout(len(payload))
    units = wide * high
    data = np.zeros(units * 384, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(units, 6, 64)
    luma = np.empty((units * 4, 64), np.uint8)
    luma[_orders(wide, high)] = data[:, :4].reshape(-1, 64)
    parts = [luma, data[:, 4], data[:, 5]]  # blocks in raster order, coefficients in zigzag order
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload)))]
    out.append(_segment(0xDB, bytes([0] + [1] * 64)))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # DC: all values are 256 + b, so the pass above bit 8 has one difference of 1 a component, then zeros.
    out.append(_table(0x00, [0, 1]))
    dc = data[:, :, 0]
    bits = np.zeros((units, 6), np.uint8)
    extra = np.concatenate([[1, 0, 1], bits[0, 1:4], [1, 0, 1], [1, 0, 1], bits[1:].ravel()]).astype(np.uint8)
    out.append(_scan([1, 2, 3], 0, 0, 0, 8, extra))
    for low in range(7, -1, -1):
        out.append(_scan([1, 2, 3], 0, 0, low + 1, low, (dc >> low & 1).astype(np.uint8).ravel()))
    # AC: first passes hold values of exactly 7 bits behind a code of one, refinements one bit a coefficient.
    out.append(_table(0x10, [0x07]))
    for c, blocks in enumerate(parts):
        for a, b in BANDS:
            out.append(_scan([c + 1], a, b, 0, 1, (blocks[:, a : b + 1] >> 1).tobytes()))
    out.append(_table(0x10, [r << 4 for r in range(15)]))
    for c, blocks in enumerate(parts):
        for a, b in BANDS:
            plane = blocks[:, a : b + 1]
            plane = plane & 1 ^ (plane < 128)  # the magnitude's last bit
            runs = [x for i in range(0, len(plane), 32767) for x in (_eob(min(32767, len(plane) - i)), plane[i : i + 32767].ravel())]
            out.append(_scan([c + 1], a, b, 1, 0, np.concatenate(runs)))
    out.append(b"\xff\xd9")
    return b"".join(out)


# ---- reading -------------------------------------------------------------------------------------


class _Bits:
    """The bits of one scan, by position."""

    def __init__(self, data: bytes):
        self.raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        self.at = 0

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(self.raw)

    def take(self, n: int) -> int:
        if not n:
            return 0
        x = self.bits[self.at : self.at + n]
        if len(x) < n:
            raise ValueError("the scan ends early")
        self.at += n
        return int("".join(map(str, x.tolist())), 2)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("not a code of the table")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _signed(x: int, n: int) -> int:
    return x if not n or x >> (n - 1) else x - (1 << n) + 1


class Picture:
    """Coefficient arrays of a progressive JPEG (blocks in raster order, coefficients in zigzag order)."""

    def __init__(self, raw: bytes):
        self.comment = b""
        self._known: dict[tuple, list] = {}
        self.quant: dict[int, np.ndarray] = {}
        tables: dict[int, dict] = {}
        at = 2
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0] if raw[at + 1] != 0xD9 else 0
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xD9:
                break
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : n + 1], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body[n + 1 :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                end = at
                while not (raw[(end := raw.index(b"\xff", end)) + 1] and raw[end + 1] != 0xFF):
                    end += 1 if raw[end + 1] == 0xFF else 2
                self._scan(body, _Bits(raw[at:end]), tables)
                at = end
            elif 0xC0 <= marker <= 0xCF or marker == 0xDD:
                raise ValueError(f"unsupported segment {marker:02x}")

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        spec = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        self.ids = [s[0] for s in spec]
        self.h, self.v = [s[1] >> 4 for s in spec], [s[1] & 15 for s in spec]
        self.tq = [s[2] for s in spec]
        self.hmax, self.vmax = max(self.h), max(self.v)
        self.mx, self.my = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.across = [self.mx * h for h in self.h]
        self.coef = [np.zeros((self.mx * h * self.my * v, 64), np.int32) for h, v in zip(self.h, self.v, strict=True)]
        # Blocks that a scan of one component covers: those that hold samples of the picture.
        self.own = []
        for h, v, across in zip(self.h, self.v, self.across, strict=True):
            w = -(-(-(-self.width * h // self.hmax)) // 8)
            t = -(-(-(-self.height * v // self.vmax)) // 8)
            self.own.append((np.arange(t)[:, None] * across + np.arange(w)).ravel())

    def _order(self, parts: list[int]) -> list[tuple[int, np.ndarray]]:
        """Component and block of each place of an interleaved scan, as one array for each block of a unit."""
        if tuple(parts) in self._known:
            return self._known[tuple(parts)]
        out = self._known[tuple(parts)] = []
        y, x = np.divmod(np.arange(self.mx * self.my), self.mx)
        for c in parts:
            for j in range(self.v[c]):
                for i in range(self.h[c]):
                    out.append((c, (y * self.v[c] + j) * self.across[c] + x * self.h[c] + i))
        return out

    def _scan(self, body: bytes, bits: _Bits, tables: dict) -> None:
        n = body[0]
        parts = [self.ids.index(body[1 + 2 * i]) for i in range(n)]
        picks = [body[2 + 2 * i] for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if first == 0:
            order = self._order(parts) if n > 1 else [(parts[0], self.own[parts[0]])]
            if high:
                self._dc_more(order, low, bits)
            else:
                self._dc(order, low, bits, {c: tables[p >> 4] for c, p in zip(parts, picks, strict=True)})
        else:
            c, codes = parts[0], tables[0x10 | picks[0] & 15]
            if high:
                self._ac_more(c, first, last, low, bits, codes)
            elif not self._ac_alike(c, first, last, low, bits, codes):
                self._ac(c, first, last, low, bits, codes)

    def _dc(self, order, low: int, bits: _Bits, codes: dict) -> None:
        last = dict.fromkeys(codes, 0)
        units = len(order[0][1])
        for u in range(units):
            if u == 1 and not bits.bits[bits.at : bits.at + (units - 1) * len(order)].any() and all(x.get((1, 0)) == 0 for x in codes.values()):
                for c, place in order:  # nothing but the code of "no difference" is left
                    self.coef[c][place[1:], 0] = last[c] << low
                return
            for c, place in order:
                n = bits.symbol(codes[c])
                last[c] += _signed(bits.take(n), n)
                self.coef[c][place[u], 0] = last[c] << low

    def _dc_more(self, order, low: int, bits: _Bits) -> None:
        units = len(order[0][1])
        plane = bits.bits[: units * len(order)].reshape(units, len(order)).astype(np.int32) << low
        for k, (c, place) in enumerate(order):
            self.coef[c][place, 0] |= plane[:, k]

    def _ac_alike(self, c: int, a: int, b: int, low: int, bits: _Bits, codes: dict) -> bool:
        """A first pass in which every coefficient has the table's only symbol, without a run of zeros; taken apart as bytes
        where each takes eight bits."""
        if len(codes) != 1:
            return False
        (length, code), symbol = next(iter(codes.items()))
        n, rows = symbol & 15, len(self.own[c])
        count = rows * (b - a + 1)
        if symbol >> 4 or not n or length != 1 or 8 * len(bits.raw) < count * (n + 1):
            return False
        if n == 7:
            each = bits.raw[:count]
            if (each >> 7 != code).any():
                return False
            value = (each & 127).astype(np.int32)
        else:
            each = bits.bits[: count * (n + 1)].reshape(count, n + 1)
            if (each[:, 0] != code).any():
                return False
            value = each[:, 1:].astype(np.int32) @ (1 << np.arange(n - 1, -1, -1))
        value = np.where(value >> (n - 1), value, value - (1 << n) + 1)
        self.coef[c][self.own[c], a : b + 1] = (value << low).reshape(rows, -1)
        return True

    def _ac(self, c: int, a: int, b: int, low: int, bits: _Bits, codes: dict) -> None:
        run = 0
        for place in self.own[c].tolist():
            if run:
                run -= 1
                continue
            k = a
            while k <= b:
                symbol = bits.symbol(codes)
                zeros, n = symbol >> 4, symbol & 15
                if n:
                    k += zeros
                    self.coef[c][place, k] = _signed(bits.take(n), n) << low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) + bits.take(zeros) - 1
                    break

    def _ac_more(self, c: int, a: int, b: int, low: int, bits: _Bits, codes: dict) -> None:
        step = 1 << low
        coef, places = self.coef[c], self.own[c]
        at, run = 0, 0
        full = (coef[places, a : b + 1] != 0).all(1)
        while at < len(places):
            if run and full[at : at + run].all():  # corrections of whole blocks, one bit a coefficient
                n = min(run, len(places) - at)
                some = places[at : at + n]
                plane = bits.bits[bits.at : bits.at + n * (b - a + 1)].reshape(n, -1).astype(np.int32)
                old = coef[some, a : b + 1]
                coef[some, a : b + 1] = old + np.where(old > 0, plane, -plane) * step
                bits.at += plane.size
                at, run = at + n, run - n
                continue
            row, k = coef[places[at]], a
            if not run:
                while k <= b:
                    symbol = bits.symbol(codes)
                    zeros, n = symbol >> 4, symbol & 15
                    value = 0
                    if n:
                        value = step if bits.take(1) else -step
                    elif zeros < 15:
                        run = (1 << zeros) + bits.take(zeros)
                        break
                    while k <= b:
                        if row[k]:
                            if bits.take(1) and not abs(int(row[k])) & step:
                                row[k] += step if row[k] > 0 else -step
                        elif zeros == 0:
                            if value:
                                row[k] = value
                            k += 1
                            break
                        else:
                            zeros -= 1
                        k += 1
            if run:
                if k == a and full[at : at + run].all():
                    continue
                while k <= b:
                    if row[k] and bits.take(1) and not abs(int(row[k])) & step:
                        row[k] += step if row[k] > 0 else -step
                    k += 1
                run -= 1
            at += 1

    def payload(self) -> bytes:
        """The bytes that ``encode`` was given."""
        n = struct.unpack(">Q", self.comment)[0]
        units = self.mx * self.my
        data = np.empty((units, 6, 64), np.int32)
        data[:, :4] = self.coef[0][_orders(self.mx, self.my)].reshape(units, 4, 64)
        data[:, 4], data[:, 5] = self.coef[1], self.coef[2]
        data[:, :, 1:] += 255 * (data[:, :, 1:] < 0)
        data[:, :, 0] -= _BASE
        return data.astype(np.uint8).reshape(-1)[:n].tobytes()

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor (height, width, 3) of 8-bit samples."""
        planes = []
        for c, coef in enumerate(self.coef):
            # Scale each coefficient, put it in its place, and transform: one product of n x 64 by 64 x 64.
            pixels = coef.astype(np.float32) @ (self.quant[self.tq[c]][:, None] * _IDCT)
            pixels = pixels.reshape(-1, self.across[c], 8, 8).transpose(0, 2, 1, 3).reshape(-1, self.across[c] * 8) + 128
            pixels = np.clip(pixels, 0, 255)
            if self.vmax > self.v[c]:
                pixels = np.repeat(pixels, self.vmax // self.v[c], axis=0)
            if self.hmax > self.h[c]:
                pixels = np.repeat(pixels, self.hmax // self.h[c], axis=1)
            planes.append(pixels[: self.height, : self.width])
        if len(planes) == 1:
            planes = [planes[0]] * 3
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, p in enumerate(planes):
            out[:, :, k] = np.clip(p + 0.5, 0, 255)
        return out


def _idct() -> np.ndarray:
    """Row z: the 64 samples of a block whose only coefficient is 1 at place z of the zigzag."""
    k = np.arange(8)
    m = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    both = np.einsum("ux,vy->uvxy", m, m).reshape(64, 64)
    return both[ZIGZAG].astype(np.float32)


_IDCT = _idct()


# ---- columns -------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the text's payload as a progressive JPEG."""
    tune(docs.sparkSession)

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [(t or "").encode() for t in column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(rows: DataFrame, media: str = "media", tensor: bool = True) -> DataFrame:
    """The rows with payload, height, width, means of red, green and blue and, with ``tensor``, rgb: the
    bytes of the (height, width, 3) tensor. One without a tensor still decodes it for the means."""
    tune(rows.sparkSession)
    rows = rows.drop("payload", "height", "width", "red", "green", "blue", "rgb")
    names = rows.columns

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, media):
                out: list[list] = [[] for _ in range(7)]
                for raw in column(part, media).to_pylist():
                    p = Picture(raw)
                    x = p.rgb()
                    mean = x.reshape(-1, 3).sum(0, dtype=np.int64) / (p.height * p.width)
                    for held, v in zip(out, (p.payload(), p.height, p.width, *mean.tolist(), x.tobytes() if tensor else None), strict=True):
                        held.append(v)
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]
                cols = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: 7 if tensor else 6]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*names, "payload", "height", "width", "red", "green", "blue", "rgb"][: len(names) + len(cols)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", payload binary, height int, width int, red double, green double, blue double" + (", rgb binary" if tensor else "")
    return rows.mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(store(table(spark, sf_dir, "documents")))
    tail = F.expr("substring(payload, -32, 32)")
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d:%.3f,%.3f,%.3f:%08x", "height", "width", "red", "green", "blue", F.crc32("rgb")).alias("feature"),
    )


QUERIES = {"op10_media": op10_media}
ORACLES: dict[str, str] = {}
