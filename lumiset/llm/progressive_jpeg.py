"""Media columns as progressive JPEG (operator 6).

The decoder takes any progressive DCT file with 8-bit samples and Huffman coding: it accumulates spectral-selection and
successive-approximation scans into coefficient arrays, transforms blocks back in numpy, upsamples chroma and gives the
full-resolution RGB tensor. Runs of equally coded coefficients and end-of-band runs are decoded at once: the guess that the
next symbols are all alike is checked bit by bit before it is taken, so the result is what symbol-wise decoding gives.

The writer stores bytes without loss as coefficients (4:2:0, quantisation by 1). A byte is one AC coefficient of size class
8, whose eight appended bits are the byte; the first scan of a component sends all but the lowest bit, a refinement scan the
lowest. Each block holds ``BAND`` bytes, a minimum coded unit six blocks, so 576 bytes are two units. The number of payload
bytes stands in a comment; the rest of the picture is filled with bytes 255.

Defined cases: null text is empty text, whose payload is one unit of bytes 255; equal texts have equal values; null ids are
kept; repeated rows are stored each; extra columns are ignored; texts of any length up to the format's 65,535 pixels a side
are one picture, longer ones are refused with an error.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table

UNIT, BAND, BLOCKS = 576, 48, 6
#: Rows and columns of the 64 coefficients in the order in which they are sent.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))
_C = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: 64 coefficients in sending order to 64 samples.
INVERSE = np.einsum("ux,vy->uvxy", _C, _C).reshape(64, 64)[ZIGZAG].astype(np.float32)


class JpegError(ValueError):
    pass


# ---- writing -------------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def huffman_table(kind: int, slot: int, codes: dict[int, int]) -> bytes:
    """A table segment's body from the code length of each symbol, shorter ones first."""
    counts = [sum(n == length for n in codes.values()) for length in range(1, 17)]
    return bytes([kind << 4 | slot, *counts, *sorted(codes, key=lambda s: (codes[s], s))])


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled up with ones, a zero after each byte 255."""
    fill = np.ones(-len(bits) % 8, np.uint8)
    return np.packbits(np.concatenate([bits, fill])).tobytes().replace(b"\xff", b"\xff\x00")


def grid(units: int) -> tuple[int, int]:
    """Columns and rows of coded units (16 by 16 pixels) for at least ``units`` of them, near a square; two at least."""
    columns = max(2, int(np.ceil(np.sqrt(units))))
    columns += columns % 2
    rows = -(-units // columns)
    if max(columns, rows) > 4095:
        raise JpegError("a picture holds no more than 4095 units a side")
    return columns, rows


_TABLES = _segment(0xC4, huffman_table(0, 0, {0: 1}) + huffman_table(1, 0, {7: 1}) + huffman_table(1, 1, {r << 4: 4 for r in range(15)}))


def write(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold ``payload``, of a positive multiple of 576 bytes."""
    if not payload or len(payload) % UNIT:
        raise JpegError("a payload is a positive multiple of 576 bytes")
    columns, rows = grid(len(payload) // (BAND * BLOCKS))
    room = columns * rows
    data = np.full(room * BLOCKS * BAND, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(rows, columns, BLOCKS, BAND)
    luma = blocks[:, :, :4].reshape(rows, columns, 2, 2, BAND).transpose(0, 2, 1, 3, 4).reshape(-1, BAND)
    parts = [luma, blocks[:, :, 4].reshape(-1, BAND), blocks[:, :, 5].reshape(-1, BAND)]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # Tables: DC differences are all of class 0; first AC scans have class 7 after no zeros; refinement scans only end-of-band runs.
    out.append(_TABLES)
    out += [_segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])), _stuffed(np.zeros(room * BLOCKS, np.uint8))]
    for c, part in enumerate(parts, 1):
        # Class 7 after one shift: the code 0, then seven bits that are the byte's upper bits.
        out += [_segment(0xDA, bytes([1, c, 0, 1, BAND, 1])), (part >> 1).tobytes()]
    for c, part in enumerate(parts, 1):
        low = (part & 1) ^ (part < 128)  # the lowest bit of the magnitude: that of 255 - b for a negative coefficient
        bits = []
        for at in range(0, len(low), 32767):
            run = min(32767, len(low) - at)
            size = run.bit_length() - 1
            bits += [np.array([size >> k & 1 for k in (3, 2, 1, 0)] + [run >> k & 1 for k in range(size - 1, -1, -1)], np.uint8), low[at : at + run].ravel()]
        out += [_segment(0xDA, bytes([1, c, 1, 1, BAND, 1 << 4])), _stuffed(np.concatenate(bits).astype(np.uint8))]
    return b"".join([*out, b"\xff\xd9"])


# ---- reading -------------------------------------------------------------------------------------------------------------


#: What ends a scan: a marker that is neither a stuffed byte nor a restart.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


class Huffman:
    """Codes of one table: what each 16 bits begin with, as length and symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    def read(self, bits: Bits) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits.take(1)
            if (length, code) in self.codes:
                return self.codes[length, code]
        raise JpegError("no such code")

    def code_of(self, symbol: int) -> tuple[int, int] | None:
        return next((lc for lc, s in self.codes.items() if s == symbol), None)


@functools.lru_cache(256)
def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class Bits:
    """The bits of one restart interval."""

    def __init__(self, raw: bytes):
        self.all = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.all):
            raise JpegError("scan ends early")
        value = 0
        for b in self.all[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def many(self, n: int) -> np.ndarray:
        if self.at + n > len(self.all):
            raise JpegError("scan ends early")
        self.at += n
        return self.all[self.at - n : self.at]

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> size - 1 else value - (1 << size) + 1

    def alike(self, length: int, code: int, size: int, most: int) -> np.ndarray:
        """How often from here on the same code comes with ``size`` bits after it, at most ``most`` times: these bits."""
        stride = length + size
        n = min(most, (len(self.all) - self.at) // stride)
        rows = self.all[self.at : self.at + n * stride].reshape(n, stride)
        want = np.array([code >> k & 1 for k in range(length - 1, -1, -1)], np.uint8)
        other = np.flatnonzero((rows[:, :length] != want).any(1))
        n = int(other[0]) if len(other) else n
        self.at += n * stride
        return rows[:n, length:]


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.id, self.h, self.v, self.quant = ident, h, v, quant


class Picture:
    """A progressive file while its scans are read: coefficients of each component in sending order."""

    def __init__(self, raw: bytes):
        self.raw, self.quants, self.dc, self.ac, self.comment, self.interval = raw, {}, {}, {}, b"", 0
        self.parts: list[Component] = []
        at = 2
        if raw[:2] != b"\xff\xd8":
            raise JpegError("not a JPEG file")
        while at < len(raw) - 1:
            marker = raw[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._tables(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and marker != 0xCC:
                raise JpegError("not a progressive Huffman file")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                at = self._scan(body, at)

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide, slot = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            self.quants[slot] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
            body = body[1 + n :]

    def _tables(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            (self.ac if body[0] >> 4 else self.dc)[body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8:
            raise JpegError("8-bit samples only")
        self.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.columns, self.rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.parts:
            c.across, c.down = self.columns * c.h, self.rows * c.v
            c.coefficients = np.zeros((c.down * c.across, 64), np.int16)
            c.wide, c.high = -(-(-(-self.width * c.h // self.hmax)) // 8), -(-(-(-self.height * c.v // self.vmax)) // 8)

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0]
        chosen = [(next(c for c in self.parts if c.id == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        first, last, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
        found = _MARKER.search(self.raw, at)
        end = found.start() if found else len(self.raw)
        intervals, data = [], self.raw[at:end]
        if self.interval:
            start = 0
            k = 0
            while (k := data.find(b"\xff", k)) >= 0:
                if 0xD0 <= data[k + 1] <= 0xD7:
                    intervals.append(data[start:k])
                    start = k + 2
                k += 2
            data = data[start:]
        intervals.append(data)
        units = self.columns * self.rows if n > 1 else chosen[0][0].wide * chosen[0][0].high
        step = self.interval or units
        for k, raw in enumerate(intervals):
            bits = Bits(raw)
            a, b = k * step, min(units, (k + 1) * step)
            if first == 0:
                self._dc(bits, chosen, a, b, approx)
            elif approx >> 4 == 0:
                self._ac_first(bits, self._alone(chosen[0]), a, b, first, last, approx & 15)
            else:
                self._ac_refine(bits, self._alone(chosen[0]), a, b, first, last, approx & 15)
        return end

    def _alone(self, chosen: tuple) -> tuple:
        """A component that is sent by itself, with its blocks in order: those that hold pixels."""
        c = chosen[0]
        if (c.wide, c.high) == (c.across, c.down):
            return chosen, np.arange(c.wide * c.high)
        return chosen, (np.arange(c.high)[:, None] * c.across + np.arange(c.wide)[None]).ravel()

    def _interleaved(self, chosen: list) -> list:
        """For each component the blocks in the order of units: (units, blocks of a unit)."""
        out = []
        for c, tables in chosen:
            y, x = np.divmod(np.arange(self.columns * self.rows), self.columns)
            v, h = np.divmod(np.arange(c.h * c.v), c.h)
            out.append(((c, tables), (y[:, None] * c.v + v) * c.across + x[:, None] * c.h + h))
        return out

    def _dc(self, bits: Bits, chosen: list, a: int, b: int, approx: int) -> None:
        low = approx & 15
        per_unit = sum(c.h * c.v for c, _ in chosen) if len(chosen) > 1 else 1
        tables = [self.dc.get(t >> 4) for _, t in chosen]
        done = a
        if approx >> 4 == 0 and all(t is tables[0] for t in tables) and (zero := tables[0].code_of(0)):
            done = a + len(bits.alike(*zero, 0, (b - a) * per_unit)) // per_unit  # differences of 0 change nothing
            if done == b:
                return
            bits.at = (done - a) * per_unit * zero[0]
        order = self._interleaved(chosen) if len(chosen) > 1 else [(chosen[0], self._alone(chosen[0])[1][:, None])]
        places = [(c, p) for (c, _), p in order]
        if approx >> 4:
            values, k = bits.many((b - a) * per_unit).reshape(b - a, per_unit).astype(np.int16), 0
            for c, p in places:
                c.coefficients[p[a:b].ravel(), 0] |= (values[:, k : k + p.shape[1]] << low).ravel()
                k += p.shape[1]
            return
        before = [0] * len(places)
        for unit in range(done, b):
            for i, (c, p) in enumerate(places):
                for block in p[unit]:
                    before[i] += bits.signed(tables[i].read(bits))
                    c.coefficients[block, 0] = before[i] << low

    def _ac_first(self, bits: Bits, order: tuple, a: int, b: int, first: int, last: int, low: int) -> None:
        (c, tables), places = order
        table_, width = self.ac[tables & 15], last - first + 1
        unit, k, skip = a, first, 0
        while unit < b:
            if skip:
                step = min(skip, b - unit)
                unit, skip = unit + step, skip - step
                continue
            symbol = table_.read(bits)
            run, size = symbol >> 4, symbol & 15
            if size == 0 and run < 15:
                skip = (1 << run) + (bits.take(run) if run else 0) - 1
                unit, k = unit + 1, first
                continue
            if size == 0:
                k += 16
            elif run:
                k += run
                c.coefficients[places[unit], k] = bits.signed(size) * (1 << low)
                k += 1
            else:  # as many coefficients of this class as follow without zeros between them, over blocks
                code = table_.code_of(symbol)
                bits.at -= code[0]
                most = (b - unit) * width - (k - first)
                found = bits.alike(*code, size, most)
                value = np.packbits(found, axis=1)[:, 0].astype(np.int16) >> 8 - size if size <= 8 else (found.astype(np.int32) << np.arange(size - 1, -1, -1)).sum(1)
                value = np.where(value >> size - 1 > 0, value, value - (1 << size) + 1) * (1 << low)
                end = (unit - a) * width + (k - first) + len(value)
                if k == first and end % width == 0:
                    c.coefficients[places[unit : a + end // width], first : last + 1] = value.reshape(-1, width)
                else:
                    at = np.arange(end - len(value), end)
                    c.coefficients[places[a + at // width], first + at % width] = value
                unit, k = a + end // width, first + end % width
                continue
            if k > last:
                unit, k = unit + 1, first
        return

    def _ac_refine(self, bits: Bits, order: tuple, a: int, b: int, first: int, last: int, low: int) -> None:
        (c, tables), places = order
        table_, one = self.ac[tables & 15], 1 << low
        band = slice(first, last + 1)
        unit, run_left = a, 0
        while unit < b:
            if run_left:  # correction bits of all blocks of the run at once
                step = min(run_left, b - unit)
                chosen = places[unit : unit + step]
                block = c.coefficients[chosen, band]
                sign = np.sign(block)
                known = sign != 0
                if known.all():
                    block += sign * (bits.many(block.size).reshape(block.shape).astype(np.int16) << low)
                else:
                    bit = bits.many(int(known.sum()))
                    block[known] += sign[known] * (bit.astype(np.int16) << low)
                c.coefficients[chosen, band] = block
                unit, run_left = unit + step, run_left - step
                continue
            row, k = c.coefficients[places[unit]], first
            while k <= last:
                symbol = table_.read(bits)
                run, size = symbol >> 4, symbol & 15
                if size == 0 and run < 15:
                    run_left = (1 << run) + (bits.take(run) if run else 0)
                    break
                value = (one if bits.take(1) else -one) if size else 0
                while k <= last:
                    if row[k]:
                        if bits.take(1):
                            row[k] += one if row[k] > 0 else -one
                    elif run == 0:
                        row[k] = value
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
            if run_left and k == first:
                continue  # the whole block is part of the run
            if run_left:
                for k in range(k, last + 1):  # the rest of this block
                    if row[k] and bits.take(1):
                        row[k] += one if row[k] > 0 else -one
                run_left -= 1
            unit += 1
        return

    def rgb(self, first: int = 0, count: int | None = None) -> np.ndarray:
        """Pixels of unit rows from ``first`` on, (height, width, 3) uint8, chroma repeated to full resolution."""
        count = self.rows - first if count is None else min(count, self.rows - first)
        planes = []
        for c in self.parts:
            rows = c.coefficients[first * c.v * c.across : (first + count) * c.v * c.across]
            samples = (rows.astype(np.float32) * self.quants[c.quant]) @ INVERSE + 128
            plane = samples.reshape(count * c.v, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(count * c.v * 8, c.across * 8)
            planes.append(plane.repeat(self.vmax // c.v, 0).repeat(self.hmax // c.h, 1))
        height = min(self.height - first * 8 * self.vmax, count * 8 * self.vmax)
        if len(planes) == 1:
            return np.clip(np.rint(planes[0])[:height, : self.width, None].repeat(3, 2), 0, 255).astype(np.uint8)
        y, cb, cr = (p[:height, : self.width] for p in planes[:3])
        cb, cr = cb - 128, cr - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def read_payload(picture: Picture) -> bytes:
    """The bytes that ``write`` stored, from the coefficients."""
    rows, columns = picture.rows, picture.columns
    # Class 8: a positive coefficient is its byte, a negative one is its byte less 255.
    y, cb, cr = ((v + 255 * (v < 0)).astype(np.uint8) for v in (c.coefficients[:, 1 : BAND + 1] for c in picture.parts))
    blocks = np.empty((rows, columns, BLOCKS, BAND), np.uint8)
    blocks[:, :, :4] = y.reshape(rows, 2, columns, 2, BAND).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, BAND)
    blocks[:, :, 4], blocks[:, :, 5] = cb.reshape(rows, columns, BAND), cr.reshape(rows, columns, BAND)
    return blocks.tobytes()[: int(picture.comment.split()[1])]


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw + b"\xff" * (size - len(raw))


def feature(picture: Picture, rows: int = 64) -> str:
    """Size, and mean and spread of each channel, from the RGB tensor in bands of unit rows."""
    total, square, n = np.zeros(3), np.zeros(3), 0
    for at in range(0, picture.rows, rows):
        band = picture.rgb(at, rows).reshape(-1, 3)
        wide = band.astype(np.float32)
        total += band.sum(0, dtype=np.int64)
        square += np.einsum("ij,ij->j", wide, wide, dtype=np.float64)
        n += len(band)
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean**2, 0))
    return f"{picture.width}x{picture.height} " + " ".join(f"{m:.2f}:{s:.2f}" for m, s in zip(mean, spread, strict=True))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a stored picture."""

    def start():
        def row(text: str) -> tuple:
            n, payload = payload_of(text)
            return n, write(payload)

        return row

    return per_text(docs, "n_bytes long, media binary", start, id_col, text_col)


def decode_tensor(media: bytes) -> tuple[int, int, bytes]:
    """Height, width and the RGB bytes of a stored picture."""
    image = Picture(media).rgb()
    return image.shape[0], image.shape[1], image.tobytes()


def tensors(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, height, width, tensor: the full-resolution RGB bytes of each picture of a media column, row by row of pixels."""
    return per_text(stored, "height int, width int, tensor binary", lambda: decode_tensor, id_col, media_col, binary=True)


def read_media(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple = ("n_bytes",)) -> DataFrame:
    """Each picture of a media column decoded: length and digests of the payload that it holds, its own, and its feature."""

    def start():
        def row(media: bytes) -> tuple:
            picture = Picture(media)
            back = read_payload(picture)
            return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(picture)

        return row

    return per_text(stored, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", start, id_col, media_col, keep, binary=True)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored in a media column, and in a second step read back from it; all digests but the text's length are of what the decoder gave."""
    return read_media(store_texts(docs, id_col, text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
