"""Progressive JPEG: exact round trips of the writer, and general scans against coefficients."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumiset.llm import progressive_jpeg as J


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_round_trip(units, seed):
    payload = np.random.default_rng(seed).integers(0, 256, J.UNIT * units, dtype=np.uint8).tobytes()
    assert J.read_payload(J.Picture(J.write(payload))) == payload


def test_many_blocks_need_several_runs():
    payload = bytes(range(256)) * 9 * 2600
    payload = payload[: len(payload) // J.UNIT * J.UNIT]
    assert J.read_payload(J.Picture(J.write(payload))) == payload


class Pen:
    """Symbol-wise writer of one grey picture with any coefficients, to hold the decoder against."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def data(self):
        return J._stuffed(np.array(self.bits, np.uint8))


def grey(coefficients, width, height):
    """A progressive file in five scans: DC in two steps, AC 1-5, AC 6-63 without the lowest bit, and its refinement."""
    table = {s: 8 for s in range(250)}
    codes = {s: i for i, s in enumerate(sorted(table))}
    size = lambda v: int(abs(v)).bit_length()

    def value(pen, v):
        n = size(v)
        pen.put(v if v >= 0 else v + (1 << n) - 1, n)

    def first(band, low):
        pen = Pen()
        for block in coefficients:
            row = [int(np.sign(v)) * (abs(int(v)) >> low) for v in block[band]]
            run = 0
            for k, v in enumerate(row):
                if not any(row[k:]):
                    pen.put(codes[0], 8)
                    break
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    pen.put(codes[0xF0], 8)
                    run -= 16
                pen.put(codes[run << 4 | size(v)], 8)
                value(pen, v)
                run = 0
        return pen.data()

    def refine(band):
        pen = Pen()
        for block in coefficients:
            row = [int(v) for v in block[band]]
            new = [k for k, v in enumerate(row) if abs(v) == 1]
            last = new[-1] if new else -1
            run, waiting = 0, []
            for k, v in enumerate(row):
                if k > last:
                    break
                if abs(v) > 1:
                    waiting.append(abs(v) & 1)
                elif v == 0:
                    run += 1
                else:
                    assert run <= 15
                    pen.put(codes[run << 4 | 1], 8)
                    pen.put(int(v > 0), 1)
                    for b in waiting:
                        pen.put(b, 1)
                    run, waiting = 0, []
            if last < len(row) - 1:
                pen.put(codes[0], 8)
                for v in row[last + 1 :]:
                    if abs(v) > 1:
                        pen.put(abs(v) & 1, 1)
        return pen.data()

    dc, before = Pen(), 0
    for block in coefficients:
        v = int(block[0]) >> 1
        dc.put(codes[size(v - before)], 8)
        value(dc, v - before)
        before = v
    dc2 = Pen()
    for block in coefficients:
        dc2.put(int(block[0]) & 1, 1)
    scan = lambda s, e, h, data: J._segment(0xDA, bytes([1, 1, 0, s, e, h])) + data
    return b"".join([
        b"\xff\xd8", J._segment(0xDB, b"\x00" + bytes(range(1, 65))), J._segment(0xC2, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])),
        J._segment(0xC4, J.huffman_table(0, 0, table) + J.huffman_table(1, 0, table)),
        scan(0, 0, 1, dc.data()), scan(1, 5, 0, first(slice(1, 6), 0)), scan(6, 63, 1, first(slice(6, 64), 1)), scan(6, 63, 1 << 4, refine(slice(6, 64))), scan(0, 0, 1 << 4, dc2.data()), b"\xff\xd9",
    ])


@pytest.mark.parametrize("seed", range(6))
def test_general_scans(seed):
    rng = np.random.default_rng(seed)
    width, height = 8 * 5 - 3, 8 * 3
    blocks = np.where(rng.random((15, 64)) < 0.35, rng.integers(-40, 41, (15, 64)), 0)
    blocks[:, 7::8] = rng.choice([-1, 1], blocks[:, 7::8].shape)  # so that no run of zeros passes 15 in a refinement
    blocks[::4, 1:] = 0
    picture = J.Picture(grey(blocks, width, height))
    assert (picture.parts[0].coefficients == blocks).all()
    image = picture.rgb()
    assert image.shape == (height, width, 3)
    want = np.zeros((3 * 8, 5 * 8))
    for i, block in enumerate(blocks):
        square = np.zeros((8, 8))
        square[np.divmod(J.ZIGZAG, 8)] = block * np.arange(1, 65)
        y, x = np.mgrid[:8, :8]
        c = [np.sqrt(1 / 2)] + [1] * 7
        out = sum(c[u] * c[v] / 4 * square[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
        want[i // 5 * 8 : i // 5 * 8 + 8, i % 5 * 8 : i % 5 * 8 + 8] = out + 128
    assert np.abs(image[:, :, 0].astype(int) - np.clip(want[:height, :width], 0, 255)).max() <= 1


def test_texts(hard_docs, no_docs):
    rows = J.media_digests(hard_docs).collect()
    by = {}
    for r in rows:
        assert r.payload_bytes % J.UNIT == 0 and r.payload_bytes >= max(1, r.n_bytes)
        by.setdefault(r.doc_id, r)
    assert by[5].media_sha256 == by[6].media_sha256 and by[5].feature == by[6].feature
    assert by[2].n_bytes == by[3].n_bytes == 0 and by[2].payload_sha256 == by[3].payload_sha256
    assert J.media_digests(no_docs).count() == 0
    media = J.store_texts(hard_docs).where("doc_id = 1").first().media
    height, width, tensor = J.decode_tensor(bytes(media))
    assert len(tensor) == height * width * 3


def test_stored_columns_are_read_back(spark, hard_docs, tmp_path):
    """Media and tensors go to Parquet and come back: the payload is the text, the tensor that of the picture."""
    path = str(tmp_path / "media")
    J.store_texts(hard_docs).write.parquet(path)
    stored = spark.read.parquet(path)
    J.tensors(stored).write.parquet(str(tmp_path / "tensors"))
    rows = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "tensors")).collect()}
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in hard_docs.collect()}
    assert set(rows) == set(media) == set(texts)
    for i, r in rows.items():
        assert len(r.tensor) == r.height * r.width * 3 and np.abs(np.frombuffer(r.tensor, np.uint8).astype(int) - J.Picture(media[i]).rgb().ravel()).max() <= 1  # sums of floats in other orders
        assert J.read_payload(J.Picture(media[i])).startswith(texts[i])
    again = {r.doc_id: r for r in J.read_media(stored).collect()}
    assert all(r == again[r.doc_id] for r in J.media_digests(hard_docs).collect())
