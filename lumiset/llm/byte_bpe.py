"""Byte-level BPE encoding and decoding (operator 1).

A sentencepiece BPE model is serialised straight from a rank vocabulary: each token's bytes are written with a printable
alphabet, its score is minus its rank, and normalisation is the identity. Merging by best score is then merging by lowest
rank. Text is split into pre-tokens by a pattern, each is encoded by itself, and decoding maps pieces back to bytes.

Defined cases: null text is empty text (no ids, the digest of nothing); null ids are kept; repeated rows give repeated
results; extra columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, per_text, table

#: A pre-token whose merges are remembered.
REMEMBERED = 40


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is visible in Latin-1, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protobuf field: an int as varint, a float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the unknown piece comes after them."""
    alphabet = byte_alphabet()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    normal, unknown = 1, 2
    pieces = [_field(1, "".join(alphabet[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, normal) for token, rank in by_rank]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(by_rank)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder over one serialised model."""

    def __init__(self, model: bytes, pattern: str, limit: int = 150_000):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        # White space as Unicode defines it; \s of the regex library also takes the separators U+001C to U+001F.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).finditer
        self.map = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        back = {c: b for b, c in enumerate(byte_alphabet())}
        n = self.pieces.get_piece_size() - 1
        self.bytes_of = [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(n)]
        self.whole = {token: i for i, token in enumerate(self.bytes_of)}
        self.memo = Memo(self._pretoken, limit, REMEMBERED)

    def _pretoken(self, token: str) -> bytes:
        raw = token.encode("utf-8")
        if raw in self.whole:
            ids = [self.whole[raw]]
        else:
            ids = self.pieces.encode(raw.decode("latin-1").translate(self.map))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        memo = self.memo
        return np.frombuffer(b"".join([memo[m.group()] for m in self.find(text)]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_LOADED: dict[int, ByteBpe] = {}


def _coder(model, pattern: str) -> ByteBpe:
    """One coder for each worker process and model."""
    if model.id not in _LOADED:
        _LOADED.clear()
        _LOADED[model.id] = ByteBpe(model.value, pattern)
    return _LOADED[model.id]


class _Shared:
    """A broadcast model with a name that worker processes can keep it by."""

    def __init__(self, spark: SparkSession, model: bytes):
        self.id, self.box = hashlib.sha256(model).hexdigest(), spark.sparkContext.broadcast(model)

    @property
    def value(self) -> bytes:
        return self.box.value


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. The model, a fixed few MB of vocabulary, is broadcast."""
    model = _Shared(docs.sparkSession, serialise_model(read_ranks(ranks_path)))

    def start():
        coder = _coder(model, pattern)
        return lambda text: (coder.encode(text).astype(np.int32),)

    return per_text(docs, "ids array<int>", start, id_col, text_col)


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids); null ids decode to nothing."""
    model = _Shared(encoded.sparkSession, serialise_model(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model, pattern)
        for batch in batches:
            raw = [coder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode what was encoded, and return the digests of both sides in the same pass."""
    model = _Shared(docs.sparkSession, serialise_model(read_ranks(ranks_path)))

    def start():
        coder = _coder(model, pattern)

        def digest(text: str) -> tuple:
            ids = coder.encode(text)
            return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

        return digest

    return per_text(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", start, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
