"""Packing by minimum bin slack (operator 3).

A document is cut into pieces of at most ``window`` tokens: full windows and one remainder. What is planned is not the
pieces but how many there are of each length, at most ``window`` counts however large the corpus. For each next window a
subset-sum table over the remaining multiset of lengths, a bitset for each length, gives the fill closest to capacity that
holds the longest remaining piece; walking the table back gives the counts, and the same fill is repeated as often as the
counts allow. Pieces then find their place from their rank among the pieces of their length. Ranks are taken in two steps
(counts by length and bucket, then ranks inside a bucket), so that a length which a third of all pieces have is no one
task's work.

Defined cases: null or empty text is the closing id alone, a piece of length 1; null ids are kept; repeated rows are packed
each; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_alphabet
from .common import cut_lineage, parallelism, per_text, table

WINDOW, CLOSING = 2048, 1
#: Letters that lower-casing and normalisation treat one by one, and signs after them.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class WordBpe:
    """Ids of whole texts by a tokenizer that never joins across white space: words are encoded once and remembered."""

    def __init__(self, file: str, limit: int = 350_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.memo: dict[str, bytes] = {}
        self.limit = limit
        self.written = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of unknown words.

        Plain letters go to the tokenizer's merges as it would hand them on itself, in lower case and written as bytes; the
        signs after them are a pre-token of their own. All other words take its whole way.
        """
        memo, known, merges = self.memo, self.memo.get, self.tokenizer.model.tokenize
        for word in words:
            if not (m := PLAIN.fullmatch(word)):
                memo[word] = self._ids(word)
                continue
            letters, signs = m.groups()
            low = letters.lower()
            ids = known(low)
            if ids is None:
                written = low if low.isascii() else low.encode().decode("latin-1").translate(self.written)
                ids = memo[low] = struct.pack(f"<{len(t)}I", *[x.id for x in t]) if (t := merges(written)) else b""
            if signs:
                after = known(signs)
                if after is None:
                    after = memo[signs] = self._ids(signs)
                ids += after
            memo[word] = ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids. Only blanks, tabs and line ends split; a text with marks of special tokens goes whole."""
        if "<|" in text:
            return self._ids(text)
        memo = self.memo
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if new := set(words).difference(memo):
            if len(memo) + len(new) > self.limit:
                memo.clear()
                new = set(words)
            self._learn(new)
        return b"".join(map(memo.__getitem__, words))


_LOADED: dict[str, WordBpe] = {}


def _coder(file: str) -> WordBpe:
    if file not in _LOADED:
        _LOADED.clear()
        _LOADED[file] = WordBpe(file)
    return _LOADED[file]


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, closing: int = CLOSING, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens; ``with_ids``: also ids (binary, little-endian 32 bits)."""
    end = np.array([closing], "<u4").tobytes()

    def start():
        coder = _coder(tokenizer_path)

        def pieces(text: str) -> list[tuple]:
            ids = coder.encode(text) + end
            n = len(ids) // 4
            cut = [ids[4 * i : 4 * (i + window)] for i in range(0, n, window)]
            return [(i * window, len(x) // 4, zlib.crc32(x), n, *([x] if with_ids else [])) for i, x in enumerate(cut)]

        return pieces

    return per_text(docs, "start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids, start, id_col, text_col, many=True)


def best_fill(counts: np.ndarray, window: int) -> dict[int, int]:
    """The multiset of remaining lengths, with the longest one in it, whose sum is closest to the window from below."""
    lengths = np.flatnonzero(counts)
    longest = int(lengths[-1])
    room = window - longest
    goal, full = 1 << room, (1 << room + 1) - 1
    table_, reached = [], 1
    for length in lengths[lengths <= room][::-1].tolist():
        left = min(int(counts[length]) - (length == longest), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            table_.append((length, take, reached))
            reached |= reached << length * take & full
            left, take = left - take, 2 * take
        if reached & goal:
            break
    at, used = reached.bit_length() - 1, {longest: 1}
    for length, take, before in reversed(table_):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_windows(counts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces in each window, offset of the first of them)."""
    counts, done, plan, sequence = counts.copy(), np.zeros(len(counts), np.int64), [], 0
    while counts.any():
        used = best_fill(counts, window)
        times = min(int(counts[n]) // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            plan.append((n, int(done[n]), int(done[n]) + times * k, sequence, k, offset))
            counts[n] -= times * k
            done[n] += times * k
            offset += n * k
        sequence += times
    return plan


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (with length between 1 and ``window``) and their sequence_id and offset.

    ``pieces`` is read twice and must be the same both times; pass a written or checkpointed table. The driver receives one
    count for each length.
    """
    names, spark = pieces.columns, pieces.sparkSession
    buckets = parallelism(spark)
    order = [F.col(c) for c in names]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    by_bucket = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_bucket.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    counts = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    plan = np.array(plan_windows(counts, window), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    key = plan[:, 0] << 48 | plan[:, 1]
    inside = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_inside", F.row_number().over(inside) - 1).join(firsts, ["length", "_bucket"]).select(*names, (F.col("_first") + F.col("_inside")).alias("_rank"))
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            row = plan[np.searchsorted(key, length << 48 | rank, side="right") - 1] if len(plan) else plan
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut_lineage(cut_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))))
