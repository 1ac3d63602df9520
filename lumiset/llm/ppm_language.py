"""Language identification by prediction by partial matching (operator 4).

Each language has a tree of byte contexts up to ``ORDER`` bytes with the counts of what followed them. A byte costs the code
length that partial matching gives it: from the longest known context down, an escape for each context that has not seen the
byte, with bytes already excluded by longer contexts left out, down to a uniform choice. Statistics are frozen after
training, so code lengths are exact and do not depend on the order of texts: a text's is the sum over the bytes of its UTF-8
form, each after the ``ORDER`` bytes before it (fewer at the beginning), times how often such runs occur. The language with the
shortest code wins. Code lengths are kept for each longest known context and byte.

Training takes a bounded sample: for each language the ``MAX_TEXTS`` rows with the smallest hash of their id, of longer ones the
first ``MAX_TRAIN_CHARS`` characters. Counting runs in Spark; the driver receives the tree. Every text is scored whole.

Defined cases: null text and text without a letter: ``und`` with score 0; no training text at all: ``und``; equal code
lengths: the alphabetically first language; null ids do not train; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_mod, per_text, table

ORDER, MAX_TEXTS, MAX_TRAIN_CHARS = 4, 400, 20_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes whose runs are counted at once.
STEP = 1 << 20


def raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def codes(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte a number made of how many bytes of context it has, ``order`` at most, these bytes, and itself."""
    out = data.astype(np.uint64)
    n = np.minimum(np.arange(len(data)), order).astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out | n << np.uint64(8 * (order + 1))


def grams(data: np.ndarray, order: int = ORDER) -> list[tuple[bytes, int, int]]:
    """(context, byte, times) of the runs of ``order`` bytes and the byte after them, fewer at the beginning."""
    found, times = np.unique(codes(data, order), return_counts=True)
    rows = []
    for code, t in zip(found.tolist(), times.tolist(), strict=True):
        n = code >> 8 * (order + 1)
        rows.append(((code >> 8 & (1 << 8 * n) - 1).to_bytes(n, "big"), code & 255, t))
    return rows


class Tree:
    """Context tree of one language: counts[context] = {byte: count}; a byte seen after a context is seen after its endings too."""

    def __init__(self, counts: dict[bytes, dict[int, int]]):
        self.counts = counts
        self.totals = {c: sum(seen.values()) + len(seen) for c, seen in counts.items()}
        self.rest: dict[bytes, tuple[int, int]] = {}

    def excluding(self, longer: bytes, context: bytes) -> tuple[int, int]:
        """Total and number of bytes of ``context`` without those of ``longer``, the next longer known one, which has all that are excluded."""
        found = self.rest.get(longer)
        if found is None:
            seen, gone = self.counts[context], self.counts[longer]
            found = self.rest[longer] = self.totals[context] - sum(map(seen.__getitem__, gone)) - len(gone), len(seen) - len(gone)
        return found

    def cost(self, context: bytes, symbol: int) -> float:
        """Bits of ``symbol`` after ``context`` (escape method C with exclusion)."""
        bits, longer = 0.0, None
        for i in range(len(context) + 1):
            at = context[i:]
            seen = self.counts.get(at)
            if not seen:
                continue
            total, n = (self.totals[at], len(seen)) if longer is None else self.excluding(longer, at)
            longer = at
            if not n:
                continue
            if symbol in seen:
                return bits - math.log2(seen[symbol] / total)
            bits -= math.log2(n / total)
        return bits + math.log2(256 - (len(self.counts[longer]) if longer is not None else 0))


class Identifier:
    """Code lengths of texts under the tree of each language."""

    def __init__(self, trees: dict[str, dict[bytes, dict[int, int]]], order: int = ORDER, limit: int = 1_000_000):
        self.languages, self.order, self.limit = sorted(trees), order, limit
        self.trees = [Tree(trees[name]) for name in self.languages]
        known = {c for t in self.trees for c in t.counts}
        # Contexts of each length that some language knows, in order; their numbers begin at ``first`` of the length.
        self.contexts = [np.array(sorted(int.from_bytes(c, "big") for c in known if len(c) == n), np.uint64) for n in range(order + 1)]
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in self.contexts])]).astype(np.uint64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.costs = np.zeros((8192, len(self.trees)))

    def nodes(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each code the number of the longest context that some language knows, and that context's length."""
        length = (found >> np.uint64(8 * (self.order + 1))).astype(np.int64)
        node, size, left = np.zeros(len(found), np.uint64), np.zeros(len(found), np.int64), np.ones(len(found), bool)
        for n in range(self.order, -1, -1):
            have = self.contexts[n]
            at = np.flatnonzero(left & (length >= n))
            if not len(at) or not len(have):
                continue
            context = found[at] >> np.uint64(8) & np.uint64((1 << 8 * n) - 1)
            place = np.minimum(np.searchsorted(have, context), len(have) - 1)
            good = have[place] == context
            node[at[good]], size[at[good]], left[at[good]] = self.first[n] + place[good].astype(np.uint64), n, False
        return node, size

    def bits(self, found: np.ndarray) -> np.ndarray:
        """The code length of each code's byte under each tree."""
        node, size = self.nodes(found)
        keys, one, back = np.unique(node << np.uint64(8) | found & np.uint64(255), return_index=True, return_inverse=True)
        names = keys.tolist()
        place = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        if len(self.known) + len(new) > self.limit:
            self.forget()
            new = np.arange(len(names))
        while len(self.known) + len(new) > len(self.costs):
            self.costs = np.vstack([self.costs, np.zeros_like(self.costs)])
        for k in new.tolist():
            code, n = int(found[one[k]]), int(size[one[k]])
            context = (code >> 8 & (1 << 8 * n) - 1).to_bytes(n, "big")
            self.costs[len(self.known)] = [t.cost(context, code & 255) for t in self.trees]
            place[k] = self.known[names[k]] = len(self.known)
        return self.costs[place][back]

    def lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text under each tree."""
        data, total = raw(text), np.zeros(len(self.trees))
        for i in range(0, len(data), STEP):
            begin = max(0, i - self.order)
            found = codes(data[begin : i + STEP], self.order)[i - begin :]
            found, times = np.unique(found, return_counts=True)
            # Sums of multiples of 2**-20 are exact, so that no order of bytes changes a comparison.
            total += (np.round(self.bits(found) * 1048576) * times[:, None]).sum(0)
        return total / 1048576

    def predict(self, text: str) -> tuple[str, float]:
        """The language of the shortest code, and its share of the weights 2**-bits, with bits for each root of the bytes."""
        if not self.trees or not any(c.isalpha() for w in LETTERS.findall(text) for c in w):  # "½" and the like are no letters
            return UNKNOWN, 0.0
        bits = self.lengths(text)
        best = int(bits.argmin())
        weight = np.exp2(-np.minimum((bits - bits[best]) / max(1.0, math.sqrt(len(text) / 6)), 1000))
        return self.languages[best], float(round(1 / weight.sum(), 9))


def fit(docs: DataFrame, max_texts: int = MAX_TEXTS, max_chars: int = MAX_TRAIN_CHARS, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[bytes, dict[int, int]]]:
    """Context counts of each language from a bounded sample of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    usable = rows.where("_id is not null and _lang is not null and _text is not null").withColumn("_text", F.substring("_text", 1, max_chars))
    # Ranked in parts first, so that a language which most texts have does not meet in one task. Equal rows are one.
    chosen = usable.select("_lang", "_id", F.xxhash64("_text").alias("_mark")).distinct().withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(64)))
    for keys in (["_lang", "_part"], ["_lang"]):
        rank = Window.partitionBy(*keys).orderBy(F.xxhash64("_id"), "_id", "_mark")
        chosen = chosen.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= max_texts).drop("_rank")
    named = usable.withColumn("_mark", F.xxhash64("_text")).join(F.broadcast(chosen.drop("_part")), ["_id", "_lang", "_mark"])
    sample = named.groupBy("_id", "_lang", "_mark").agg(F.first("_text").alias("_text"))

    def start():
        def count(text: str) -> list[tuple]:
            found: Counter = Counter()
            for context, byte, times in grams(raw(text), order):
                for i in range(len(context) + 1):
                    found[context[i:], byte] += times
            return [(c, b, n) for (c, b), n in found.items()]

        return count

    counted = per_text(sample, "context binary, byte int, n long", start, "_id", "_text", ("_lang",), many=True)
    trees: dict[str, dict[bytes, dict[int, int]]] = {}
    for row in counted.groupBy("_lang", "context", "byte").agg(F.sum("n").alias("n")).collect():
        trees.setdefault(row["_lang"], {}).setdefault(bytes(row["context"]), {})[row["byte"]] = row["n"]
    return trees


#: The trees that this process met last, and what it has learnt of them. Tasks that follow each other in a worker share it.
_KEPT: list = []


def identifier(trees: dict, order: int) -> Identifier:
    """An Identifier of these very trees: a broadcast is the same object in all tasks of a worker."""
    if not _KEPT or _KEPT[0] is not trees or _KEPT[1] != order:
        _KEPT[:] = [trees, order, Identifier(trees, order)]
    return _KEPT[2]


def identify(docs: DataFrame, trees: dict, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred and score for every row. The trees, bounded by the sample, are broadcast."""
    box = docs.sparkSession.sparkContext.broadcast(trees)

    def start():
        return identifier(box.value, order).predict

    return per_text(docs, "lang_pred string, score double", start, id_col, text_col, keep)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(id_mod(id_col, 4) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs.where(~held_out()))
    return identify(docs, trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
