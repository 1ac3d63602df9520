"""Toxicity by a convolutional text classifier (operator 7).

A word is the hashed embeddings of itself and of its beginnings side by side, so that inflected and compounded forms share
weight. Filters of one, two and three words slide over the whole text, each keeps its maximum, and a logistic layer weighs
the maxima. Embeddings start from the likelihood ratio of a hash's occurring in toxic and in other training texts and are then
trained together with the filters by stochastic gradient descent in numpy. A part of the training texts is held back to set
a threshold for each language, where the language is guessed from the words of the text; scores are shifted so that every
threshold is at ``CUT``.

Every labelled text trains, whole, whatever its length and class and whether or not it is a copy. Texts are dealt by a hash into
shards of about ``PER_SHARD``. In each epoch a task takes a shard through the steps from the model of the epoch before, and the
shards' models are averaged: a word's embedding over the shards that moved it, the rest over all, by their numbers of texts. Sums
are of whole numbers, so the model does not depend on which task did what. Up to ``PER_SHARD`` texts that is plain descent.

Defined cases: null text is empty text; without a word the maxima are 0 and the score is low; without labels of both classes
every score is 0; null ids and null labels do not train; an id that several label rows name is toxic if one says so; rows that
repeat an id and its text train once and are scored each; different texts under an id all train; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, id_mod, per_text, table

CUT = 0.7
#: Texts that one task takes through an epoch, and those of a step of descent.
PER_SHARD, PER_STEP = 4096, 64
EPOCHS, RATE, SEED = 6, 0.05, 7
#: Words that are embedded at once: longer texts go in pieces.
PIECE = 20_000
#: Averages are sums of multiples of 1 / UNIT, scores that thresholds are set by are multiples of 1 / BINS.
UNIT, BINS = 1 << 32, 1 << 12
WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of a word's hashed beginnings.
BEGINNINGS = (4, 5)
#: Frequent words by which the language of a text is guessed.
FREQUENT = {
    "en": "the of and to in is that it was for with this",
    "de": "der die und den das ist nicht ein eine sich auf mit",
    "fr": "le les des et est une dans pour pas du qui sur",
    "es": "el los las del por con para su lo como más y",
}
LANGUAGES = [*FREQUENT, "other"]
_VOTE = {w: k for k, words in enumerate(FREQUENT.values()) for w in words.split()}


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 18
    dims: int = 4
    widths: tuple = (1, 2, 3)
    filters: int = 8

    @property
    def wide(self) -> int:
        """Values of a word: those of its hashes side by side."""
        return self.dims * (1 + len(BEGINNINGS))


@dataclass
class Model:
    shape: Shape
    embedding: np.ndarray
    kernels: list
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    scale: float = 1.0


def features(word: str, buckets: int) -> list[int]:
    """Hash buckets of a word and its beginnings; a beginning no longer than the word is the word itself again."""
    parts = [word, *(word[:k] for k in BEGINNINGS)]
    return [zlib.crc32(f"{i} {p}".encode("utf-8", "surrogatepass")) % buckets for i, p in enumerate(parts)]


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def guess(words: list[str]) -> int:
    votes = np.bincount([_VOTE.get(w, len(FREQUENT)) for w in words], minlength=len(LANGUAGES))[: len(FREQUENT)]
    return int(votes.argmax()) if votes.any() else len(FREQUENT)


def _pool(model: Model, x: np.ndarray, starts: np.ndarray, most: int | None = None):
    """Maxima of each filter over each text and where they are. ``x``: words of all texts, each text followed by padding.

    ``most``: how many places of a text count, where it goes on in the next one.
    """
    values, places, k0 = [], [], 0
    for w, kernel in zip(model.shape.widths, model.kernels, strict=True):
        n = len(x) - w + 1
        y = sum(x[j : j + n] @ kernel[j] for j in range(w)) + model.bias[k0 : k0 + model.shape.filters]
        k0 += model.shape.filters
        y = np.maximum(np.vstack([y, np.full((w - 1, y.shape[1]), -1.0, y.dtype)]), 0)
        v, p = [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            end = b - w + 1 if most is None else min(b - w + 1, a + most)  # no window reaches into the next text
            at = y[a:end].argmax(0)
            p.append(a + at)
            v.append(y[a + at, np.arange(y.shape[1])])
        values.append(np.array(v))
        places.append(np.array(p))
    return np.hstack(values), places


def _spread(texts: list[np.ndarray], model: Model):
    """Embedded words of several texts, one vector of zeros at least after each, and where each begins."""
    pad = max(model.shape.widths)
    lengths = [len(t) + pad for t in texts]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    x = np.zeros((starts[-1], model.shape.wide), np.float32)
    for t, a in zip(texts, starts[:-1], strict=True):
        if len(t):
            x[a : a + len(t)] = model.embedding[t].reshape(len(t), -1)
    return x, starts


def _best(model: Model, texts: list[np.ndarray]):
    """``_pool`` of texts of any length: maxima, and for each width the places in the text. Long texts go in pieces that overlap."""
    values, places = np.zeros((len(texts), len(model.bias))), [np.zeros((len(texts), model.shape.filters), np.int64) for _ in model.shape.widths]
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    ends = np.cumsum([len(texts[i]) for i in short])
    for group in np.split(np.array(short, np.int64), np.searchsorted(ends, np.arange(5 * PIECE, ends[-1] if short else 0, 5 * PIECE))):
        if len(group):
            x, starts = _spread([texts[i] for i in group], model)
            values[group], found = _pool(model, x, starts)
            for to, place in zip(places, found, strict=True):
                to[group] = place - starts[:-1, None]
    for i in set(range(len(texts))) - set(short):
        t, f = texts[i], model.shape.filters
        for a in range(0, len(t), PIECE):
            piece, last = t[a : a + PIECE + max(model.shape.widths) - 1], a + PIECE >= len(t)
            v, found = _pool(model, *_spread([piece], model), None if last else PIECE)
            for k, place in enumerate(found):
                own = slice(k * f, (k + 1) * f)
                higher = (v[0, own] > values[i, own]) | (a == 0)
                places[k][i], values[i, own] = np.where(higher, a + place[0], places[k][i]), np.where(higher, v[0, own], values[i, own])
    return values, places


def _logits(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    out = [_best(model, texts[i : i + 128])[0] @ model.out + model.out_bias for i in range(0, len(texts), 128)]
    return np.concatenate(out) if out else np.zeros(0)


def _held_back(labels: np.ndarray) -> np.ndarray:
    """Every fourth text of each class: those that thresholds are set by."""
    held = np.zeros(len(labels), bool)
    for y in (0, 1):
        held[np.flatnonzero(labels == y)[3::4]] = True
    return held


def _seen(texts: list[np.ndarray], labels: np.ndarray, buckets: int) -> np.ndarray:
    """How many texts of each class hold each bucket."""
    seen = np.zeros((2, buckets), np.int64)
    for t, y in zip(texts, labels, strict=True):
        seen[y, np.unique(t)] += 1
    return seen


def _first(seen: np.ndarray, own: np.ndarray, shape: Shape, seed: int) -> Model:
    """The model before the first step. ``own``: how many texts of each class ``seen`` counts."""
    rng = np.random.default_rng(seed)
    n = np.maximum(own, 1).astype(np.float64)[:, None]
    share = seen.sum(0) / n.sum()
    expected = np.maximum(share * n, 1e-9)
    ratio = 2 * (seen * np.log(np.maximum(seen, 1e-9) / expected) * (seen > 0)).sum(0) + 2 * ((n - seen) * np.log(np.maximum(n - seen, 1e-9) / np.maximum(n - expected, 1e-9)) * (n > seen)).sum(0)
    z = np.sign(seen[1] / n[1] - seen[0] / n[0]) * np.sqrt(np.maximum(ratio, 0))
    embedding = rng.normal(0, 0.01, (shape.buckets, shape.dims)).astype(np.float32)
    embedding[:, 0] = np.clip(z, -8, 12) / 4
    kernels = [rng.normal(0, 0.05, (w, shape.wide, shape.filters)).astype(np.float32) for w in shape.widths]
    hashes = shape.wide // shape.dims
    for w, kernel in zip(shape.widths, kernels, strict=True):  # a filter for each kind of hash, one for their sum, the others free
        for k in range(hashes):
            kernel[:, k * shape.dims, k] += 1 / w
        kernel[:, :: shape.dims, hashes] += 1 / (w * hashes)
    bias = np.zeros(len(shape.widths) * shape.filters, np.float32)
    out = np.full(len(bias), 1 / len(bias), np.float32)
    bias -= 1
    return Model(shape, embedding, kernels, bias, out, -1.0)


def _step(model: Model, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, step: float) -> None:
    """One step of descent on a few texts. Only the words at the filters' maxima have a gradient."""
    shape, f = model.shape, model.shape.filters
    pooled, places = _best(model, texts)
    p = 1 / (1 + np.exp(-(pooled @ model.out + model.out_bias)))
    error = (np.clip((p - labels) * weight, -1, 1) / len(texts)).astype(np.float32)
    back = (np.outer(error, model.out) * (pooled > 0)).astype(np.float32)
    none = np.zeros((1, shape.wide // shape.dims), np.int32)
    words = np.concatenate([*texts, none])
    length = np.array([len(t) for t in texts])[:, None]
    first, moved, by = np.cumsum(length, 0) - length, [], []
    for k, (w, kernel, place) in enumerate(zip(shape.widths, model.kernels, places, strict=True)):
        g = back[:, k * f : (k + 1) * f]
        for j in range(w):
            inside = place + j < length  # beyond a text's end is padding, which is zero and stays so
            at = words[np.where(inside, first + place + j, -1)]
            x = model.embedding[at].reshape(*place.shape, shape.wide) * inside[:, :, None]
            hit = inside & (g != 0)
            moved.append(at[hit])
            by.append((g[:, :, None] * kernel[j].T[None])[hit].reshape(-1, none.shape[1], shape.dims))
            kernel[j] -= step * np.einsum("tf,tfe->ef", g, x)
    np.subtract.at(model.embedding, np.concatenate(moved), step * np.concatenate(by))
    model.bias -= step * back.sum(0)
    model.out -= (step * (error @ pooled)).astype(np.float32)
    model.out_bias -= step * float(error.sum())


def _epoch(model: Model, texts: list[np.ndarray], labels: np.ndarray, classes: np.ndarray, epoch: int, rate: float, rng: np.random.Generator) -> None:
    """Steps through all ``texts`` in a random order. ``classes``: texts of each class in all, by which classes weigh alike."""
    weight = (classes.sum() / (2 * np.maximum(1, classes)))[labels]
    for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // PER_STEP)):
        if len(part):
            _step(model, [texts[i] for i in part], labels[part], weight[part], rate / (1 + epoch))


def train(texts: list[np.ndarray], labels: np.ndarray, languages: np.ndarray, shape: Shape = Shape(), epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit in this process on all of the texts given, as (words, features) arrays of buckets: what ``fit`` does with one shard."""
    held, classes = _held_back(labels), np.bincount(labels, minlength=2)
    own, y = [t for t, h in zip(texts, held, strict=True) if not h], labels[~held]
    model = _first(_seen(own, y, shape.buckets), np.bincount(y, minlength=2), shape, seed)
    for epoch in range(epochs):
        _epoch(model, own, y, classes, epoch, rate, np.random.default_rng([seed, epoch, 0]))
    if labels[held].sum() < 8:  # too few to set a cut by
        held[:] = True
    scores = _logits(model, [texts[i] for i in np.flatnonzero(held)])
    model.thresholds, model.scale = thresholds(scores, labels[held], languages[held])
    return model


def thresholds(scores: np.ndarray, labels: np.ndarray, languages: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The best cut for each language, and a steepness that puts most scores near 0 or 1; few texts: the cut over all.

    ``counts``: how many texts each score stands for, one if not given.
    """
    n = np.ones(len(scores)) if counts is None else counts

    def best(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        s, y, n = s[order], y[order], n[order]
        f = 1.25 * np.cumsum(y * n) / (0.25 * (y * n).sum() + np.cumsum(n))
        f[:-1][s[:-1] == s[1:]] = -1
        k = int(f.argmax())
        return float(s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 1)) / 2

    if not len(scores) or not labels.any() or labels.all():
        middle = float(scores.max()) + 1 if len(scores) else 0.0
        return np.full(len(LANGUAGES), middle), 1.0
    cuts = np.full(len(LANGUAGES), best(scores, labels, n))
    for k in range(len(LANGUAGES)):
        own = languages == k
        if (labels * n)[own].sum() >= 5 and ((1 - labels) * n)[own].sum() >= 30:
            cuts[k] = best(scores[own], labels[own], n[own])
    spread = np.sqrt(np.average((scores - np.average(scores, weights=n)) ** 2, weights=n))
    return cuts, 4 / max(1e-6, float(spread))


class Scorer:
    """Scores of whole texts; what the filters give for a word is computed once for each word that is remembered."""

    def __init__(self, model: Model, limit: int = 100_000):
        self.model, self.limit = model, limit
        self.kernel = np.hstack([k[j] for k in model.kernels for j in range(len(k))])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((4096, self.kernel.shape[1]), np.float32)
        self.votes = np.zeros(4096, np.int8)

    def _learn(self, words: list[str]) -> None:
        first, m = len(self.known), self.model
        while first + len(words) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.votes = np.concatenate([self.votes, np.zeros_like(self.votes)])
        ids = np.array([features(w, m.shape.buckets) for w in words])
        self.rows[first : first + len(words)] = m.embedding[ids].reshape(len(ids), -1) @ self.kernel
        self.votes[first : first + len(words)] = [_VOTE.get(w, len(FREQUENT)) for w in words]
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def _block(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if len(self.known) + len(new) > self.limit:
            self.forget()
            new = list(dict.fromkeys(words))
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def pooled(self, words: list[str], block: int = 20_000) -> tuple[np.ndarray, int]:
        """Maxima over the whole text, taken in blocks that overlap by a filter's width."""
        m, f = self.model, self.model.shape.filters
        best, votes, overlap = np.zeros(len(m.bias), np.float32), np.zeros(len(LANGUAGES), np.int64), max(m.shape.widths) - 1
        for i in range(0, len(words), block):
            at = self._block(words[i : i + block + overlap])
            y = np.vstack([self.rows[at], np.zeros((overlap, self.kernel.shape[1]), np.float32)])
            votes += np.bincount(self.votes[at[:block]], minlength=len(LANGUAGES))
            k0 = 0
            for k, w in enumerate(m.shape.widths):
                n = len(at)
                s = y[:n, k0 : k0 + f].copy()
                for j in range(1, w):
                    s += y[j : j + n, k0 + j * f : k0 + (j + 1) * f]
                k0 += w * f
                best[k * f : (k + 1) * f] = np.maximum(best[k * f : (k + 1) * f], s.max(0) + m.bias[k * f : (k + 1) * f])
        votes = votes[: len(FREQUENT)]
        return best, int(votes.argmax()) if votes.any() else len(FREQUENT)

    def score(self, text: str) -> float:
        m = self.model
        best, language = self.pooled(words_of(text))
        z = (float(best @ m.out) + m.out_bias - m.thresholds[language]) * m.scale + np.log(CUT / (1 - CUT))
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9)


SHARD = "shard int, texts int, words binary, ids binary, lengths binary, labels binary, languages binary"


def _pack(texts: list[str], labels: list[int], buckets: int) -> dict:
    """A shard's texts as the buckets of its different words, and for all texts in a row the numbers of their words."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__  # a new word gets the next number
    ids, languages = [], []
    for text in texts:
        words = words_of(text)
        ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        languages.append(guess(words))
    small = lambda x, kind: pa.compress(np.ascontiguousarray(x, kind), "lz4", asbytes=True)
    words = np.array([features(w, buckets) for w in known], np.int32)
    return {"texts": len(texts), "words": small(words, np.int32), "ids": small(np.concatenate(ids), np.int32), "lengths": np.array([len(x) for x in ids], np.int64).tobytes(), "labels": np.array(labels, np.int8).tobytes(), "languages": np.array(languages, np.int8).tobytes()}


def _unpack(row: dict, buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Texts, labels and languages of a shard."""
    lengths, hashes = np.frombuffer(row["lengths"], np.int64), 1 + len(BEGINNINGS)
    ids = np.frombuffer(pa.decompress(row["ids"], 4 * int(lengths.sum()), "lz4"), np.int32)
    words = np.frombuffer(pa.decompress(row["words"], 4 * hashes * (int(ids.max()) + 1 if len(ids) else 0), "lz4"), np.int32).reshape(-1, hashes)
    ends = np.cumsum(lengths)
    return [words[ids[b - n : b]] for n, b in zip(lengths, ends, strict=True)], np.frombuffer(row["labels"], np.int8).astype(np.int64), np.frombuffer(row["languages"], np.int8).astype(np.int64)


def _shards(docs: DataFrame, labels: DataFrame, shape: Shape, per_shard: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """All rows of ``docs`` that ``labels`` names, a row for each shard. A text's shard and its place there follow from itself and its id."""
    marks = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    n = -(-ids.join(marks, "_id").count() // per_shard)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(marks, "_id").dropDuplicates(["_id", "_text"])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_id", "_text"), F.lit(max(1, n))).cast("int")).repartition(max(1, n), "shard")

    def pack(group: pa.Table) -> pa.Table:
        found = zip(group["_id"].to_pylist(), group["_text"].to_pylist(), group["_y"].to_pylist(), strict=True)
        found = sorted(found, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
        row = {"shard": group["shard"][0].as_py(), **_pack([r[1] for r in found], [r[2] for r in found], shape.buckets)}
        return pa.table({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for k, v in row.items()})

    return cut_lineage(rows.groupBy("shard").applyInArrow(pack, SHARD))


def _over(shards: DataFrame, schema: str, found) -> pa.Table:
    """Sums of what ``found`` gives for each shard, columns of whole numbers as in ``schema``, by the columns not named ``n``, ``n0``, ..."""
    names = [c.split()[0] for c in schema.split(", ")]
    sums = [c for c in names if re.fullmatch(r"n\d*", c)]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                columns = found(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=names)

    return shards.mapInArrow(run, schema).groupBy(*(c for c in names if c not in sums)).agg(*(F.sum(c).alias(c) for c in sums)).toArrow()


def fit(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model | None:
    """Train on all rows of ``docs`` that ``labels`` names; None without texts of both classes. The driver holds the model only."""
    shards, buckets, context = _shards(docs, labels, shape, per_shard, id_col, text_col, label_col), shape.buckets, docs.sparkSession.sparkContext

    def counted(row: dict):
        texts, y, _ = _unpack(row, buckets)
        held = _held_back(y)
        seen = _seen([t for t, h in zip(texts, held, strict=True) if not h], y[~held], buckets)
        kind, at = np.nonzero(seen)  # own texts of each class count as bucket -1, those held back as bucket -2
        return np.concatenate([kind, [0, 1, 0, 1]]), np.concatenate([at, [-1, -1, -2, -2]]), np.concatenate([seen[kind, at], np.bincount(y[~held], minlength=2), np.bincount(y[held], minlength=2)])

    rows = _over(shards, "y long, at long, n long", counted)
    y, at, n = (rows[c].to_numpy() for c in ("y", "at", "n"))
    seen = np.zeros((2, buckets + 2), np.int64)
    seen[y, at] = n
    own, back = seen[:, -1], seen[:, -2]
    classes = own + back
    if not classes.all():
        return None
    model = _first(seen[:, :buckets], own, shape, seed)
    for epoch in range(epochs):
        model = _averaged(shards, context, model, classes, epoch, rate, seed)
    box = context.broadcast(model)
    few = back[1] < 8  # too few to set a cut by

    def scored(row: dict):
        texts, y, languages = _unpack(row, buckets)
        held = _held_back(y) | few
        score = np.rint(_logits(box.value, [texts[i] for i in np.flatnonzero(held)]) * BINS)
        return score, y[held], languages[held], np.ones(held.sum())

    rows = _over(shards, "score long, y long, language long, n long", scored).sort_by([("score", "ascending"), ("y", "ascending"), ("language", "ascending")])
    box.unpersist()
    model.thresholds, model.scale = thresholds(rows["score"].to_numpy() / BINS, *(rows[c].to_numpy() for c in ("y", "language", "n")))
    return model


def _flat(model: Model) -> np.ndarray:
    """All that is trained besides embeddings, in rows as long as an embedding."""
    values = np.concatenate([*(k.ravel() for k in model.kernels), model.bias, model.out, [model.out_bias]]).astype(np.float64)
    return np.pad(values, (0, -len(values) % model.shape.dims)).reshape(-1, model.shape.dims)


def _averaged(shards: DataFrame, context, model: Model, classes: np.ndarray, epoch: int, rate: float, seed: int) -> Model:
    """The model after one more epoch: the mean of what each shard makes of it."""
    shape, box = model.shape, context.broadcast(model)
    schema = ", ".join(f"{c} long" for c in ("at", "n", *(f"n{k}" for k in range(shape.dims))))

    def moved(row: dict):
        texts, y, _ = _unpack(row, shape.buckets)
        held, old = _held_back(y), box.value
        new = Model(shape, old.embedding.copy(), [k.copy() for k in old.kernels], old.bias.copy(), old.out.copy(), old.out_bias)
        _epoch(new, [t for t, h in zip(texts, held, strict=True) if not h], y[~held], classes, epoch, rate, np.random.default_rng([seed, epoch, row["shard"]]))
        at = np.flatnonzero((new.embedding != old.embedding).any(1))
        change = np.concatenate([new.embedding[at].astype(np.float64) - old.embedding[at], _flat(new) - _flat(old)])
        at = np.concatenate([at, shape.buckets + np.arange(len(change) - len(at))])
        n = int((~held).sum())
        return at, np.full(len(at), n), *np.rint(change * n * UNIT).T

    rows = _over(shards, schema, moved)
    box.unpersist()
    at, n = rows["at"].to_numpy(), np.maximum(rows["n"].to_numpy(), 1)
    change = np.stack([rows[f"n{k}"].to_numpy() for k in range(shape.dims)], 1) / UNIT / n[:, None]
    word = at < shape.buckets
    embedding = model.embedding.copy()
    embedding[at[word]] += change[word].astype(np.float32)
    flat = _flat(model)
    flat[at[~word] - shape.buckets] += change[~word]
    *parts, last = np.split(flat.ravel(), np.cumsum([*(k.size for k in model.kernels), len(model.bias), len(model.out)]))
    parts = [x.astype(np.float32) for x in parts]
    return Model(shape, embedding, [x.reshape(k.shape) for x, k in zip(parts, model.kernels, strict=False)], parts[-2], parts[-1], float(last[0]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, score and predicted (1 from CUT on). The model has a fixed size and is broadcast."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        if box.value is None:
            return lambda text: (0.0, 0)
        scorer = Scorer(box.value)
        return lambda text: ((s := scorer.score(text)), int(s >= CUT))

    return per_text(docs, "score double, predicted int", start, id_col, text_col, keep)


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows whose text the classifier rejects; all columns as they were."""
    model = model or fit(docs.where(~train_held_out()), labels)
    # A text goes to Python once: what it scores comes back with it, and the other columns beside it.
    rest = F.struct(F.col("text").isNull().alias("_none"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns) if c != "text"])
    box = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        if box.value is None:
            return lambda text: (text, 0)
        scorer = Scorer(box.value)
        return lambda text: (text, int(scorer.score(text) >= CUT))

    kept = per_text(docs.select(rest.alias("_row"), "doc_id", "text"), "text string, predicted int", start, keep=("_row",)).where("predicted = 0")
    return kept.select(*[(F.when(~F.col("_row._none"), F.col("text")) if c == "text" else F.col(f"_row._{k}")).alias(c) for k, c in enumerate(docs.columns)])


def train_held_out(id_col: str = "doc_id"):
    """Rows that do not train: crc32 of the id modulo 3 is 1, or the id is null (its row cannot be named by a label)."""
    return F.coalesce(id_mod(id_col, 3) == 1, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(~train_held_out()), labels.where(~train_held_out()))
    return score(docs, model).select("doc_id", F.coalesce(id_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
