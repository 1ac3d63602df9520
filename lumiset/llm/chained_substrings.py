"""Repeated passages by collinear chaining (operator 10).

Of the word k-mers of a text, minimizers over ``SPAN`` of them are seeds: any run of ``K + SPAN - 1`` words that two texts
share gives both the same seed. A seed's place in the corpus is its first one (smallest id); every other text is matched to
that, so a passage in n texts gives n - 1 matches and not n^2. An n-th occurrence inside a text is matched to an n-th
occurrence, and to a first one too, so that repeated lines and runs of one word line up. The matches of two texts are joined
along diagonals, and runs are chained in order with linear gap costs through a Fenwick tree of prefix maxima. Chains are then
aligned on the words of both texts, over substitutions, insertions and deletions: outwards from the chain's start, and again
from the next words in common wherever the alignment ends before the chain does, so a chain may give several passages. Of a
stretch that agrees too little as a whole the longest parts that agree enough are taken. Passages of ``MIN_WORDS`` words or more, of which at least ``IDENTITY`` in a hundred agree, are reported.

A passage is missed by this if its seeds all come first in texts that hold only pieces of it. So a second pass takes the
windows of MIN_WORDS words whose seeds all come from earlier texts and that no passage covers. Each of them, and its equal in
any text, has a seed near its beginning, whose surroundings in the window (MIN_WORDS - SPAN + 1 words) are equal too; so only
windows around seeds with such surroundings in an earlier text are left. They are matched to the first text with the same
words; those on one diagonal are one passage, and of a text's passages so many are reported as cover all. Each exact repeat
of MIN_WORDS words is thereby covered; inexact ones are found by seeds alone.

A seed that many texts have is not gathered: of seeds with over ``HOT`` of all rows, of which there are 1 / HOT at most, only
the first places are taken together, and they are broadcast.

Defined cases: null and empty texts and texts under MIN_WORDS words have no passage; rows with null ids take no part; rows that
repeat an id and its text count as one text. Rows that repeat an id with different texts are different texts: the one with the
smallest digest stands at the id's place in the order, the others after all ids; passages and cuts are each text's own.
Passages inside one text only are not reported; an empty table gives an empty result; extra columns are ignored. Words are runs
without white space, A-Z in lower case.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import digest_ranks
from .common import MIX, WORD, cut_lineage, mix64, table, word_hashes, words_of, written

K, SPAN = 6, 12
MIN_WORDS, IDENTITY = 50, 80
#: Words that a gap between runs costs, for each word of it in either text; a chain is cut at gaps over MAX_GAP words.
GAP_COST, MAX_GAP = 0.2, 40
#: A chain that spans fewer words than this is not aligned: MIN_WORDS words in common span more.
MIN_CHAIN = K + 1
#: Words around a chain that are read for its alignment, and to what multiple places are rounded so that readers share slices.
AROUND, GRAIN = 128, 64
#: An alignment passes over at most this many words in one text or both, and goes on where SURE words in a row agree.
SLIP, SURE = 8, 3
#: The share of all seeds from which one is hot.
HOT = 0.001
_STEP = 50_000


def gram_hashes(hashes: np.ndarray, k: int = K) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * MIX + hashes[i : n + i]
    return mix64(out)


def minimizers(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Places of the smallest of every ``span`` grams in a row, the first of equals; of fewer grams the smallest."""
    n = len(grams)
    if n <= span:
        return np.array([grams.argmin()]) if n else np.zeros(0, np.int64)
    found = []
    for a in range(0, n - span + 1, _STEP):
        view = np.lib.stride_tricks.sliding_window_view(grams[a : a + _STEP + span - 1], span)
        found.append(view.argmin(1) + np.arange(a, a + len(view)))
    at = np.concatenate(found)  # never descends, as the first of equals is taken
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def occurrence(values: np.ndarray) -> np.ndarray:
    """For each value how often it came before, from 0."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(values) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - begin
    return out


def seeds(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, pos, around): the seeds of each text by their number in it, and later ones by the first's number too.

    ``around`` is 32 bits of a hash of the ``min_words - SPAN + 1`` words of which SPAN - 1 stand before the seed; null where there
    are fewer. It tells apart the places of one seed.
    """
    width = min_words - SPAN + 1
    offsets = [*range(0, width - K, K), width - K]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out, sizes = batch.slice(i, 256), [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    if len(words) < min_words:
                        sizes.append(0)
                        continue
                    grams = gram_hashes(word_hashes(words))
                    at = minimizers(grams)
                    hashes = grams[at]
                    nth = occurrence(hashes)
                    first, around = at - SPAN + 1, np.zeros(len(at), np.uint64)
                    whole = (first >= 0) & (first + width - K < len(grams))
                    with np.errstate(over="ignore"):
                        keys = np.where(nth > 0, mix64(hashes + MIX * nth.astype(np.uint64)), hashes)
                        for o in offsets:
                            around = mix64(around * MIX + grams[np.where(whole, first + o, 0)])
                    later = np.flatnonzero(nth > 0)
                    row = np.concatenate([np.arange(len(at)), later])
                    out.append((np.concatenate([keys, hashes[later]]).view(np.int64), at[row].astype(np.int32), around[row].astype(np.uint32).view(np.int32), ~whole[row]))
                    sizes.append(len(row))
                if out:
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                    key, pos, around, none = map(np.concatenate, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(key), pa.array(pos), pa.array(around, mask=none)], names=["doc_id", "key", "pos", "around"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, pos int, around int")


def matched(seeded: DataFrame) -> DataFrame:
    """(doc_id, pos, around, source_id, ref): the seeds that several texts have, each with its first place in the corpus."""
    hot = seeded.freqItems(["key"], HOT).first()[0] or []
    columns = ["doc_id", "pos", "around", "source_id", "ref"]
    group = Window.partitionBy("key")
    order = group.orderBy("doc_id", "pos")
    cold = seeded.where(~F.col("key").isin(hot)) if hot else seeded
    rows = cold.withColumns({"source_id": F.first("doc_id").over(order), "ref": F.first("pos").over(order), "_last": F.max("doc_id").over(group)}).where("source_id != _last").select(columns)
    if not hot:
        return rows
    hot_rows = seeded.where(F.col("key").isin(hot))
    firsts = hot_rows.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("_f"), F.max("doc_id").alias("_last")).where("_f.doc_id != _last").select("key", F.col("_f.doc_id").alias("source_id"), F.col("_f.pos").alias("ref"))
    return rows.union(hot_rows.join(F.broadcast(firsts), "key").select(columns))


class Fenwick:
    """Maxima of prefixes: the best (value, index) among places up to one."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, place: int, value: float, index: int) -> None:
        place += 1
        while place < len(self.best):
            if self.best[place][0] < value:
                self.best[place] = (value, index)
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        out = (-np.inf, -1)
        place += 1
        while place > 0:
            out = max(out, self.best[place])
            place -= place & -place
        return out


def runs(pos: np.ndarray, ref: np.ndarray, k: int = K, max_gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """(start, end, place in the other text) of matches that follow each other on one diagonal, ends exclusive."""
    order = np.lexsort((pos, pos - ref))
    pos, diagonal = pos[order], (pos - ref)[order]
    cut = np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > max_gap)])
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    return sorted(zip(pos[first].tolist(), (pos[last] + k).tolist(), (pos[first] - diagonal[first]).tolist(), strict=True))


def chains(found: list[tuple[int, int, int]], gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int, int]]]:
    """Chains of runs that ascend in both texts, best first; no run is in two. A run weighs its words, a gap costs its own."""
    if len(found) == 1:
        return [found]
    ends = [r + e - s for s, e, r in found]
    place = {v: i for i, v in enumerate(sorted(set(ends)))}
    starts = np.searchsorted(np.array(sorted(place)), [r for _, _, r in found], side="right") - 1
    tree, score, before = Fenwick(len(place)), [0.0] * len(found), [-1] * len(found)
    waiting = sorted(range(len(found)), key=lambda i: found[i][1])
    w = 0
    for i, (s, e, r) in enumerate(found):
        while w < len(waiting) and found[waiting[w]][1] <= s:
            j = waiting[w]
            tree.put(place[ends[j]], score[j] + gap_cost * (found[j][1] + ends[j]), j)
            w += 1
        value, j = tree.upto(int(starts[i]))
        value -= gap_cost * (s + r)
        score[i] = e - s + max(0.0, value)
        before[i] = j if value > 0 else -1
    out, used = [], [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(found[i])
            i = before[i]
        if chain:
            part = [chain[-1]]
            for s, e, r in chain[-2::-1]:
                if s - part[-1][1] > max_gap or r - (part[-1][2] + part[-1][1] - part[-1][0]) > max_gap:
                    out.append(part)
                    part = []
                part.append((s, e, r))
            out.append(part)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int, step: int = 4096):
    rows = (row for batch in batches for i in range(0, batch.num_rows, step) for row in zip(*(c.to_pylist() for c in batch.slice(i, step).columns), strict=True))
    return itertools.groupby(rows, key=lambda r: r[:keys])


def stretches(pos: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(first, end) of the windows of ``min_words`` words whose seeds may all be among those at ``pos``, by their first words.

    Seeds are at most SPAN apart, and a window's own begin within SPAN words of its start and end within SPAN of its last gram.
    """
    if not len(pos):
        return []
    pos = np.unique(pos)
    cut = np.flatnonzero(np.diff(pos) > SPAN)
    first, last = pos[np.concatenate([[0], cut + 1])], pos[np.concatenate([cut, [len(pos) - 1]])]
    lo, hi = np.maximum(first - SPAN + 1, 0), last - (min_words - K - SPAN)
    return [(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]


def without(ranges: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of ``ranges`` (ascending) without ``taken`` (ascending)."""
    out = []
    for a, b in ranges:
        for c, d in taken:
            if c < b and d > a:
                out += [(a, c)] if a < c else []
                a = d
        out += [(a, b)] if a < b else []
    return out


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (ascending by start) that touch or overlap as one."""
    out = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def chain_matches(anchors: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, source_id, s, e, r, re, parts): extents of the chains between each two texts; ``anchors``: doc_id, source_id, pos, ref.

    ``parts`` has start, end and place in the other text of each run in a row, and is null for a single run. There are rows
    without source_id too: from s to e begin windows of ``min_words`` words whose seeds may all have anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (doc,), by_doc in _groups(batches, 1):
                seen = []
                for source, rows in itertools.groupby(by_doc, key=lambda r: r[1]):
                    _, _, pos, ref = (np.array(c) for c in zip(*rows, strict=True))
                    seen.append(pos)
                    for chain in chains(runs(pos, ref)):
                        s, e = chain[0][0], chain[-1][1]
                        if e - s >= MIN_CHAIN:
                            yield doc, source, s, e, chain[0][2], chain[-1][2] + chain[-1][1] - chain[-1][0], [x for run in chain for x in run] if len(chain) > 1 else None
                for s, e in stretches(np.concatenate(seen), min_words):
                    yield doc, None, s, e, None, None, None

        for part in itertools.batched(found(), 10_000):
            columns = list(zip(*part, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.int32()) for c in columns[2:6]), pa.array(columns[6], pa.list_(pa.int32()))], names=["doc_id", "source_id", "s", "e", "r", "re", "parts"])

    placed = anchors.select("doc_id", "source_id", "pos", "ref").repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "source_id", "pos", "ref")
    return placed.mapInArrow(run, "doc_id long, source_id long, s int, e int, r int, re int, parts array<int>")


def cover(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Few of the ranges, given by ascending starts, that cover all that any covers."""
    out, i, covered = [], 0, -1
    while i < len(starts):
        limit, best = max(covered, int(starts[i])), i
        while i < len(starts) and starts[i] <= limit:
            best = i if ends[i] > ends[best] else best
            i += 1
        if ends[best] > covered:
            out.append(best)
            covered = int(ends[best])
    return out


def exact_passages(anchors: DataFrame, width: int) -> DataFrame:
    """Passages of equal windows of ``width`` words; ``anchors``: doc_id, source_id, pos, ref."""
    names = ["doc_id", "start", "end", "source_id", "source_start", "source_end", "n_same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (doc,), group in _groups(batches, 1):
                source, pos, ref = np.array([r[1:] for r in group], np.int64).T
                order = np.lexsort((pos, pos - ref, source))
                source, pos, ref = source[order], pos[order], ref[order]
                cut = np.flatnonzero((np.diff(source) != 0) | (np.diff(pos - ref) != 0) | (np.diff(pos) > width)) + 1
                first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]]) - 1
                by_start = np.lexsort((source[first], pos[first]))
                first, last = first[by_start], last[by_start]
                for k in cover(pos[first], pos[last] + width):
                    a, b, n = first[k], last[k], pos[last[k]] + width - pos[first[k]]
                    yield doc, pos[a], pos[b] + width, source[a], ref[a], ref[b] + width, n

        for part in itertools.batched(found(), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*part, strict=True)], names=names)

    placed = anchors.select("doc_id", "source_id", "pos", "ref").repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "pos")
    return placed.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the start on are the same."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


_STEPS = np.add.outer(np.arange(SLIP + 1), np.arange(SLIP + 1)) * 64 + np.abs(np.subtract.outer(np.arange(SLIP + 1), np.arange(SLIP + 1)))


def resume(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """How many words of each to pass over until SURE words agree in a row, or all that are left of one text."""
    n, m = min(len(a), SLIP + SURE), min(len(b), SLIP + SURE)
    same = np.ones((SLIP + SURE, SLIP + SURE), bool)
    same[:n, :m] = a[:n, None] == b[None, :m]
    good = np.ones((SLIP + 1, SLIP + 1), bool)
    for k in range(SURE):
        good &= same[k : k + SLIP + 1, k : k + SLIP + 1]
    good[len(a) :] = False
    good[:, len(b) :] = False
    good[0, 0] = False
    if not good.any():
        return None
    return divmod(int(np.where(good, _STEPS, 1 << 30).argmin()), SLIP + 1)


def walk(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Align from the start on: (place in a, place in b, words that agree from there on) of each run.

    Where the texts differ, the nearest place follows at which they agree again: fewest words passed over first, then the
    most alike counts in both. Without one within SLIP words of each the alignment ends.
    """
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        n = agree(a[i:], b[j:])
        if n:
            out.append((i, j, n))
            i, j = i + n, j + n
        step = resume(a[i:], b[j:]) if i < len(a) and j < len(b) else None
        if step is None:
            break
        i, j = i + step[0], j + step[1]
    return out


def both_ways(a: np.ndarray, b: np.ndarray, s: int, r: int) -> list[tuple[int, int, int]]:
    """Runs of the alignment that goes through word s of a and r of b, in order."""
    left = [(s - i - n, r - j - n, n) for i, j, n in reversed(walk(a[:s][::-1], b[:r][::-1]))]
    return left + [(s + i, r + j, n) for i, j, n in walk(a[s:], b[r:])]


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Alignments, as runs (place in a, place in b, words that agree), that together hold all words in common of a chain's runs.

    The first goes out from the chain's start, and the next from the first K words in a row of a run that none holds so far.
    """
    out = [both_ways(a, b, chain[0][0], chain[0][2])]
    for s, e, r in chain:
        if holds(out[-1], s, e, r):
            continue
        same = a[s:e] == b[r : r + e - s]
        for i in np.flatnonzero(np.lib.stride_tricks.sliding_window_view(same, K).all(1)).tolist() if len(same) >= K else []:
            if not any(holds(x, s + i, s + i + K, r + i) for x in out[-2:]):
                out.append(both_ways(a, b, s + i, r + i))
    return out


def holds(found: list[tuple[int, int, int]], s: int, e: int, r: int) -> bool:
    return bool(found) and found[0][0] <= s and e <= found[-1][0] + found[-1][2] and found[0][1] <= r and r + e - s <= found[-1][1] + found[-1][2]


def passing(found: list[tuple[int, int, int]], min_words: int, identity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, words that agree) of an alignment, or else of its longest parts of enough agreement."""
    rows = np.array(found, np.int64).reshape(-1, 3)
    n = np.concatenate([[0], np.cumsum(rows[:, 2])])
    waiting = [(0, len(rows))]
    while waiting:
        x, y = waiting.pop()
        if x >= y:
            continue
        (i, j), (k, m) = rows[x, :2], rows[y - 1, :2] + rows[y - 1, 2]
        if min(k - i, m - j) < min_words:
            continue
        if 100 * (n[y] - n[x]) >= identity * max(k - i, m - j):
            yield int(i), int(k), int(j), int(m), int(n[y] - n[x])
            continue
        best = (min_words - 1, 0, 0)
        ends, others = rows[x:y, 0] + rows[x:y, 2], rows[x:y, 1] + rows[x:y, 2]
        for p in range(x, y):
            long, wide = ends[p - x :] - rows[p, 0], others[p - x :] - rows[p, 1]
            if min(long[-1], wide[-1]) <= best[0]:
                break
            good = np.flatnonzero(100 * (n[p + 1 : y + 1] - n[p]) >= identity * np.maximum(long, wide))
            if len(good) and (size := int(min(long[good[-1]], wide[good[-1]]))) > best[0]:
                best = (size, p, p + int(good[-1]) + 1)
        if best[2]:
            waiting += [(x, best[1]), best[1:], (best[2], y)]


def slices(docs: DataFrame, wanted: DataFrame, keep: tuple = ()) -> DataFrame:
    """(id, a, b, words, and booleans of ``keep``): hashes of words a to b of the texts named in ``wanted`` (id, a, b), which has no repeated row."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = wanted.hint("merge").join(texts, "id").select("id", "a", "b", "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashes = None, np.zeros(0, np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for a, b, text in zip(*(c.to_pylist() for c in part.columns[1:4]), strict=True):
                    if text is not last and text != last:
                        last, hashes = text, word_hashes(words_of(text))
                    out.append(hashes[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.binary()), *part.columns[4:]], names=["id", "a", "b", "words", *keep])

    return rows.mapInArrow(run, "id long, a int, b int, words binary" + "".join(f", {c} boolean" for c in keep))


def align_chains(chained: DataFrame, docs: DataFrame, min_words: int, identity: int) -> DataFrame:
    down = lambda c: (F.floor(F.greatest(F.col(c) - AROUND, F.lit(0)) / GRAIN) * GRAIN).cast("int")
    up = lambda c: (F.ceil((F.col(c) + AROUND) / GRAIN) * GRAIN).cast("int")
    asked = chained.withColumns({"a1": down("s"), "b1": up("e"), "a2": down("r"), "b2": up("re")})
    wanted = asked.select(F.col("doc_id").alias("id"), F.col("a1").alias("a"), F.col("b1").alias("b")).union(asked.select("source_id", "a2", "b2")).distinct()
    cut = cut_lineage(slices(docs, wanted))
    one = cut.select(F.col("id").alias("doc_id"), F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("words").alias("w1"))
    two = cut.select(F.col("id").alias("source_id"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("words").alias("w2"))
    both = asked.join(one, ["doc_id", "a1", "b1"]).join(two, ["source_id", "a2", "b2"]).select("doc_id", "source_id", "s", "e", "r", "parts", "a1", "a2", "w1", "w2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out = []
                for doc, source, s, e, r, parts, a1, a2, w1, w2 in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True):
                    chain = [(x - a1, y - a1, z - a2) for x, y, z in itertools.batched(parts or (s, e, r), 3)]
                    for found in align(np.frombuffer(w1, np.uint64), np.frombuffer(w2, np.uint64), chain):
                        out += [(doc, a1 + x1, a1 + y1, source, a2 + x2, a2 + y2, same) for x1, y1, x2, y2, same in passing(found, min_words, identity)]
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "end", "source_id", "source_start", "source_end", "n_same"])

    return both.mapInArrow(run, "doc_id long, start long, end long, source_id long, source_start long, source_end long, n_same long").distinct()


def by_text(rows: DataFrame, function, schema: str) -> DataFrame:
    """Rows of ``function(doc, [(a, b) of kind 0], [(a, b) of kind 1])`` for each text; ``rows``: doc_id, kind, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (doc,), group in _groups(batches, 1):
                kinds = [[], []]
                for _, kind, a, b in group:
                    kinds[kind].append((a, b))
                yield from function(doc, *kinds)

        for part in itertools.batched(found(), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*part, strict=True), types, strict=True)], names=names)

    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[k] for k in kinds]
    return rows.select("doc_id", "kind", F.col("a").cast("int"), F.col("b").cast("int")).repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "kind", "a", "b").mapInArrow(run, schema)


def uncovered(open_: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, lo, hi): the windows of ``open_`` (doc_id, s, e) that don't lie in reported passages, by their first words."""

    def left(doc, ranges, passages):
        for a, b in without(ranges, [(a, b - min_words + 1) for a, b in joined(passages) if b - a >= min_words]):
            yield doc, a, b

    marks = open_.select("doc_id", F.lit(0).alias("kind"), F.col("s").alias("a"), F.col("e").alias("b"))
    return by_text(marks.union(found.select("doc_id", F.lit(1), F.col("start"), F.col("end"))), left, "doc_id long, lo int, hi int")


def window_anchors(docs: DataFrame, ranges: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, source_id, pos, ref): windows of ``ranges`` (doc_id, lo, hi, asked) that are asked for, at their first places."""
    cut = slices(docs, ranges.select(F.col("doc_id").alias("id"), F.col("lo").alias("a"), (F.col("hi") - 1 + min_words).alias("b"), "asked"), ("asked",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                keys = [gram_hashes(np.frombuffer(w, np.uint64), min_words).view(np.int64) for w in part.column(3).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
                pos = np.concatenate([a + np.arange(len(x)) for a, x in zip(part.column(1).to_pylist(), keys, strict=True)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.concatenate(keys)), pa.array(pos), part.column(4).take(at)], names=["doc_id", "key", "pos", "asked"])

    windows = written(cut.mapInArrow(run, "doc_id long, key long, pos int, asked boolean"))
    firsts = windows.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("_f")).select("key", F.col("_f.doc_id").alias("source_id"), F.col("_f.pos").alias("ref"))
    return windows.where("asked").join(firsts, "key").where("doc_id != source_id")


def missed_passages(open_: DataFrame, found: DataFrame, hits: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """Exact repeats that ``found`` doesn't cover; ``open_``: where windows begin whose seeds all come from earlier texts."""
    asked = written(uncovered(open_, found, min_words))
    # A window has a seed that lies SPAN - 1 to 2 SPAN - 2 words behind its start, the same in all texts.
    near, far = SPAN - 1, 2 * SPAN - 2
    inside = (F.col("pos") >= F.col("lo") + near) & (F.col("pos") <= F.col("hi") - 1 + far)
    hits, same = hits.where("around is not null"), ["source_id", "ref", "around"]
    own = written(hits.where("doc_id != source_id").join(asked.hint("merge"), "doc_id").where(inside).select("doc_id", "pos", *same).distinct())
    places = written(hits.join(own.select(same).distinct(), same).select("doc_id", "pos", *same).distinct())
    earlier = places.groupBy(same).agg(F.min("doc_id").alias("_first")).join(own.groupBy(same).agg(F.max("doc_id").alias("_last")), same).where("_last > _first").select(same)
    kept = places.join(earlier, same).select("doc_id", F.lit(1).alias("kind"), F.col("pos").alias("a"), F.col("pos").alias("b")).distinct()

    def ranges(doc, wanted, at):
        starts = joined([(max(0, p - far), p - near + 1) for p, _ in at])
        rest = without(starts, wanted)
        yield from ((doc, a, b, True) for a, b in without(starts, rest))
        yield from ((doc, a, b, False) for a, b in rest)

    both = written(by_text(asked.select("doc_id", F.lit(0).alias("kind"), F.col("lo").alias("a"), F.col("hi").alias("b")).union(kept), ranges, "doc_id long, lo int, hi int, asked boolean"))
    return exact_passages(window_anchors(docs, both, min_words), min_words)


def text_numbers(rows: DataFrame) -> DataFrame | None:
    """(number, doc_id, digest): numbers beyond all ids for the texts of ``rows`` (doc_id, text) whose id has another text before
    them; None where each id has one text."""
    digest = F.md5(F.col("text"))
    several = rows.groupBy("doc_id").agg(F.min(digest).alias("_lo"), F.max(digest).alias("_hi")).where("_lo != _hi").select("doc_id", "_lo")
    several = written(several, "several")
    if several.isEmpty():
        return None
    more = rows.select("doc_id", digest.alias("digest")).distinct().join(several, "doc_id").where("digest != _lo").select("doc_id", "digest", F.lit(1).alias("_g"))
    last = rows.agg(F.max("doc_id")).first()[0]
    ranked = digest_ranks(more, ["_g"], F.md5(F.concat_ws("|", "doc_id", "digest")), ["doc_id", "digest"])
    return written(ranked.select((F.col("_r") + F.lit(last)).cast("long").alias("number"), "doc_id", "digest"), "numbers")


def with_numbers(rows: DataFrame, numbers: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rows`` with ``_number``: the id, or the number of a further text of it."""
    if numbers is None:
        return rows.withColumn("_number", F.col(id_col).cast("long"))
    keyed = rows.withColumns({"_id": F.col(id_col).cast("long"), "_digest": F.md5(F.col(text_col))})
    named = numbers.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("number").alias("_further"))
    return keyed.join(named, ["_id", "_digest"], "left").withColumn("_number", F.coalesce("_further", "_id")).drop("_id", "_digest", "_further")


def with_ids(found: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """Passages with documents' ids in the place of numbers."""
    if numbers is None:
        return found
    out = found
    for c in ("doc_id", "source_id"):
        named = numbers.select(F.col("number").alias(c), F.col("doc_id").alias("_real"))
        out = out.join(named, c, "left").withColumn(c, F.coalesce("_real", c)).drop("_real")
    return out.select(found.columns)


def _passages(rows: DataFrame, min_words: int, identity: int) -> DataFrame:
    """Passages of ``rows`` (doc_id, text), where an id has one text."""
    hits = written(matched(written(seeds(rows, min_words))))
    chained = written(chain_matches(hits.where("doc_id != source_id"), min_words))
    found = written(align_chains(chained.where("source_id is not null"), rows, min_words, identity))
    return found.union(missed_passages(chained.where("source_id is null"), found, hits, rows, min_words)).distinct()


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    numbers = text_numbers(rows)
    return with_numbers(rows, numbers).select(F.col("_number").alias("doc_id"), "text"), numbers


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: int = IDENTITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, source_id, source_start, source_end, n_same: word ranges that repeat a passage of an earlier text."""
    rows, numbers = _numbered(docs, id_col, text_col)
    return with_ids(_passages(rows, min_words, identity), numbers)


def without_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: int = IDENTITY) -> DataFrame:
    """``docs`` with every passage that an earlier text has cut out of ``text``; the first text that holds it keeps it.

    Texts without a repeated passage stay exactly as they are, null text stays null; what is left of a text may be empty. White
    space at the end of a cut text goes.
    """
    rows, numbers = _numbered(docs, "doc_id", "text")
    found = _passages(rows, min_words, identity).groupBy(F.col("doc_id").alias("_number")).agg(F.collect_set(F.struct("start", "end")).alias("_cuts"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns) if c != "text"]).alias("_row"))
    joined = with_numbers(whole, numbers).join(found, "_number", "left")

    def cut(text: str | None, ranges: list | None) -> str | None:
        if not ranges or text is None:
            return text
        places = [m.span() for m in WORD.finditer(text)]
        out, done = [], 0
        for r in sorted(ranges, key=lambda r: (r["start"], r["end"])):
            a, b = max(done, r["start"]), min(r["end"], len(places))
            if b > a:
                out += [(places[done][0], places[a][0])] if a > done else []
                done = b
        out += [(places[done][0], len(text))] if done < len(places) else []
        return "".join(text[a:b] for a, b in out).rstrip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [cut(t, r) for t, r in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column(1)], names=["_text", "_row"])

    source = joined.select("text", "_row", "_cuts")
    done = source.mapInArrow(run, T.StructType([T.StructField("_text", T.StringType()), source.schema["_row"]]))
    return done.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row._{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
