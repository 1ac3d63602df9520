"""Near-duplicates by MinHash with tensored banding (operator 8).

A text's set is its distinct word shingles. Two small collections of ``GROUPS`` groups of ``ROWS`` minimum hashes each are
computed; the table (i, j) has as key the pair of group i of the first and group j of the second collection. The
GROUPS x GROUPS tables need 2 GROUPS ROWS hashes of a set and not GROUPS^2 2 ROWS. A pair at the threshold 0.8 meets in
some table with probability of about 1 - 2 (1 - 0.8^ROWS)^GROUPS, which is 0.99993.

Equal sets are one class first, by a digest, so exact copies cost nothing later. A class only enters the tables (i, j) whose
i-th and j-th group it shares with another class. Classes that meet in any table, directly or over others, are a cluster.
Links are then confirmed on full sets:

1. a cluster of up to ``BLOCK`` classes is compared in memory, all pairs that meet in a table but those that are connected
   already;
2. of a larger one, the buckets of a few tables are dealt into blocks of that size, and each is compared in the same way;
3. what remains there are pairs that meet in any table but lie in different components, and only where a bound allows a
   link: no intersection is larger than the number of a set's shingles that any other member of its cluster has. A set is
   paired with those of small components, and goes to the parts of a large one to be compared with all that it meets there.
   No pair that meets and could be a link is lost.

So a pair is compared, or its two sets are connected over others, exactly if it meets in a table, whatever the cluster's size.

Defined cases: null and empty texts and texts without words have the empty set and are linked with nothing; rows with null
ids are linked with nothing and kept; rows with one id are one document: they share a component and each of their texts
carries links; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, cut_lineage, mix64, per_text, shingle_hashes, table, word_hashes, words_of
from .components import components

GROUPS, ROWS = 10, 2
#: Tables whose buckets are compared as blocks first in a large cluster, and the most sets that are compared in memory.
FIRST_TABLES, BLOCK = 3, 128
#: About how many sets one set is compared with in a task.
PARTNERS = 256


def sets_of(width: int):
    """A function from a text to the sorted hashes of its distinct shingles."""
    return lambda text: shingle_hashes(word_hashes(words_of(text)), width)


def minima(hashes: np.ndarray, groups: int, rows: int, seed: int) -> list[int]:
    """``groups`` values, each made of ``rows`` minimum hashes of a set."""
    keys = mix64(np.arange(1, 2 * groups * rows + 1, dtype=np.uint64) + np.uint64(seed * 1000003))
    lows = np.full(groups * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 4096):
            part = (hashes[None, i : i + 4096] ^ keys[::2, None]) * (keys[1::2, None] | np.uint64(1))
            lows = np.minimum(lows, part.min(1))
        value, lows = np.arange(1, groups + 1, dtype=np.uint64), mix64(lows).reshape(groups, rows)
        for r in range(rows):
            value = mix64(value * MIX + lows[:, r])
    return value.astype(np.int64).tolist()


def signatures(docs: DataFrame, width: int, groups: int = GROUPS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, digest of the set (null: empty) and the values of both collections."""

    def start():
        shingles = sets_of(width)

        def row(text: str) -> tuple:
            hashes = shingles(text)
            if not len(hashes):
                return 0, None, None, None
            return len(hashes), hashlib.md5(hashes.tobytes()).digest(), minima(hashes, groups, rows, 1), minima(hashes, groups, rows, 2)

        return row

    return per_text(marked(docs, id_col, text_col), "n_shingles long, digest binary, a array<long>, b array<long>", start, keep=("mark",))


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and mark, which tells the texts of rows with one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = small + large - len(np.union1d(a, b)) if small else 0
    return 100 * both >= percent * (small + large - both)


def _rows(batches: Iterator[pa.RecordBatch], step: int = 512):
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, step).columns), strict=True)


def _links(batches_of_pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for part in itertools.batched(batches_of_pairs, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names=["a", "b"])


def links_in_blocks(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """A spanning forest of the links inside each block between sets that meet in a table; ``blocks``: block, id, text, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = sets_of(width)

        def pairs():
            for _, members in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                ids, sets, a, b = zip(*((i, shingles(t), x, y) for _, i, t, x, y in members), strict=True)
                a, b = np.array(a), np.array(b)
                meet = (a[:, None] == a).any(2) & (b[:, None] == b).any(2)
                root = list(range(len(ids)))

                def find(x: int, root=root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for gap in range(1, len(ids)):
                    for x in np.flatnonzero(np.diagonal(meet, gap)).tolist():
                        if find(x) != find(x + gap) and alike(sets[x], sets[x + gap], percent):
                            root[find(x + gap)] = find(x)
                            yield ids[x], ids[x + gap]

        yield from _links(pairs())

    placed = blocks.repartition(F.col("block")).sortWithinPartitions("block", "id")
    return placed.select("block", "id", "text", "a", "b").mapInArrow(run, "a long, b long")


def links_of_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """A link of each x to each component c in which it has one; ``pairs``: x, y, c (of y).

    A text x travels once for each ``PARTNERS`` pairs, and what is known to be joined is not compared again.
    """
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("_parts"))
    dealt = pairs.join(parts, "x").withColumn("part", F.pmod(F.xxhash64("y"), "_parts"))
    other = dealt.join(texts.withColumnRenamed("id", "y"), "y").select("x", "part", "c", "y", "text")
    own = dealt.select("x", "part").distinct().join(texts.withColumnRenamed("id", "x"), "x").select("x", "part", *(F.lit(None).cast("long").alias(c) for c in "cy"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = sets_of(width)

        def found():
            for (x, _), rows in itertools.groupby(_rows(batches), key=lambda r: r[:2]):
                mine, joined = shingles(next(rows)[-1]), None
                for _, _, c, y, text in rows:
                    if c != joined and alike(mine, shingles(text), percent):
                        joined = c
                        yield x, y

        yield from _links(found())

    placed = own.union(other).repartition(F.col("x"), F.col("part")).sortWithinPartitions("x", "part", F.col("c").asc_nulls_first(), "y")
    return placed.mapInArrow(run, "a long, b long")


def classes_of(signed: DataFrame) -> DataFrame:
    """One row for each distinct set: its number (id), size and values, and the smallest document that has it with the mark of its text."""
    rows = signed.where("digest is not null and doc_id is not null").groupBy("digest")
    return rows.agg(F.min("row").alias("id"), F.min(F.struct("doc_id", "mark")).alias("first"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))


def links_of_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes of different texts under one id, each with the first of them."""
    rows = signed.where("digest is not null and doc_id is not null").select("doc_id", "digest")
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("to"), F.max("digest").alias("_last")).where("to != _last").drop("_last")
    pairs = rows.join(several, "doc_id").where("digest != to").select("digest", "to").distinct()
    return pairs.join(classes.select("digest", F.col("id").alias("a")), "digest").join(classes.select(F.col("digest").alias("to"), F.col("id").alias("b")), "to").select("a", "b")


def buckets_of(classes: DataFrame) -> DataFrame:
    """(t, key, id, size, head): the classes that share a key with others in table t, how many they are and the first.

    A group's value that no other class has can't be part of a shared key, so it is left out before tables are formed.
    """
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("vs")) for s in "ab"))
    values = classes.select("id", F.explode(sides).alias("_s")).select("id", "_s.side", F.posexplode("_s.vs").alias("i", "v"))
    shared = values.groupBy("side", "i", "v").agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    kept = values.join(shared, ["side", "i", "v"]).groupBy("id").agg(*(F.collect_list(F.when(F.col("side") == s, F.struct("i", "v"))).alias(s) for s in "ab"))
    pairs = kept.select("id", F.explode("a").alias("x"), "b").select("id", "x", F.explode("b").alias("y"))
    keyed = pairs.select((F.col("x.i") * 1000 + F.col("y.i")).cast("int").alias("t"), F.xxhash64("x.i", "y.i", "x.v", "y.v").alias("key"), "id")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1")
    return keyed.join(sizes, ["t", "key"])


def own_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(id, own): how many shingles of a text no other text of its cluster has, if any; ``texts``: id, cluster, text."""

    def start():
        shingles = sets_of(width)
        return lambda text: [(h,) for h in shingles(text).astype(np.int64).tolist()]

    rows = per_text(texts, "h long", start, "id", "text", ("cluster",), many=True)
    single = rows.groupBy("cluster", "h").agg(F.count("*").alias("_c"), F.min("doc_id").alias("id")).where("_c = 1")
    return single.groupBy("id").agg(F.count("*").alias("own"))


def standing(members: DataFrame, found: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """``members`` that can have a link by the bound, with s, the most shingles that they share with any other of their cluster,
    their component c, its size m and, of components over ``BLOCK``, the part in which they lie.
    """
    counted = members.join(own, "id", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    rows = counted.where(100 * F.col("s") >= percent * F.col("n")).join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    sizes = rows.groupBy("c").agg(F.count("*").alias("m"))
    part = F.when(F.col("m") > BLOCK, F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / F.lit(PARTNERS))))
    return rows.join(sizes, "c").withColumn("part", part)


def apart(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What is left to compare of ``rows`` that meet in a table and lie in different components; x lies in the smaller one.

    Pairs (x, y, c) where the larger component, c, is small; and (x, c, part) where it is large, so that rows follow its parts
    and not its members. Two sets meet in a table (i, j) if they share group i of the first and group j of the second
    collection; they are paired once, at the first group i that they share, if they share any group j.
    """
    placed = rows.select("id", "n", "s", "c", "m", "part", "a", "b", F.posexplode("a").alias("i", "v"))
    ascends = (F.col("mx") < F.col("my")) | ((F.col("mx") == F.col("my")) & (F.col("cx") < F.col("cy")))
    large = placed.where(F.col("m") > BLOCK).select("i", "v", F.col("c").alias("cy"), F.col("m").alias("my"), "part").distinct()
    ids = placed.select("i", "v", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("m").alias("mx"))
    parts = ids.join(large, ["i", "v"]).where(ascends).select("x", F.col("cy").alias("c"), "part").distinct()
    side = lambda k: placed.where(F.col("m") <= BLOCK).select("i", "v", *[F.col(c).alias(f"{c}{k}") for c in ("id", "n", "s", "c", "m", "a", "b")])
    most = F.least("sx", "sy")
    bound = most * 100 >= (F.col("nx") + F.col("ny") - most) * percent
    same = lambda c: F.zip_with(f"{c}x", f"{c}y", lambda p, q: p == q)
    first = F.array_position(same("a"), F.lit(True)) == F.col("i") + 1
    met = side("x").join(side("y"), ["i", "v"]).where(ascends & bound & first & F.exists(same("b"), lambda e: e))
    return met.select(F.col("idx").alias("x"), F.col("idy").alias("y"), F.col("cy").alias("c")), parts


def links_to_parts(parts: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """A link of each x to a member of each part (x, c, part) that it meets in a table and has one with; ``rows`` as of ``standing``."""
    held = rows.join(parts.select("c", "part").distinct(), ["c", "part"], "left_semi").select("c", "part", F.lit(False).alias("asks"), "id", "text", "a", "b")
    asking = parts.join(rows.select(F.col("id").alias("x"), "text", "a", "b"), "x").select("c", "part", F.lit(True).alias("asks"), "x", "text", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = sets_of(width)

        def found():
            for _, group in itertools.groupby(_rows(batches), key=lambda r: r[:2]):
                ids, sets, a, b = [], [], [], []
                for _, _, asks, i, text, x, y in group:
                    if not asks:
                        ids.append(i)
                        sets.append(shingles(text))
                        a.append(x)
                        b.append(y)
                        continue
                    if isinstance(a, list):
                        a, b = np.array(a), np.array(b)
                    mine = shingles(text)
                    meet = (a == np.array(x)).any(1) & (b == np.array(y)).any(1)
                    k = next((k for k in np.flatnonzero(meet).tolist() if alike(mine, sets[k], percent)), None)
                    if k is not None:
                        yield i, ids[k]

        yield from _links(found())

    placed = held.union(asking).repartition(F.col("c"), F.col("part")).sortWithinPartitions("c", "part", "asks")
    return placed.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, groups: int = GROUPS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    signed = cut_lineage(signatures(docs, width, groups, rows, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    classes = classes_of(signed)
    buckets = cut_lineage(buckets_of(classes))
    clusters = components(buckets.select(F.col("id").alias("a"), F.col("head").alias("b"))).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    chosen = classes.join(clusters.join(sizes, "cluster"), "id").select("id", "cluster", "members", "n", "a", "b", "first.doc_id", "first.mark")
    texts = marked(docs, id_col, text_col).where("text is not null").join(chosen.select("id", "doc_id", "mark"), ["doc_id", "mark"]).groupBy("id").agg(F.first("text").alias("text"))
    texts = cut_lineage(texts.join(chosen.drop("doc_id", "mark"), "id"))
    small, large = texts.where(F.col("members") <= BLOCK), texts.where(F.col("members") > BLOCK)
    links = links_in_blocks(small.withColumn("block", F.col("cluster")), width, percent).union(links_of_ids(signed, classes))
    if not large.isEmpty():
        inside = buckets.join(large.select("id"), "id", "left_semi")
        first = inside.where((F.floor(F.col("t") / 1000) == F.col("t") % 1000) & (F.col("t") % 1000 < FIRST_TABLES))
        parts = F.ceil(F.col("size") / F.lit(BLOCK))
        dealt = first.select("id", F.xxhash64("t", "key", F.pmod(F.xxhash64("id", "t"), parts)).alias("block"))
        near = cut_lineage(links_in_blocks(dealt.join(large, "id"), width, percent))
        rows = cut_lineage(standing(large.select("id", "n", "a", "b", "text"), components(near), own_shingles(large, width), percent))
        pairs, parts = map(cut_lineage, apart(rows, percent))
        links = links.union(near).union(links_of_pairs(pairs, rows.select("id", "text"), width, percent)).union(links_to_parts(parts, rows, width, percent))
    found = components(cut_lineage(links)).withColumnRenamed("node", "id")
    named = classes.select("digest", "id", F.col("first.doc_id").alias("_first")).join(found, "id", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("_first").alias("_least"))
    named = named.join(least, "component", "left").select("digest", F.coalesce("_least", "_first").alias("_component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns as they were."""
    keep = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
