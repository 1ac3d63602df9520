"""Nearest neighbours by balanced posting lists (operator 2).

Largest inner product becomes smallest distance by one more component that gives every vector the same length. There are
about 2 sqrt(n) lists of n vectors, ``CENTROIDS`` at most, so their number and length grow alike. Centroids are fitted by
balanced clustering on a bounded sample, of at most ``SAMPLE`` vectors: a cluster takes no more than its share of them.
Centroids are brought to the vectors' length, so that they lie among them. Every vector is posted to its nearest centroid, and
boundary vectors also to others up to ``COPIES`` whose distance is within ``REPLICATE`` of the nearest one's, unless a centroid
already chosen is nearer to the other than the vector is. A query walks
an in-memory graph of the centroids to find near ones and keeps the lists whose distance ratio to the nearest is within a
limit, of the nearest ``width`` ones, but at least ``LEAST``. Limit and width come from the sample: each is such that ``AIM``
of the true neighbours inside it, of ``TRIALS`` vectors, lie in lists that are kept; of a sample that has one in s vectors,
k / s neighbours are as near as the k in the whole table. About ``GROUP`` lists that are near each other are scanned in one
task, so that a query's hits in them are merged there. Lists are scanned in tasks by list and part: a list of many vectors is dealt into
parts of bounded size, each scanned by itself, and the best of all parts are merged.

Equal vectors have equal scores, and of these the smaller ids come first, so of each distinct vector only its k + 1 smallest
ids can ever be results (k and the query's own); they share one posting, and queries with the same vector share a search.
Centroids and their graph are bounded by ``CENTROIDS`` and broadcast.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another
length than the most frequent one neither; a null id takes no part; rows that repeat an id and vector count once, and an id
with several vectors is a candidate with each (its best counts once); fewer candidates than k give fewer rows; extra columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: The sample has ``FIRST`` vectors, or 4 for each list if that is more, and no more than ``SAMPLE``.
FIRST, SAMPLE, CENTROIDS = 20_000, 65_536, 16_384
COPIES, REPLICATE = 4, 1.15
LEAST, AIM, TRIALS = 8, 0.96, 256
PART, GROUP = 2048, 16


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    kind = dict(vectors.dtypes)[vec_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k-means in which a cluster takes at most a quarter more than its share; a vector that finds it full takes the next."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    room, near = int(np.ceil(1.25 * len(x) / k)), min(k, 16)
    for _ in range(rounds):
        best, d = np.empty((len(x), near), np.int64), np.empty((len(x), near))
        for i in range(0, len(x), 2048):
            full = ((c**2).sum(1) - 2 * x[i : i + 2048] @ c.T).astype(np.float64)
            part = np.argpartition(full, near - 1, axis=1)[:, :near]
            value = np.take_along_axis(full, part, 1)
            order = np.argsort(value, axis=1, kind="stable")
            best[i : i + 2048], d[i : i + 2048] = np.take_along_axis(part, order, 1), np.take_along_axis(value, order, 1)
        own, count = best[:, 0].copy(), np.zeros(k, np.int64)
        for row in np.argsort(d[:, 0], kind="stable"):
            for choice in best[row]:
                if count[choice] < room:
                    own[row] = choice
                    break
            count[own[row]] += 1
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        filled = count > 0
        c[filled] = sums[filled] / count[filled, None]
    return c


def centroid_graph(c: np.ndarray, degree: int = 24) -> np.ndarray:
    """Each centroid's nearest others, and two random ones that keep the graph in one piece."""
    rng = np.random.default_rng(5)
    n, k = len(c), min(degree, max(0, len(c) - 1))
    out = np.zeros((n, k + 2), np.int64)
    for i in range(0, n, 1024):
        d = (c**2).sum(1) - 2 * c[i : i + 1024] @ c.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        if k:
            out[i : i + len(d), :k] = np.argpartition(d, k - 1, axis=1)[:, :k]
    out[:, k] = np.roll(np.arange(n), 1)
    out[:, k + 1] = rng.permutation(n)
    return out


class Index:
    """Centroids, their graph, and the length that every lifted vector has."""

    def __init__(self, centroids: np.ndarray, length: float):
        centroids = centroids * (length / np.maximum(np.sqrt((centroids**2).sum(1, keepdims=True)), 1e-300))
        self.c, self.length, self.graph = centroids, length, centroid_graph(centroids)
        self.norm = (centroids**2).sum(1)
        near = balanced_centroids(centroids, max(1, len(centroids) // GROUP))
        self.group = ((near**2).sum(1) - 2 * centroids @ near.T).argmin(1)
        self.limit, self.width = 1.0, LEAST

    def calibrate(self, x: np.ndarray, k: int, trials: int = TRIALS) -> None:
        """Set the limit and the width from the true neighbours of some vectors of a sample among all of it."""
        asked = np.arange(0, len(x), max(1, len(x) // trials))
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        lists = dict(zip(np.unique(near).tolist(), self.post(x[np.unique(near)]), strict=True)) if near.size else {}
        ratios, ranks = [1.0], [0]
        for q, found in zip(self.aim(x[asked]), near.tolist(), strict=True):
            d = np.sqrt(np.maximum(self.norm - 2 * self.c @ q + (q**2).sum(), 0))
            rank = np.argsort(np.argsort(d, kind="stable"))
            for i in found:
                best = min(lists[i], key=lambda p: d[p])
                ratios.append(d[best] / max(d.min(), 1e-12))
                ranks.append(rank[best])
        self.limit = float(np.quantile(ratios, AIM))
        self.width = max(LEAST, int(np.quantile(ranks, AIM)) + 1)

    def aim(self, x: np.ndarray) -> np.ndarray:
        """Queries as lifted points: by direction only, for their length changes no order."""
        scale = self.length / np.maximum(np.sqrt((x**2).sum(1)), 1e-300)
        return np.hstack([x * scale[:, None], np.zeros((len(x), 1))])

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.length**2 - (x**2).sum(1), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def post(self, x: np.ndarray) -> list[list[int]]:
        """Lists of each vector: its nearest centroid's, and of near others those in another direction."""
        lifted = self.lift(x)
        out = []
        for i in range(0, len(lifted), 512):
            part = lifted[i : i + 512]
            d = np.maximum((part**2).sum(1)[:, None] + self.norm - 2 * part @ self.c.T, 0)
            k = min(16, len(self.c))
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            for row, places in enumerate(near):
                places = places[np.argsort(d[row, places], kind="stable")]
                chosen = [int(places[0])]
                limit = d[row, places[0]] * REPLICATE**2
                for p in places[1:]:
                    if len(chosen) == COPIES or d[row, p] > limit:
                        break
                    if all(((self.c[p] - self.c[q]) ** 2).sum() >= d[row, p] for q in chosen):
                        chosen.append(int(p))
                out.append(chosen)
        return out

    def walk(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found by a best-first walk of the graph, in beams, and their distances."""
        seen = np.zeros(len(self.c), bool)
        front = np.unique(np.linspace(0, len(self.c) - 1, min(len(self.c), 16)).astype(np.int64))
        seen[front] = True
        ids, d = front, self.norm[front] - 2 * self.c[front] @ q
        open_ = np.ones(len(front), bool)
        while open_.any():
            take = np.flatnonzero(open_)
            take = take[np.argsort(d[take], kind="stable")[:16]]
            open_[take] = False
            new = np.unique(self.graph[ids[take]])
            new = new[~seen[new]]
            seen[new] = True
            ids, d = np.concatenate([ids, new]), np.concatenate([d, self.norm[new] - 2 * self.c[new] @ q])
            open_ = np.concatenate([open_, np.ones(len(new), bool)])
            if len(ids) > width:
                keep = np.argsort(d, kind="stable")[:width]
                ids, d, open_ = ids[keep], d[keep], open_[keep]
        return ids, d

    def route(self, x: np.ndarray) -> list[list[int]]:
        """Lists that each query scans: those within the distance ratio, and a few at least."""
        out = []
        for q in self.aim(x):
            ids, d = self.walk(q, max(LEAST, 2 * self.width))
            order = np.argsort(d, kind="stable")
            distance = np.sqrt(np.maximum(d[order] + (q**2).sum(), 0))
            good = distance <= self.limit * max(distance[0], 1e-12)
            good[self.width :] = False
            good[:LEAST] = True
            out.append(ids[order[good]].tolist())
        return out


def lists_for(n: int, centroids: int = CENTROIDS) -> int:
    return max(1, min(centroids, round(2 * n**0.5), n // 8))


def fit(distinct: DataFrame, k: int = 20, first: int = FIRST, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Index | None:
    """An index from a bounded sample of distinct vectors (the smallest by a hash of the vector)."""
    row = distinct.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x))).alias("longest")).first()
    if not row["n"]:
        return None
    lists = lists_for(row["n"], centroids)
    rows = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(min(sample, max(first, 4 * lists))).toArrow().column("v").combine_chunks()
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    index = Index(np.zeros((1, 2)), float(row["longest"]) * (1 + 1e-12))
    index = Index(balanced_centroids(index.lift(x), lists), index.length)
    index.calibrate(x, max(1, round(k * len(x) / row["n"])))
    return index


def _mapped(frame: DataFrame, index, method: str) -> DataFrame:
    """(key, v) of ``frame``, the lists that ``method`` of the index gives, a row for each, and the lists' groups."""
    box = frame.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1)
                lists = getattr(box.value, method)(x) if part.num_rows else []
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(n) for n in lists]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(flat := [n for ns in lists for n in ns], pa.int32()), pa.array(box.value.group[flat] if flat else [], pa.int32())], names=["key", "v", "list", "near"])

    return frame.select("key", "v").mapInArrow(run, f"key long, v {dict(frame.dtypes)['v']}, list int, near int")


class _Best:
    """The best ``k`` (query, key, score) of each query among those added, given out when there are many queries."""

    def __init__(self, k: int, most: int = 400_000):
        self.k, self.most, self.parts, self.rows = k, most, [], 0

    def add(self, q: np.ndarray, key: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((q, key, score))
        self.rows += len(q)
        if self.rows > self.most:
            self.compact()
            if self.rows > self.most // 2:
                yield from self.give()

    def compact(self) -> None:
        q, key, score = map(np.concatenate, zip(*self.parts, strict=True))
        order = np.lexsort((key, -score, q))
        q, key, score = q[order], key[order], score[order]
        again = np.zeros(len(q), bool)
        again[1:] = (q[1:] == q[:-1]) & (key[1:] == key[:-1])
        q, key, score = q[~again], key[~again], score[~again]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        kept = rank < self.k
        self.parts, self.rows = [(q[kept], key[kept], score[kept])], int(kept.sum())

    def give(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.compact()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.parts[0]], names=["q", "key", "score"])
            self.parts, self.rows = [], 0


def scan(posted: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """(q, key, score): of the lists' parts in a task the best k vectors, in double precision, for each query that comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    v = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    yield from zip(*(c.to_pylist() for c in part.columns[1:5]), v, strict=True)

        best = _Best(k)
        for _, group in itertools.groupby(rows(), key=lambda r: r[:2]):
            keys, vectors, asked = [], [], []
            x = ids = None
            for _, _, is_query, key, v in itertools.chain(group, [(None, None, None, None, None)]):
                if is_query is False:
                    keys.append(key)
                    vectors.append(v)
                    continue
                if is_query:
                    asked.append((key, v))
                if asked and keys and (is_query is None or len(asked) == 512):
                    if x is None:
                        x, ids = np.array(vectors), np.array(keys, np.int64)
                    scores = np.array([v for _, v in asked]) @ x.T
                    n = min(k, len(ids))
                    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                    yield from best.add(np.repeat(np.array([q for q, _ in asked], np.int64), n), ids[top].ravel(), np.take_along_axis(scores, top, 1).ravel())
                    asked = []
        yield from best.give()

    parts = posted.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    left = posted.join(parts, "list").select("near", "list", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_query"), "key", "v")
    right = routed.join(parts, "list").select("near", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_query"), "key", "v")
    placed = left.union(right).repartition(F.col("near"), F.col("part")).sortWithinPartitions("near", "part", "list", "is_query")
    return placed.mapInArrow(run, "q long, key long, score double").groupBy("q", "key").agg(F.max("score").alias("score"))


def neighbours(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``is_query(id column)`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).distinct()
    # Distinct vectors are numbered, and each row gets its vector's number by the vector itself.
    distinct = cut_lineage(rows.groupBy("v").agg(F.count("*").alias("_n")).select(F.monotonically_increasing_id().alias("key"), "v"))
    index = fit(distinct, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    keyed = cut_lineage(rows.join(distinct, "v").select("id", "key"))
    ahead = Window.partitionBy("key").orderBy("id")
    salted = Window.partitionBy("key", "salt").orderBy("id")
    members = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(ahead)).where(F.col("r") <= k + 1).select("id", "key")
    members = cut_lineage(members)
    asked = cut_lineage(keyed.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("key").alias("q")))
    queries = distinct.join(asked.select(F.col("q").alias("key")).distinct(), "key", "left_semi")
    hits = scan(_mapped(distinct, index, "post"), _mapped(queries, index, "route"), k + 1)
    # The best k + 1 distinct vectors of a query hold its k nearest rows but itself, with at most k + 1 ids of each.
    kept = hits.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k + 1).drop("r")
    full = kept.join(members, "key").select("q", "id", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    full = full.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pairs = asked.join(full, "q").where("id != query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
