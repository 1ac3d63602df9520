"""Vectors as short codes: product codebooks whose nearest entries are found by Orchard's search.

A component x counts as the whole number floor(4096 x), so all distances, sums and means are exact and the same on every
machine. A vector is cut into eight equal parts, and each part has a codebook of at most sixteen entries: at first the parts of
the vectors with the smallest ids, then, in six rounds, the means of the parts that are nearest to them.

The search: each entry has a list of all entries of its codebook by their distance from it. A part starts with the first
entry and walks down its list. An entry that is nearer, or as near with a smaller index, becomes the current one and its list is
walked from the start; entries that were met before are marked and passed over. The walk ends at an entry whose distance from
the current one is more than twice the part's own (four times, in squares): what comes later in the list cannot be as near as
the current entry, by the triangle inequality. So the nearest entry is found exactly, ties included.

Spark deals the vectors; a task walks with all its parts at once in numpy and returns one row of sums for each entry. A
round brings the sums, no more than 16 whole numbers for each component of one vector, to the driver; codebooks go out with the
tasks' code. No vector goes to the driver but the first sixteen.

Defined cases: vectors that are null or hold nulls, NaN or infinities take no part and have no row. Vectors of other lengths
than the longest, rounded up to a multiple of eight, count as ending in zeros. Fewer than sixteen vectors make a codebook as
long as their number. Of equal ids the smaller vector comes first; null ids come last. An entry that is nobody's nearest stays
as it is. Other columns are ignored. An empty table gives no rows. A component of 8,192 or more in size is an error, since squares
of distances could leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of at least this size are refused.
LARGEST = 8192
#: Vectors that a task handles at once.
STEP = 4096
#: As many labels are known to be few enough for a broadcast; with more, their sums are joined in salted parts.
FEW_LABELS, SALTS = 50_000, 16


def quantised(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, q): whole numbers of all vectors that take part, as long as the longest, written once."""
    v = F.col(f"`{vec}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("_v")).where(F.col("_v").isNotNull() & finite)
    refuse = F.raise_error(F.lit(f"a component of {LARGEST} or more in size")).cast("bigint")
    whole = F.transform("_v", lambda x: F.when(F.abs(x) < LARGEST, F.floor(x.cast("double") * SCALE)).otherwise(refuse))
    rows = written(rows.select("vec_id", "label", whole.alias("q")), "whole")
    length = rows.agg(F.max(F.size("q")).alias("n")).first()["n"] or 0
    length = max(-(-length // PARTS), 1) * PARTS
    return rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size("q"))))


def first_books(rows: DataFrame) -> np.ndarray:
    """(parts, entries, components) of the vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).collect()
    x = np.array([r["q"] for r in first], np.int64)
    return x.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy() if len(first) else np.zeros((PARTS, 0, 0), np.int64)


class Search:
    """The neighbour lists of codebooks, and the walk through them."""

    def __init__(self, books: np.ndarray):
        self.books, self.k = books, books.shape[1]
        self.between = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(3)
        self.lists = np.argsort(self.between, 2, kind="stable")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and squared distances of the nearest entries of ``x`` (vectors, parts, components); of equals the first."""
        shape = x.shape[:2]
        part = np.tile(np.arange(PARTS), shape[0])
        x = x.reshape(shape[0] * PARTS, -1)
        current, place, met = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
        best = ((x - self.books[part, 0]) ** 2).sum(1)
        walking = np.arange(len(x))
        while len(walking):
            p, c, i = part[walking], current[walking], place[walking]
            entry = self.lists[p, c, np.minimum(i, self.k - 1)]
            on = (i < self.k) & (self.between[p, c, entry] <= 4 * best[walking])
            walking, entry = walking[on], entry[on]
            place[walking] += 1
            new = (met[walking] >> entry) & 1 == 0
            at, entry = walking[new], entry[new]
            met[at] |= 1 << entry
            distance = ((x[at] - self.books[part[at], entry]) ** 2).sum(1)
            better = (distance < best[at]) | ((distance == best[at]) & (entry < current[at]))
            at = at[better]
            best[at], current[at], place[at] = distance[better], entry[better], 0
        return current.reshape(shape), best.reshape(shape)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their column ``q`` as (vectors, parts, components)."""
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            rows = batch.slice(i, STEP)
            q = rows.column(rows.schema.get_field_index("q")).flatten().to_numpy(zero_copy_only=False)
            yield rows, q.reshape(rows.num_rows, PARTS, -1)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every entry replaced by the floored mean of the parts that are nearest to it."""
    k, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, n = Search(books), np.zeros((PARTS * k, width), np.int64), np.zeros(PARTS * k, np.int64)
        for _, x in vectors(batches):
            slot = (search.nearest(x)[0] + np.arange(PARTS) * k).ravel()
            order = np.argsort(slot, kind="stable")
            used, first = np.unique(slot[order], return_index=True)
            sums[used] += np.add.reduceat(x.reshape(len(slot), width)[order], first, axis=0)
            n += np.bincount(slot, minlength=PARTS * k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64()), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["slot", "n", "sums"])

    parts = rows.select("q").mapInArrow(run, "slot long, n long, sums array<long>")
    total = parts.select("slot", "n", F.posexplode("sums").alias("i", "x")).groupBy("slot", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = books.reshape(PARTS * k, width).copy()
    for r in total.collect():
        out[r["slot"], r["i"]] = int(r["x"]) // r["n"]
    return out.reshape(books.shape)


def fit(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components) of all ``rows`` of ``quantised``."""
    books = first_books(rows)
    for _ in range(rounds if books.size else 0):
        books = improved(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): a byte for each part, and the squared distance from the vector that the code stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(books)
        for part, x in vectors(batches):
            codes, distances = search.nearest(x)
            codes = codes.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([codes[i : i + PARTS] for i in range(0, len(codes), PARTS)], pa.binary()), pa.array(distances.sum(1), pa.int64())], names=["vec_id", "label", "code", "error"])

    schema = rows.select("vec_id", "label").schema.add("code", "binary").add("error", "long")
    return rows.select("vec_id", "label", "q").mapInArrow(run, schema)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes (vectors, parts) stand for."""
    return books[np.arange(PARTS), codes].reshape(len(codes), -1) / SCALE


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error``: the error summed over all rows of the same label, null being one."""
    # A copy of the label's column: Spark takes a column that is compared with itself for a mistake.
    sums = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    if sums.count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    dealt = coded.withColumn("_s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    spread = sums.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(spread, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_s") == F.col("_t")), "left").drop("_label", "_s", "_t")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    books = fit(rows)
    coded = written(encode(rows, books), "codes")
    return with_label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds in SQL, with every distance computed."""
    steps = [
        "v AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c AS (SELECT k, unnest(range(len(embedding))) AS i, len(embedding) // {PARTS} AS w, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * {SCALE}) AS BIGINT) AS x FROM v)",
        "q AS MATERIALIZED (SELECT k, i // w AS p, i % w AS j, x FROM c)",
        f"b0 AS MATERIALIZED (SELECT p, k - 1 AS e, j, x AS y FROM q WHERE k <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT k, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT k, p, e, sum((x - y) * (x - y)) AS d FROM q JOIN b{r} USING (p, j) GROUP BY ALL) GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT p, e, j, (s - ((s % n) + n) % n) // n AS y FROM (SELECT p, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM q JOIN a{r} USING (k, p) GROUP BY ALL))")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m USING (p, e, j))")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{ROUNDS})")
    steps.append(f"o AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (k), h"


ORACLE_SQL = _oracle()
