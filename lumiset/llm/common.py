"""Small helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..storage import checkpointed as cut_lineage  # noqa: F401
from ..storage import written  # noqa: F401

#: A word of the near-duplicate contracts: a run without space, tab, LF, VT, FF or CR.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Rows handled at once inside a task.
STEP = 256
#: Rows that go to Python together, in place of Spark's 10,000: long texts make such batches large, in Spark and in Python.
BATCH = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_mod(column, n: int):
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH rows for the session's Arrow functions, unless it has set another number than Spark's own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def per_text(docs: DataFrame, fields: str, start: Callable, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), many: bool = False, binary: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the columns of ``keep`` as they are, then ``fields`` from the text.

    ``start()`` runs once in each task and returns a function from a text to a tuple (``many``: to any number of tuples, a
    row for each). Null text is passed as the empty text. Rows go through in slices, so memory follows a slice. ``binary``: the
    column holds bytes.
    """
    small_batches(docs.sparkSession)
    names = [f.split(" ", 1)[0].strip() for f in fields.split(", ")]
    types = [ARROW[f.split(" ", 1)[1].strip()] for f in fields.split(", ")]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(k) for k in keep], F.coalesce(F.col(text_col).cast("binary" if binary else "string"), F.lit(b"" if binary else "")).alias("text"))
    head = ["doc_id", *keep]
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(n, from_arrow_type(t)) for n, t in zip(names, types, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                found = [function(t) for t in part.column(len(head)).to_pylist()]
                passed = [part.column(k) for k in range(len(head))]
                if many:
                    at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                    passed, found = [c.take(at) for c in passed], [x for xs in found for x in xs]
                columns = list(zip(*found, strict=True)) if found else [()] * len(types)
                yield pa.RecordBatch.from_arrays([*passed, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*head, *names])

    return source.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memo(dict):
    """A dict that fills itself from ``make`` and starts again when it is full; keys over ``longest`` are not kept."""

    def __init__(self, make, limit: int = 300_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case; they are parted by space, tab, LF, VT, FF and CR, as ``WORD`` does."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of each word, the same on every machine and Python run."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; fewer words: the whole run as one; none: empty."""
    n = len(hashes)
    if not n:
        return hashes
    with np.errstate(over="ignore"):
        k = min(width, n)
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = out * MIX + hashes[i : n - k + 1 + i]
    return np.unique(mix64(out))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
