"""A score log that grows by committed chunks: what is in its manifest counts, and a run that was cut short goes on behind it.

A chunk is a folder of Parquet files under ``chunks``. Its entry in ``manifest`` is made after the folder is complete, by one
rename, so readers see whole chunks only, and a run that fails leaves its unfinished chunk unseen. The next run scores the
targets that no committed chunk holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import digest_ranks
from ..storage import checkpointed, delete_folder, list_names, put_file, written


def committed(spark: SparkSession, log: str) -> list[str]:
    """Names of the chunks that count, in no order."""
    return [n.removesuffix(".json") for n in list_names(spark, f"{log}/manifest") if n.endswith(".json")]


def scores_so_far(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """All rows of the committed chunks; none of an empty log."""
    chunks = committed(spark, log)
    return spark.read.schema(schema).parquet(*(f"{log}/chunks/{c}" for c in chunks)) if chunks else spark.createDataFrame([], schema)


def by_digest(rows: DataFrame, key: str = "star_id") -> DataFrame:
    """``rows`` written in the order of their key's digest, in which ``score_and_append`` deals chunks; see ``of_chunk``."""
    rows = checkpointed(rows.withColumn("_digest", F.md5(F.col(key).cast("string"))))  # the cuts between files come from a look at all rows
    return written(rows.repartitionByRange("_digest").sortWithinPartitions("_digest"), "by-digest")


def of_chunk(rows: DataFrame, chunk: DataFrame, key: str = "star_id") -> DataFrame:
    """The rows of a chunk's targets, from a table of ``by_digest``: what lies outside of the chunk's digests is not read, so all
    chunks together read the table about once."""
    digest = F.md5(F.col(key).cast("string"))
    lo, hi = chunk.agg(F.min(digest), F.max(digest)).first()
    return rows.where(F.col("_digest").between(F.lit(lo), F.lit(hi))).join(chunk.select(key), key, "left_semi").drop("_digest")


def score_and_append(targets: DataFrame, log: str, score: Callable[[DataFrame], DataFrame], schema: str, key: str = "star_id", save_every: int = 100_000, resume: bool = True) -> DataFrame:
    """Score the ``targets`` (distinct by ``key``) that the log does not hold, in chunks of ``save_every``, and return the log.

    ``score`` takes the targets of a chunk and returns rows with the columns of ``schema``. Targets go by digest, so chunks are
    alike in size and kind. ``resume`` False starts the log anew. Null keys are not scored.
    """
    spark = targets.sparkSession
    if not resume:
        delete_folder(spark, f"{log}/manifest")
    known = set(committed(spark, log))
    for name in list_names(spark, f"{log}/chunks"):
        if name not in known:
            delete_folder(spark, f"{log}/chunks/{name}")
    todo = targets.where(F.col(key).isNotNull()).dropDuplicates([key]).join(scores_so_far(spark, log, schema).select(key).distinct(), key, "left_anti")
    ranked = digest_ranks(todo.withColumn("_g", F.lit(1)), ["_g"], F.md5(F.col(key).cast("string")), [key])
    dealt = written(ranked.withColumn("_chunk", F.floor((F.col("_r") - 1) / save_every).cast("int")).drop("_g", "_r", "_n"), "targets", ("_chunk",)) if not todo.isEmpty() else None
    run = uuid.uuid4().hex[:12]
    count = (dealt.agg(F.max("_chunk")).first()[0] + 1) if dealt is not None else 0
    for number in range(count):
        name = f"{run}-{number:06}"
        rows = score(dealt.where(F.col("_chunk") == number).drop("_chunk"))
        rows.select([c.split()[0] for c in schema.split(", ")]).write.parquet(f"{log}/chunks/{name}")
        put_file(spark, f"{log}/manifest/{name}.json", json.dumps({"chunk": name, "number": number, "of": count}))
    return scores_so_far(spark, log, schema)
