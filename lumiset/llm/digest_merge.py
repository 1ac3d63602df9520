"""Exact duplicates by a tree of merges over sorted digest runs.

Every row becomes the digest of its normalised text. Rows are laid into runs, stretches of a partition's rows, which are sorted
by digest and hold one row for each digest. Runs sit in ``cells``, whose number is a power of two, and meet in binomial rounds:
in each round a cell exchanges, with the cells whose numbers differ from its own in the round's bits only, the rows of their
shares of the digests. What arrives from up to ``2 ** bits`` cells is merged, again one sorted row for each digest, with the id
that stays and the number of rows. After the last round each cell holds one share of the digests, merged over all rows. Then
the same rounds run backwards and bring each run the id that stays. So a text's copies never meet in one task, however many
there are: a cell gives and gets one row for each digest and round.

Texts count as equal if SHA-256, a second, unrelated hash and the length of the normalised text agree, at every level.

Defined cases: null text is the empty text. A null id never stays if a copy has an id; copies that all have none stay all, with
a null ``keep_id``. Rows with the same text and id stay or go together. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parallelism, table, written

#: Rows of a partition that make a run.
RUN_BITS = 12
#: Bits of a cell's number that one round exchanges: eight runs are merged at once.
ROUND_BITS = 3
TEXT = ("digest", "check", "size")


def normal(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    x = F.coalesce(text.cast("string"), F.lit(""))
    # lower() changes other letters too, but a text of as many bytes as letters has none.
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, string.ascii_uppercase, string.ascii_lowercase))


def digests(docs: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, check, size, cell): what stands for each row's text, and the cell of the row's run."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), normal(F.col(f"`{text_col}`")).alias("_text"), F.shiftright(F.monotonically_increasing_id(), RUN_BITS).alias("_run"))
    return rows.select(
        "doc_id", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), F.xxhash64("_text").alias("check"), F.octet_length("_text").cast("long").alias("size"),
        F.pmod(F.xxhash64("_run"), F.lit(1 << bits)).cast("int").alias("cell"),
    )


def place(bits: int) -> Column:
    """The cell that holds a digest after the last round."""
    return F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def next_cell(low: int, high: int, bits: int) -> Column:
    """The cell after the round that exchanges the bits from ``low`` to ``high``: these come from the digest, others stay."""
    mask = ((1 << high) - 1) ^ ((1 << low) - 1)
    return F.col("cell").bitwiseAND(F.lit(((1 << bits) - 1) ^ mask)).bitwiseOR(place(bits).bitwiseAND(F.lit(mask)))


def merged(rows: DataFrame) -> DataFrame:
    """One row for each cell and text, sorted by digest inside the cell, from the rows and runs that lie there."""
    met = rows.groupBy("cell", *TEXT).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return met.sortWithinPartitions("cell", "digest")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, round_bits: int = ROUND_BITS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept), a row for each row of ``docs``. ``bits``: there are ``2 ** bits`` cells."""
    bits = bits if bits is not None else max(1, (parallelism(docs.sparkSession) - 1).bit_length())
    rows = written(digests(docs, bits, id_col, text_col), "digests")
    levels = [written(merged(rows.select("cell", *TEXT, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))), "runs")]
    rounds = [(low, min(low + round_bits, bits)) for low in range(0, bits, round_bits)]
    for low, high in rounds:
        levels.append(written(merged(levels[-1].withColumn("cell", next_cell(low, high, bits))), "runs"))
    known = levels[-1]
    for (low, high), level in zip(reversed(rounds), reversed(levels[:-1]), strict=True):
        asking = level.select(F.col("cell").alias("_from"), *TEXT, next_cell(low, high, bits).alias("cell"))
        known = asking.join(known, ["cell", *TEXT]).select(F.col("_from").alias("cell"), *TEXT, "keep_id", "n")
    return rows.join(known, ["cell", *TEXT]).select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat a text and its id all stay."""
    stay = groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_stays"), F.col("digest").alias("_digest")).distinct()
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_stays")) & (F.unhex(F.sha2(normal(F.col(f"`{text_col}`")).cast("binary"), 256)) == F.col("_digest"))
    return docs.join(stay, on, "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)"""
