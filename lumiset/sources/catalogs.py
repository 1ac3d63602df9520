"""Reading catalogs, ephemerides, light curves and score logs, and writing results."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CATALOG, ensure_columns


def read_catalog(spark: SparkSession, path: str, schema: T.StructType = CATALOG) -> DataFrame:
    """A CSV catalog with any subset of the known columns, in any order; lines that start with "#" are notes.

    Ids may have any of the names in ``schemas.ALIASES``; several of them in one file are coalesced by row. The header is read
    by itself, because Spark takes names that differ in case only for one; all files of a folder have the same.
    """
    lines = spark.read.text(path).where("value not like '#%' and trim(value) != ''")
    first = lines.first()
    names = next(csv.reader([first["value"].lstrip("\ufeff")])) if first else []
    if not names:
        return spark.createDataFrame([], schema)
    places = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.schema(places).option("header", True).option("comment", "#").csv(path)
    return ensure_columns(raw.toDF(*(n.strip() for n in names)), schema)


def ephemeris_table(df: DataFrame, mission: str = "k2") -> DataFrame:
    """Known ephemeris columns in order; a table without a mission gets ``mission``."""
    known = ["star_id", "pl_orbper", "pl_tranmid", "pl_trandurh", "mission"]
    df = df if "mission" in df.columns else df.withColumn("mission", F.lit(mission))
    return df.select(*[c for c in known if c in df.columns])


def confirmed_ephemerides(composite: DataFrame, mission_table: DataFrame) -> DataFrame:
    """Default, confirmed rows of a mission's planets joined with their composite parameters, complete and distinct."""
    chosen = mission_table.where((F.col("default_flag") == 1) & (F.upper("disposition") == "CONFIRMED")).select("pl_name", "star_id")
    return composite.join(chosen, "pl_name").select("star_id", "pl_orbper", "pl_tranmid", "pl_trandurh").dropna().distinct()


def keep_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key, at its first position."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def campaign_targets(df: DataFrame, position: str, prefix: str = "") -> DataFrame:
    """Ids from the first column named like "epic" (else the first one): digits only, no blanks, the first of equals."""
    names = [c for c in df.columns if c != position]
    column = next((c for c in names if "epic" in c.lower()), names[0])
    ids = df.select(F.regexp_replace(F.col(column).cast("string"), r"\D", "").alias("target"), position).where("target != ''")
    return keep_first(ids.withColumn("target", F.concat(F.lit(prefix), "target")), "target", position)


def load_ids(df: DataFrame, column: str, position: str, limit: int | None = None) -> DataFrame:
    """Upper case, without a trailing ".0" and the EPIC prefix, digits only, no blanks, the first of equals."""
    x = F.upper(F.trim(F.col(column).cast("string")))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\.0$", ""), "EPIC", ""), r"\D", "")
    ids = keep_first(df.select(x.alias("target"), position).where("target != ''"), "target", position)
    return ids.orderBy(position).limit(limit) if limit is not None else ids


def usable_curves(targets: DataFrame, curves: DataFrame, key: str = "star_id") -> DataFrame:
    """Curves of the wanted targets that are not marked empty; targets without one are absent."""
    return curves.where(~F.col("empty")).join(targets.select(key).distinct(), key, "left_semi")


def pick_product(products: DataFrame, priority: list[str], banned: list[str], most: int = 6, tie: list[str] | None = None) -> DataFrame:
    """Each star's first usable product among the first ``most`` by provenance priority; unlisted ones come after, banned never."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.upper("provenance"))
    rows = products.where(~F.upper("provenance").isin(*banned)).withColumn("_rank", F.when(rank == 0, len(priority) + 1).otherwise(rank))
    w = Window.partitionBy("star_id").orderBy("_rank", *(tie or ["product_id"]))
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).where("n_time > 0 and n_time = n_flux")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("star_id").orderBy("_n"))).where("_k = 1").drop("_rank", "_n", "_k")


def pick_mission(products: DataFrame, missions: list[str], most: int = 4) -> DataFrame:
    """Products of each star's first mission that has any, preferred one first, at most ``most`` of them in order."""
    rank = F.when(F.col("mission") == F.col("preferred"), 0).otherwise(F.array_position(F.array(*map(F.lit, missions)), F.col("mission")))
    rows = products.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy("star_id"))).where("_rank = _best")
    w = Window.partitionBy("star_id").orderBy("product_id")
    return rows.withColumn("file_no", F.row_number().over(w)).where(F.col("file_no") <= most).drop("_rank", "_best")


def stitch(points: DataFrame) -> DataFrame:
    """Points of several files of a star in one sequence: by file and time, with a new index from 0."""
    w = Window.partitionBy("star_id").orderBy("file_no", "time")
    return points.withColumn("idx", F.row_number().over(w) - 1)


def append_scores(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets that no earlier run has scored."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def ingest_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("n"), F.sum("files").alias("files"), F.round(F.sum("seconds"), 4).alias("seconds"))


def loose_scores(lines: DataFrame, text: str = "value") -> DataFrame:
    """Mean score for each id from lines whose first field is the id and whose last is the score, by any delimiter."""
    parts = F.split(F.trim(F.col(text)), r"[,;\t|]+|\s+")
    rows = lines.select(F.element_at(parts, 1).alias("target"), F.element_at(parts, -1).try_cast("double").alias("score"))
    return rows.where("score is not null and not isnan(score)").groupBy("target").agg(F.avg("score").alias("score"))


def skip_ledger(catalog: DataFrame, curves: DataFrame, window: int) -> DataFrame:
    """How many catalog rows are skipped for which reason: no id, no curve, too short; the rest is ok."""
    rows = catalog.join(curves.select("star_id", "n_points"), "star_id", "left")
    reason = F.when(F.col("star_id").isNull(), "no_id").when(F.col("n_points").isNull(), "no_curve").when(F.col("n_points") < window, "too_short").otherwise("ok")
    return rows.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """CSV or Parquet by the path's suffix; another suffix is an error."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".parquet"):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    else:
        raise ValueError("a result is written as .csv or .parquet")


def status_ok(column: str = "status") -> Column:
    return F.lower(F.col(column)) == "ok"
