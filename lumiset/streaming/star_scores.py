"""Scoring of window files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import STAR_SKETCH, merge_sketches, quantile_sketch, sketch_quantile
from ..operators.scores import as_score_rows, best_window

#: What a batch keeps of a curve: all of it adds up, so a curve may arrive in any number of batches and files.
STATE = "star_id string, mission string, n_segments long, best struct<p: double, back: long, t_first: double, t_last: double>, total double, squares double, sketch binary"


def _state(windows: DataFrame) -> DataFrame:
    """Sums, best window and sketch of each curve in ``windows`` (star_id, start, p, and mission, t_first, t_last if known)."""
    absent = {n: F.lit(None).cast(t) for n, t in (("mission", "string"), ("t_first", "double"), ("t_last", "double")) if n not in windows.columns}
    rows = windows.withColumns({"p": F.col("p").cast("double"), "start": F.col("start").cast("long"), **absent})
    return rows.groupBy("star_id", "mission").agg(F.count("*").alias("n_segments"), F.max(best_window()).alias("best"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares"), quantile_sketch(F.col("p"), STAR_SKETCH).alias("sketch"))


def _merged(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.schema(STATE).parquet(sink)
    return rows.groupBy("star_id", "mission").agg(F.sum("n_segments").alias("n_segments"), F.max("best").alias("best"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), merge_sketches("sketch", STAR_SKETCH).alias("sketch"))


def stream_star_scores(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, files_per_batch: int | None = None):
    """Start a query that adds up the arriving windows of each curve; each run takes the files that are there and stops.

    A micro-batch leaves one row for each curve in it, in a folder named by the batch, which a repeated batch overwrites. So a
    star's windows may arrive in any number of batches, and every window counts once; the rows are merged when they are read.
    """

    def batch(df: DataFrame, number: int) -> None:
        _state(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, sink: str, path: str) -> None:
    """The state of all batches as one: the sink of a log that goes on, without its many small files."""
    _merged(spark, sink).write.parquet(f"{path}/batch=-1")


def star_scores_so_far(spark: SparkSession, sink: str) -> DataFrame:
    """star_id, n_segments, best and mean over all batches."""
    rows = _merged(spark, sink).groupBy("star_id").agg(F.sum("n_segments").alias("n_segments"), F.max("best.p").alias("best"), (F.sum("total") / F.sum("n_segments")).alias("mean"))
    return rows


def score_rows_so_far(spark: SparkSession, sink: str, curves: DataFrame, window: int, stride: int, errors: DataFrame | None = None) -> DataFrame:
    """The sixteen fields of scores.score_rows for all ``curves`` (star_id, mission, n_points), over all batches.

    Median and 95 % quantile come from the merged sketches: the value at that rank, exact up to ``STAR_SKETCH`` windows of a
    curve and off by 0.002 of the ranks at most beyond; they do not lie between two values as score_rows' do.
    """
    m = _merged(spark, sink)
    mean = F.col("total") / F.col("n_segments")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n_segments") - mean * mean, F.lit(0.0)))
    q = lambda p: sketch_quantile(F.col("sketch"), p)
    stats = m.select("star_id", "mission", "n_segments", F.col("best.p").alias("best_seg_score"), mean.alias("mean_seg_score"), q(0.5).alias("median_seg_score"), spread.alias("std_seg_score"), q(0.95).alias("p95_seg_score"), "best")
    return as_score_rows(curves, stats, window, stride, errors)
