"""Count-based windows over light curves, and their labels from periodic transits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import convert_t0, guess_time_base
from .ranks import exact_quantiles

WINDOW, STRIDE = 1024, 256


def star_key(df: DataFrame) -> list[str]:
    """A star's curves of two missions are two curves: star_id, and mission where there is one."""
    return [c for c in ("star_id", "mission") if c in df.columns]


def window_key(df: DataFrame) -> list[str]:
    return [*star_key(df), "start"]


def shared_key(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in star_key(a) if c in b.columns]


def count_windows(n: Column, window: int, stride: int) -> Column:
    return F.when(n >= window, F.floor((n - window) / stride) + 1).otherwise(F.lit(0)).cast("bigint")


def make_segments(curves: DataFrame, window: int, stride: int) -> DataFrame:
    """(star_id, mission, start, end) from curve lengths n_points: starts 0, stride, .. while the window fits."""
    fits = curves.where(F.col("n_points") >= window)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_points").cast("bigint") - window, F.lit(stride).cast("bigint"))).alias("start")
    return fits.select("star_id", "mission", starts).withColumn("end", F.col("start") + window)


def tumbling_segments(curves: DataFrame, window: int, drop_exact_tail: bool = True) -> DataFrame:
    """Windows side by side; ``drop_exact_tail`` leaves out a last one that ends exactly with the curve."""
    rows = make_segments(curves, window, window)
    if drop_exact_tail:
        rows = rows.join(curves.select("star_id", "mission", "n_points"), ["star_id", "mission"]).where("end < n_points").drop("n_points")
    return rows.select("star_id", "mission", "start", "end")


def mission_segments(catalog: DataFrame, curves: DataFrame, mission: str, window: int, stride: int) -> DataFrame:
    """Segments of the curves of a mission's catalog stars."""
    stars = catalog.select("star_id", F.lower("mission").alias("mission")).where(F.col("mission") == mission).dropna().distinct()
    return make_segments(curves.join(stars, ["star_id", "mission"], "left_semi"), window, stride)


def window_points(points: DataFrame, segments: DataFrame, window: int, stride: int) -> DataFrame:
    """Points of each segment. A point is given to the few regular starts that can hold it, so the join is on equal keys only."""
    lo = F.greatest(F.ceil((F.col("idx") - window + 1) / stride), F.lit(0)) * stride
    hi = F.floor(F.col("idx") / stride) * stride
    dealt = points.withColumn("start", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"), F.lit(stride).cast("bigint"))))
    return dealt.join(segments, [*shared_key(points, segments), "start"]).where("idx < end")


def slice_padded(points: DataFrame, segments: DataFrame, value: str = "flux") -> DataFrame:
    """Every place of each segment, 0 where the curve has no point."""
    grid = segments.withColumn("idx", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    on = [*shared_key(grid, points), "idx"]
    return grid.join(points.select(*on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def slice_skipping(segments: DataFrame, curves: DataFrame, window: int | None = None) -> DataFrame:
    """Segments that lie inside their curve, and have ``window`` points if given."""
    on = shared_key(segments, curves)
    rows = segments.join(curves.select(*on, "n_points"), on).where("start >= 0 and end <= n_points and end > start")
    return (rows.where(F.col("end") - F.col("start") == window) if window else rows).drop("n_points")


def slice_strict(segments: DataFrame, curves: DataFrame) -> DataFrame:
    """All segments; the job fails at the first one that does not lie inside its curve."""
    on = shared_key(segments, curves)
    rows = segments.join(curves.select(*on, "n_points"), on, "left")
    inside = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("n_points")), F.lit(False))
    told = F.concat(F.lit("segment "), F.col("start").cast("string"), F.lit(" to "), F.col("end").cast("string"), F.lit(" is not inside the curve of "), F.coalesce("star_id", F.lit("null")))
    return rows.withColumn("start", F.when(inside, F.col("start")).otherwise(F.raise_error(told).cast("bigint"))).drop("n_points")


def segment_times(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*window_key(windows)).agg(F.percentile("time", F.lit(0.5)).alias("seg_mid_time"), F.min_by("time", "idx").alias("t_first"), F.max_by("time", "idx").alias("t_last"))


def filter_segments(windows: DataFrame, value: str = "flux", most_zero: float = 0.5, least_abs: float = 0.05) -> DataFrame:
    """Segments with enough non-zero points and enough signal.

    Values are added in their order on the curve: a sum of doubles depends on the order in its last bits, and a mean that lies on
    the limit would else pass or not by how rows are dealt to tasks.
    """
    sizes = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("idx", F.abs(value).cast("double").alias("_a")))))
    stats = windows.groupBy(*window_key(windows)).agg(F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("zero_share"), sizes.alias("_v"))
    mean = F.when(F.size("_v") > 0, F.aggregate("_v", F.lit(0.0), lambda total, x: total + x["_a"]) / F.size("_v"))
    return stats.withColumn("mean_abs", mean).drop("_v").where((F.col("zero_share") <= most_zero) & (F.col("mean_abs") >= least_abs))


def window_plan(curves: DataFrame, window: int, stride: int) -> DataFrame:
    """Windows of each mission and of all, before anything is built."""
    rows = curves.withColumn("_n", count_windows(F.col("n_points"), window, stride))
    return rows.rollup("mission").agg(F.count("*").alias("n_stars"), F.sum("_n").alias("n_windows"), F.sum(F.when(F.col("_n") == 0, 1).otherwise(0)).alias("n_short"))


# ---- labels ----------------------------------------------------------------------------------------------------------------


def in_transit(t: Column, t0: Column, period: Column, duration: Column, longest_share: float = 0.2) -> Column:
    """Whether a time lies in a transit; false for bad parameters."""
    good = (period > 0) & (duration > 0) & (duration / period < longest_share)
    return F.coalesce(good & (F.abs(F.pmod(t - t0 + period / 2, period) - period / 2) < duration / 2), F.lit(False))


def in_transit_any(points: DataFrame, ephemeris: DataFrame) -> DataFrame:
    """``hit``: 1 where a point lies in a transit of any planet of its star and mission, 0 elsewhere and without planets."""
    rows = points.join(ephemeris, shared_key(points, ephemeris), "left")
    hit = in_transit(F.col("time"), F.col("t0_mission"), F.col("period_days"), F.col("duration_days")).cast("int")
    return rows.groupBy(*star_key(points), "idx").agg(F.max(hit).alias("hit"))


def on_curve_clock(ephemeris: DataFrame, points: DataFrame) -> DataFrame:
    """``ephemeris`` with t0_mission on the clock of its curve, which is guessed from the curve's median time."""
    on = shared_key(points, ephemeris)
    rows = ephemeris.join(guess_time_base(points).select(*on, "time_base"), on, "left")
    return rows.withColumn("t0_mission", convert_t0(F.col("t0_mission"), F.col("mission"), F.coalesce("time_base", F.lit("REDUCED")))).select(*ephemeris.columns)


def label_by_count(segments: DataFrame, hits: DataFrame, least: int) -> DataFrame:
    """1 where a segment holds at least ``least`` points in transit: a difference of two running sums, by equal keys."""
    on = shared_key(segments, hits)
    w = Window.partitionBy(*on).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    run = hits.select(*on, "idx", F.sum("hit").over(w).alias("_run"))
    upto = run.select(*on, (F.col("idx") + 1).alias("end"), F.col("_run").alias("_b"))
    before = run.select(*on, (F.col("idx") + 1).alias("start"), F.col("_run").alias("_a"))
    rows = segments.join(upto, [*on, "end"], "left").join(before, [*on, "start"], "left")
    n = F.when(F.col("_b").isNull() | (F.col("start") < 0), 0).otherwise(F.col("_b") - F.coalesce("_a", F.lit(0)))
    return rows.withColumn("n_hits", n.cast("bigint")).withColumn("label", (F.col("n_hits") >= least).cast("int")).drop("_a", "_b")


def attach_labels(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on the full segment key; repeated keys count once, by their largest label; unlabelled is 0."""
    key = ["star_id", "mission", "start", "end"]
    one = labels.groupBy(*key).agg(F.max("label").alias("label"))
    return segments.join(one, key, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def overlaps_transit(a: Column, b: Column, t0: Column, period: Column, duration: Column, reach: float = 1.5) -> Column:
    """Whether some transit centre, give or take ``reach`` durations, touches [a, b]: closed form over whole epochs."""
    first = F.ceil((a - reach * duration - t0) / period)
    return F.coalesce((period > 0) & (first <= F.floor((b + reach * duration - t0) / period)), F.lit(False))


def label_by_overlap(times: DataFrame, ephemeris: DataFrame) -> DataFrame:
    rows = times.join(ephemeris, shared_key(times, ephemeris), "left")
    hit = overlaps_transit(F.col("t_first"), F.col("t_last"), F.col("t0_mission"), F.col("period_days"), F.col("duration_days"))
    return rows.groupBy(*window_key(times)).agg(F.max(hit.cast("int")).alias("label"))


def label_centered(times: DataFrame, ephemeris: DataFrame, keep_frac: float = 0.15, min_cov: float = 0.7) -> DataFrame:
    """1 where the transit nearest to a window's middle is close to it and mostly inside the window."""
    c = (F.col("t_first") + F.col("t_last")) / 2
    t = F.col("t0_mission") + F.rint((c - F.col("t0_mission")) / F.col("period_days")) * F.col("period_days")
    inside = F.least(F.col("t_last"), t + F.col("duration_days") / 2) - F.greatest(F.col("t_first"), t - F.col("duration_days") / 2)
    hit = (F.col("period_days") > 0) & (F.abs(t - c) <= keep_frac * (F.col("t_last") - F.col("t_first")) / 2) & (inside >= min_cov * F.col("duration_days"))
    rows = times.join(ephemeris, shared_key(times, ephemeris), "left")
    return rows.groupBy(*window_key(times)).agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("label"))


def star_labels(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("star_id").agg(F.max("label").alias("label_star"))


def confidence_weight(segments: DataFrame, ephemeris: DataFrame, known: float = 1.0, unknown: float = 0.3) -> DataFrame:
    on = shared_key(segments, ephemeris)
    stars = ephemeris.select(*on).distinct().withColumn("_k", F.lit(True))
    return segments.join(stars, on, "left").withColumn("weight", F.when(F.col("_k"), known).otherwise(unknown)).drop("_k")


def label_diagnostic(labelled: DataFrame, value: str = "n_hits") -> DataFrame:
    """Count, mean, spread and quartiles of in-transit points by label."""
    stats = labelled.groupBy("label").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return stats.join(exact_quantiles(labelled, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "label"), "label", "left")


def count_diagnostic(segments: DataFrame, points: DataFrame, ephemeris: DataFrame, least: int) -> DataFrame:
    """``label_diagnostic`` of ``segments`` labelled by points in transit, with the ephemeris on each curve's own clock."""
    return label_diagnostic(label_by_count(segments, in_transit_any(points, on_curve_clock(ephemeris, points)), least))
