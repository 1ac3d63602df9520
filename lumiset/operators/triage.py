"""Period search, triage flags and tables, and vetting extracts of scored windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed
from .ranks import exact_quantiles
from .scores import best_as_text, ranked
from .signals import mad_clip
from .windows import shared_key, star_key

SHORTEST, LONGEST, BINS = 0.3, 50.0, 200
#: How far from its epoch a periodic window may be, in periods; how near to phase 0 or 0.5; and the share of the
#: threshold from which windows count for secondaries.
OFF_EPOCH, NEAR_PHASE, LOWER = 0.35, 0.08, 0.85


def hits_of(df: DataFrame, threshold: float) -> DataFrame:
    return df.where((F.col("p") >= threshold) & F.col("seg_mid_time").isNotNull())


def threshold_from_percentile(df: DataFrame, q: float = 0.99) -> DataFrame:
    return exact_quantiles(df, "p", {"threshold": q})


def estimate_period(df: DataFrame, threshold: float) -> DataFrame:
    """A star's most frequent time difference between high windows: centre of the first fullest of 200 equal bins.

    Needs three high windows, five differences between 0.3 and 50 days and three of them in the bin; otherwise no row. A time
    meets only those of its own and the next stretch of 50 days, so pairs follow a star's windows in 100 days, not its curve.
    """
    h = hits_of(df, threshold).select("star_id", F.col("seg_mid_time").alias("t"))
    many = h.groupBy("star_id").agg(F.count("*").alias("_n")).where("_n >= 3").select("star_id")
    h = h.join(many, "star_id", "left_semi")
    h = h.withColumn("_s", F.floor(F.col("t") / LONGEST))
    earlier = h.select("star_id", F.col("t").alias("a"), F.explode(F.array("_s", F.col("_s") + 1)).alias("_s"))
    pairs = earlier.join(h.withColumnRenamed("t", "b"), ["star_id", "_s"]).select("star_id", (F.col("b") - F.col("a")).alias("d")).where((F.col("d") >= SHORTEST) & (F.col("d") <= LONGEST))
    span = pairs.groupBy("star_id").agg(F.count("*").alias("_m"), F.min("d").alias("_lo"), F.max("d").alias("_hi")).where("_m >= 5")
    width = (F.col("_hi") - F.col("_lo")) / BINS
    b = F.when(width > 0, F.least(F.floor((F.col("d") - F.col("_lo")) / width), F.lit(BINS - 1))).otherwise(F.lit(0))
    counted = pairs.join(span, "star_id").groupBy("star_id", "_lo", "_hi", b.alias("_b")).agg(F.count("*").alias("_c"))
    best = counted.groupBy("star_id").agg(F.max_by(F.struct("_lo", "_hi", "_b", "_c"), F.struct(F.col("_c"), -F.col("_b"))).alias("x")).where("x._c >= 3")
    return best.select("star_id", (F.col("x._lo") + (F.col("x._b") + 0.5) * (F.col("x._hi") - F.col("x._lo")) / BINS).alias("period_days"))


def epochs(df: DataFrame, periods: DataFrame) -> DataFrame:
    """``epoch``: whole periods since a star's first time, -1 without a period."""
    first = df.groupBy("star_id").agg(F.min("seg_mid_time").alias("_t0"))
    rows = df.join(first, "star_id").join(periods, "star_id", "left")
    return rows.withColumn("epoch", F.when(F.col("period_days") > 0, F.rint((F.col("seg_mid_time") - F.col("_t0")) / F.col("period_days"))).otherwise(-1.0).cast("bigint"))


def phase(t: Column, t0: Column, period: Column) -> Column:
    return F.pmod((t - t0) / period, F.lit(1.0))


def phase_fold(points: DataFrame, ephemeris: DataFrame, bins: int | None = None) -> DataFrame:
    """Points with their phase, or the mean flux of each phase bin of a curve; each mission's curve goes by its own ephemeris."""
    on = shared_key(points, ephemeris)
    rows = points.join(ephemeris.select(*on, "period_days", "t0_mission"), on).withColumn("phase", phase(F.col("time"), F.col("t0_mission"), F.col("period_days")))
    if bins is None:
        return rows
    return rows.groupBy(*star_key(points), F.least(F.floor(F.col("phase") * bins), F.lit(bins - 1)).alias("bin")).agg(F.avg("flux").alias("flux"), F.count("*").alias("n"))


def _flags(df: DataFrame, threshold: float) -> DataFrame:
    """Flags of the stars that have a high window, or one near it, from one pass over these windows beside the period search."""
    p, t = F.col("p"), F.col("seg_mid_time")
    high, low = p >= threshold, p >= LOWER * threshold
    rows = df.where((high | low) & t.isNotNull()).withColumns({"_h": high, "_l": low})
    first = rows.groupBy("star_id").agg(F.min(F.when(F.col("_h"), t)).alias("_t0"), F.min(F.when(F.col("_l"), t)).alias("_t1"))
    rows = rows.join(first.join(estimate_period(df, threshold), "star_id", "left"), "star_id")
    periodic, at = F.col("period_days") > 0, (t - F.col("_t0")) / F.col("period_days")
    rows = rows.withColumn("_e", F.when(F.col("_h"), F.when(periodic, F.rint(at)).otherwise(-1.0).cast("bigint")))
    rows = rows.withColumn("_ph", F.when(F.col("_l") & periodic, phase(t, F.col("_t1"), F.col("period_days"))))
    odd, even = F.when(F.col("_e") % 2 == 1, p), F.when(F.col("_e") % 2 == 0, p)
    near = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ph = F.col("_ph")
    h = rows.groupBy("star_id").agg(
        F.count("_e").alias("n_high"), F.first("period_days").alias("cand_period_days"), F.percentile(F.when(F.col("_h"), F.abs(at - F.col("_e"))), F.lit(0.5)).alias("_off"),
        F.count(odd).alias("_odd"), F.count(even).alias("_even"), F.avg(odd).alias("_po"), F.avg(even).alias("_pe"), F.size(F.collect_set("_e")).alias("_epochs"),
        near(F.abs(ph - 0.5) <= NEAR_PHASE).alias("_half"), near(F.least(ph, 1 - ph) <= NEAR_PHASE).alias("_zero"),
    )
    gap = F.when((F.col("_epochs") >= 4) & (F.col("_odd") >= 2) & (F.col("_even") >= 2) & (F.col("cand_period_days") > 0), F.abs(F.col("_po") - F.col("_pe")))
    return h.select(
        "star_id", F.col("n_high").alias("n_segments_above_thr"), (F.col("n_high") == 1).cast("int").alias("flag_singleton_spike"), "cand_period_days",
        F.coalesce((F.col("_off") <= OFF_EPOCH).cast("int"), F.lit(0)).alias("flag_periodic"), gap.alias("odd_even_score_gap"), ((F.col("_half") >= 2) & (F.col("_zero") >= 2)).cast("int").alias("flag_secondary_proxy"),
    )


def _with_flags(stars: DataFrame, df: DataFrame, threshold: float) -> DataFrame:
    """``stars`` with their flags, which are 0 without a high window."""
    zero = ["n_segments_above_thr", "flag_singleton_spike", "flag_periodic", "flag_secondary_proxy"]
    return stars.join(_flags(df, threshold), "star_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def triage_flags(df: DataFrame, threshold: float) -> DataFrame:
    """Singleton, periodic, odd-even gap and secondary flags of each star."""
    df = checkpointed(df.select("star_id", "p", "seg_mid_time"))
    return _with_flags(df.select("star_id").distinct(), df, threshold)


def triage_table(df: DataFrame, threshold: float = 0.8, top_n: int = 10, passthrough: tuple = ("mission",), strings: int = 5) -> DataFrame:
    """One row for each star with its scores, strings and flags; sort by ``TRIAGE_ORDER``. All but the flags is one aggregate."""
    df = checkpointed(df.select("star_id", "start", "p", "seg_mid_time", *passthrough))
    top = F.when(F.col("_rank") <= top_n, F.col("p"))
    rows = ranked(df, ["star_id"]).groupBy("star_id").agg(
        F.count("*").alias("n_segments"), F.max("p").alias("best_segment_score"), F.avg(top).alias("topN_mean"), F.stddev_pop(top).alias("topN_std"),
        best_as_text(4, "p", strings).alias("top_scores"), best_as_text(6, "seg_mid_time", strings).alias("top_times"), *(F.mode(c, True).alias(c) for c in passthrough),
    )
    out = _with_flags(rows.withColumn("consistency_score", F.col("topN_mean") - F.col("topN_std")), df, threshold)
    return out.select(*(c for c in out.columns if c not in passthrough), *passthrough)


TRIAGE_ORDER = ["best_segment_score", "consistency_score", "flag_periodic", "n_segments_above_thr"]


def sorted_triage(table: DataFrame) -> DataFrame:
    return table.orderBy(*(F.desc(c) for c in TRIAGE_ORDER), "star_id")


def vetting_extract(points: DataFrame, summary: DataFrame, window: int, stride: int, neighbours_from: int = 20, least_points: int = 10) -> DataFrame:
    """(star_id, mission, panel, idx, time, flux, residual): whole curve, best window, and its neighbours on long curves, of each ok curve."""
    on = shared_key(points, summary)
    ok = summary.where("status = 'ok'").select(*on, "best_start", "n_segments", F.col("n_points"))
    rows = points.withColumn("_raw", F.col("flux")).join(ok, on)
    clipped = mad_clip(rows, star_key(points)).withColumn("residual", F.col("_raw") - F.col("clipped"))
    panel = lambda name, shift, cond: F.when(cond & (F.col("idx") >= F.col("best_start") + shift) & (F.col("idx") < F.col("best_start") + shift + window), F.lit(name))
    long_ = F.col("n_segments") > neighbours_from
    panels = F.array_compact(F.array(F.lit("curve"), panel("best", 0, F.lit(True)), panel("before", -stride, long_), panel("after", stride, long_)))
    return clipped.where(F.col("n_points") >= least_points).withColumn("panel", F.explode(panels)).select(*star_key(points), "panel", "idx", "time", "flux", "residual")
