"""Per-star and per-window preprocessing of light curves in the long layout (star_id, idx, time, flux)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import star_key, window_key


def _null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def finite_or(c: Column, other: float = 0.0) -> Column:
    """NaN, infinities and null become ``other``."""
    x = _null(c)
    return F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(F.lit(other))


def with_median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with the median (``_med``) and median absolute deviation (``_mad``) of its group: rows are dealt and sorted once."""
    group = Window.partitionBy(*keys)
    rows = df.dropna(subset=keys).select(*keys, *(c for c in df.columns if c not in keys))
    rows = rows.withColumn("_med", F.percentile(value, F.lit(0.5)).over(group))
    return rows.withColumn("_mad", F.percentile(F.abs(F.col(value) - F.col("_med")), F.lit(0.5)).over(group))


def mad_normalize(df: DataFrame, keys: list[str], value: str = "flux", clip: float | None = None) -> DataFrame:
    """(x - median) / (MAD + 1e-6), optionally clipped."""
    rows = with_median_mad(df, keys, value)
    z = (F.col(value) - F.col("_med")) / (F.col("_mad") + 1e-6)
    if clip is not None:
        z = F.greatest(F.least(z, F.lit(float(clip))), F.lit(-float(clip)))
    return rows.withColumn("norm", z).drop("_med", "_mad")


def robust_scale(df: DataFrame, keys: list[str], value: str = "flux") -> DataFrame:
    """(x - median) / (population deviation + 1e-8); what is not finite becomes 0, so lengths stay."""
    clean = df.withColumn("_x", _null(F.col(value)))
    stats = clean.groupBy(*keys).agg(F.percentile("_x", F.lit(0.5)).alias("_med"), F.stddev_pop("_x").alias("_sd"))
    return clean.join(stats, keys).withColumn("scaled", finite_or((F.col("_x") - F.col("_med")) / (F.col("_sd") + 1e-8))).drop("_x", "_med", "_sd")


def drop_nan_and_rescale(df: DataFrame, value: str = "flux") -> DataFrame:
    """Without missing points, indexed anew, divided by the star's median."""
    rows = df.where(_null(F.col(value)).isNotNull())
    key = star_key(df)
    rows = rows.dropna(subset=key).select(*key, *(c for c in df.columns if c not in key))
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy(*key).orderBy("idx")) - 1)
    return rows.withColumn("relative", F.col(value) / F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*key)))


#: The sums that a quadratic fit needs: of 1, k, .., k^4 over its points, and of y, k y, k^2 y.
MOMENTS = (*(f"s{p}" for p in range(5)), *(f"y{p}" for p in range(3)))


def _shifted(m: list[Column], by: Column) -> list[Column]:
    """Moments with ``by`` added to every place."""
    d2 = by * by
    s0, s1, s2, s3, s4, y0, y1, y2 = m
    return [
        s0, s1 + by * s0, s2 + 2 * by * s1 + d2 * s0, s3 + 3 * by * s2 + 3 * d2 * s1 + by * d2 * s0, s4 + 4 * by * s3 + 6 * d2 * s2 + 4 * by * d2 * s1 + d2 * d2 * s0,
        y0, y1 + by * y0, y2 + 2 * by * y1 + d2 * y0,
    ]


def _quadratic_trend(rows: DataFrame, key: list[str], window: int, use: Column) -> DataFrame:
    """``_trend``: the value at each point of the quadratic through the points around it for which ``use`` holds.

    ``rows`` have their places ``_i`` and values ``_y``. Moments are summed from the start of each block of ``window`` points, in
    places inside the block, so every row adds its own terms once and numbers stay small on curves of any length. A window
    reaches over two blocks at most: its sums are those up to its last row less those up to the row before its first, or, from
    another block, what comes after that row in its block and those up to the last row in the next. The steps are kept apart
    and free of nulls, so that each is compiled to a small method.
    """
    half, first, last = window // 2, Window.unboundedPreceding, Window.unboundedFollowing
    named = lambda prefix, values: {f"_{prefix}{n}": c for n, c in zip(MOMENTS, values, strict=True)}
    columns = lambda prefix: [F.col(f"_{prefix}{n}") for n in MOMENTS]
    inside = F.pmod("_i", F.lit(window))
    rows = rows.withColumns({"_r": inside.cast("double"), "_w": F.when(use, 1.0).otherwise(0.0), "_wy": F.coalesce(F.when(use, F.col("_y")), F.lit(0.0)), "_b": ((F.col("_i") - inside) / window).cast("long")})
    r, w, y = F.col("_r"), F.col("_w"), F.col("_wy")
    terms = [w, w * r, w * r * r, w * r * r * r, w * r * r * r * r, y, y * r, y * r * r]
    block = Window.partitionBy(*key, "_b").orderBy("_i")
    rows = rows.withColumns(named("p", [F.sum(x).over(block.rowsBetween(first, 0)) for x in terms]) | named("e", [F.sum(x).over(block.rowsBetween(first, last)) for x in terms]))
    fields = lambda values: [c.alias(n) for n, c in zip(MOMENTS, values, strict=True)]
    after = [e - p for e, p in zip(columns("e"), columns("p"), strict=True)]
    rows = rows.withColumns({"_upto": F.struct("_b", *fields(columns("p"))), "_after": F.struct("_b", *fields(after))}).drop("_r", "_w", "_wy", *named("p", MOMENTS), *named("e", MOMENTS))
    curve = Window.partitionBy(*key).orderBy("_b", "_i")
    ahead = F.coalesce(F.lead("_upto", half).over(curve), F.last("_upto").over(curve.rowsBetween(first, last)))
    rows = rows.withColumns({"_hi": ahead, "_lo": F.lag("_upto", half + 1).over(curve), "_back": F.lag("_after", half + 1).over(curve)}).drop("_upto", "_after", "_b")
    rows = rows.withColumns({"_same": F.coalesce(F.col("_lo._b") == F.col("_hi._b"), F.lit(False)), "_o": F.coalesce((F.col("_hi._b") * window - F.col("_i")).cast("double"), F.lit(0.0))})
    get = lambda c: [F.coalesce(F.col(f"{c}.{n}"), F.lit(0.0)) for n in MOMENTS]
    rows = rows.withColumns(named("h", get("_hi")) | named("l", [F.when(F.col("_same"), x).otherwise(0.0) for x in get("_lo")]) | named("a", [F.when(F.col("_same"), 0.0).otherwise(x) for x in get("_back")])).drop("_hi", "_lo", "_back", "_same")
    # What comes from the block before is moved by a block first, then all of it to the point.
    rows = rows.withColumns(named("a", _shifted(columns("a"), F.lit(-float(window)))))
    rows = rows.withColumns(named("m", [h - x + y for h, x, y in zip(columns("h"), columns("l"), columns("a"), strict=True)])).drop(*named("h", MOMENTS), *named("l", MOMENTS), *named("a", MOMENTS))
    rows = rows.withColumns(named("m", _shifted(columns("m"), F.col("_o")))).drop("_o")
    n, m1, m2, m3, m4, b0, b1, b2 = columns("m")
    rows = rows.withColumns({"_c0": m2 * m4 - m3 * m3, "_c1": m1 * m4 - m2 * m3, "_c2": m1 * m3 - m2 * m2})
    rows = rows.withColumns({"_det": n * F.col("_c0") - m1 * F.col("_c1") + m2 * F.col("_c2"), "_top": b0 * F.col("_c0") - b1 * F.col("_c1") + b2 * F.col("_c2")})
    return rows.withColumn("_trend", F.when(F.abs("_det") > 1e-9, F.col("_top") / F.col("_det"))).drop("_det", "_top", "_c0", "_c1", "_c2", *named("m", MOMENTS))


def detrend(df: DataFrame, window: int = 201, value: str = "flux", clip_rounds: int = 0, sigma: float = 3.0) -> DataFrame:
    """``flat``: value over a local quadratic fit of ``window`` points around it, ``trend``; edges use what is there.

    ``clip_rounds``: so many times, points that are further from the fit than ``sigma`` deviations of the points fitted last
    (of their distances from it, around their mean) are left out of the next fit; they still get a trend and a flat value. A
    missing value takes part in no fit. A fit that is singular or near zero leaves the value as it is. The time a point takes
    does not depend on the window.
    """
    window = 2 * (window // 2) + 1
    key = star_key(df)
    order = Window.partitionBy(*key).orderBy("idx")
    rows = df.withColumn("_y", _null(F.col(value).cast("double"))).withColumn("_i", F.row_number().over(order) - 1).withColumn("_use", F.col("_y").isNotNull())
    for _ in range(clip_rounds):
        rows = _quadratic_trend(rows, key, window, F.col("_use")).withColumn("_d", F.when(F.col("_use"), F.col("_y") - F.col("_trend")))
        rows = rows.withColumn("_sd", F.stddev_pop("_d").over(Window.partitionBy(*key)))
        rows = rows.withColumn("_use", F.col("_use") & F.coalesce(F.abs("_d") <= sigma * F.col("_sd"), F.lit(True))).drop("_d", "_sd", "_trend")
    rows = _quadratic_trend(rows, key, window, F.col("_use"))
    flat = F.when(F.abs("_trend") > 1e-12, F.col(value) / F.col("_trend")).otherwise(F.col(value))
    return rows.select(*df.columns, F.col("_trend").alias("trend"), flat.alias("flat"))


def diff_channel(windows: DataFrame, value: str = "flux") -> DataFrame:
    """``ch1``: the difference to the point before inside each window, 0 for the first."""
    w = Window.partitionBy(*window_key(windows)).orderBy("idx")
    return windows.withColumn("ch1", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))


def adapt_channels(windows: DataFrame, have: int, want: int) -> DataFrame:
    """One channel gets its differences as a second; of two the second is dropped; anything else is an error."""
    if (have, want) == (1, 2):
        return diff_channel(windows)
    if (have, want) == (2, 1):
        return windows.drop("ch1")
    if have == want:
        return windows
    raise ValueError(f"{have} channels cannot become {want}")


def clean_window(c: Column, limit: float = 10.0) -> Column:
    return F.greatest(F.least(finite_or(c), F.lit(limit)), F.lit(-limit))


def center_window(windows: DataFrame, value: str = "flux") -> DataFrame:
    key = window_key(windows)
    rows = windows.dropna(subset=key).select(*key, *(c for c in windows.columns if c not in key))
    return rows.withColumn("centered", F.col(value) - F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*key)))


def uniform(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from the digest of a seed and keys: the same on every run and engine."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def inject_box_transits(points: DataFrame, seed: str, depth_unit: float = 1e-6) -> DataFrame:
    """A box transit in each star's curve with digest-drawn period, duration, depth and first time; ``injected`` marks its points."""
    key = star_key(points)
    span = points.groupBy(*key).agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    draw = lambda name, lo, hi: F.lit(lo) + uniform(f"{seed}-{name}", "star_id") * (hi - lo)
    stars = span.select(*key, "_a", "_b", draw("period", 0.7, 20.0).alias("period_days"), (draw("hours", 1.0, 6.0) / 24).alias("duration_days"), draw("ppm", 200.0, 4000.0).alias("depth_ppm"))
    stars = stars.withColumn("t0", F.col("_a") + uniform(f"{seed}-t0", "star_id") * F.least(F.col("_b") - F.col("_a"), F.col("period_days")))
    p = F.col("period_days")
    phase = F.abs(F.expr("pmod(time - t0 + period_days / 2, period_days)") - p / 2)
    hit = (F.col("_b") > F.col("_a")) & (phase <= F.col("duration_days") / 2)
    rows = points.join(stars, key).withColumn("injected", hit.cast("int"))
    return rows.withColumn("flux", F.when(hit, F.col("flux") - F.col("depth_ppm") * depth_unit).otherwise(F.col("flux"))).drop("_a", "_b")


def min_center_crop(windows: DataFrame, size: int, value: str = "flux") -> DataFrame:
    """The ``size`` points of each window around its minimum (first of equals), moved inside the window."""
    key = window_key(windows)
    n = windows.groupBy(*key).agg(F.min_by(F.col("idx") - F.col("start"), F.struct(value, "idx")).alias("_at"), F.count("*").alias("_n"))
    left = F.greatest(F.least(F.col("_at") - size // 2, F.col("_n") - size), F.lit(0))
    pos = F.col("idx") - F.col("start")
    return windows.join(n.withColumn("_left", left), key).where((pos >= F.col("_left")) & (pos < F.col("_left") + size)).withColumn("crop_pos", pos - F.col("_left")).drop("_at", "_n", "_left")


def center_crop_bin_mean(windows: DataFrame, size: int, bin_size: int, value: str = "flux") -> DataFrame:
    """Means of ``bin_size`` points over the middle ``size`` points; what is left over at the end is dropped."""
    key = window_key(windows)
    n = windows.groupBy(*key).agg(F.count("*").alias("_n"))
    left = F.floor(F.greatest(F.col("_n") - size, F.lit(0)) / 2)
    pos = F.col("idx") - F.col("start") - left
    rows = windows.join(n, key).withColumn("_p", pos).where((F.col("_p") >= 0) & (F.col("_p") < size - size % bin_size))
    return rows.groupBy(*key, F.floor(F.col("_p") / bin_size).alias("bin")).agg(F.avg(value).alias("mean"))


def mad_clip(df: DataFrame, keys: list[str], value: str = "flux", k: float = 6.0) -> DataFrame:
    """Clipped to the median and ``k`` deviations (MAD + 1e-6) around it."""
    rows = with_median_mad(df, keys, value)
    r = k * (F.col("_mad") + 1e-6)
    return rows.withColumn("clipped", F.greatest(F.least(F.col(value), F.col("_med") + r), F.col("_med") - r)).drop("_med", "_mad")
