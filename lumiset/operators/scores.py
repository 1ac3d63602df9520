"""Star scores, rankings, hard negatives, metrics and thresholds over scored windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed
from .ranks import approximate_quantiles, exact_quantiles, global_cumsum
from .windows import shared_key, star_key, window_key


def ranked(df: DataFrame, keys: list[str], score: str = "p", tie: str = "start") -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))


def topk_mean(df: DataFrame, keys: list[str], k: int, score: str = "p") -> DataFrame:
    return ranked(df, keys, score).where(F.col("_rank") <= k).groupBy(*keys).agg(F.avg(score).alias("score"))


def aggregate_scores(df: DataFrame, keys: list[str], mode: str, k: int = 5, score: str = "p") -> DataFrame:
    """``topk_mean``, ``max`` or ``mean`` of a star's window scores."""
    if mode == "topk_mean":
        return topk_mean(df, keys, k, score)
    return df.groupBy(*keys).agg({"max": F.max, "mean": F.avg}[mode](score).alias("score"))


def star_scores(df: DataFrame, k: int = 10, score: str = "p") -> DataFrame:
    """Label, maximum, mean and median of the best ``k``, and number of windows of each star."""
    top = F.when(F.col("_rank") <= k, F.col(score))
    return ranked(df, ["star_id"], score).groupBy("star_id").agg(F.max("label").alias("y_star"), F.max(score).alias("score_max"), F.avg(top).alias("top_mean"), F.percentile(top, F.lit(0.5)).alias("top_median"), F.count("*").alias("n"), F.avg(F.when(F.col(score) > 0.6, 1.0).otherwise(0.0)).alias("share_high"))


def score_fused() -> Column:
    return F.col("top_median") + 0.10 * F.col("share_high") - 0.20 * (F.col("score_max") - F.col("top_mean"))


def score_summary(curves: DataFrame, scored: DataFrame, window: int, score: str = "p") -> DataFrame:
    """One row for each curve: statistics of its scores, its best window (the first of equals), and a status."""
    q = lambda p: F.percentile(score, F.lit(p))
    on = shared_key(scored, curves)
    stats = scored.groupBy(*on).agg(F.count("*").alias("n_segments"), F.max(score).alias("best"), F.avg(score).alias("mean"), q(0.5).alias("median"), F.stddev_pop(score).alias("std"), q(0.95).alias("p95"), F.max_by("start", F.struct(F.col(score), -F.col("start"))).alias("best_start"))
    status = F.when(F.coalesce("n_points", F.lit(0)) < window, "too_short_or_missing").when(F.col("n_segments").isNull(), "no_segments").otherwise("ok")
    return curves.join(stats, on, "left").withColumn("status", status).withColumn("best_end", F.col("best_start") + window).withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))


def score_rows(curves: DataFrame, scored: DataFrame, window: int, stride: int, errors: DataFrame | None = None) -> DataFrame:
    """The sixteen fields of a curve's score: its lengths, statistics, best window with its number, place and times, status, error.

    ``scored``: windows with start, t_first, t_last and score; of equal scores the first window is the best. ``errors``: (star_id,
    mission, error) of curves that could not be read. Without windows numbers are null and places -1.
    """
    q = lambda p: F.percentile("p", F.lit(p))
    stats = scored.groupBy(*star_key(scored)).agg(F.count("*").alias("n_segments"), F.max("p").alias("best_seg_score"), F.avg("p").alias("mean_seg_score"), q(0.5).alias("median_seg_score"), F.stddev_pop("p").alias("std_seg_score"), q(0.95).alias("p95_seg_score"), F.max(best_window()).alias("best"))
    return as_score_rows(curves, stats, window, stride, errors)


def best_window() -> Column:
    """Aggregated by max: the highest score, and of equals the first window."""
    return F.struct(F.col("p"), (-F.col("start")).alias("back"), F.col("t_first"), F.col("t_last"))


def as_score_rows(curves: DataFrame, stats: DataFrame, window: int, stride: int, errors: DataFrame | None = None) -> DataFrame:
    key = shared_key(curves, stats)
    rows = curves.select(*star_key(curves), "n_points").join(stats, key, "left")
    rows = rows.join(errors.select(*shared_key(curves, errors), "error"), shared_key(curves, errors), "left") if errors is not None else rows.withColumn("error", F.lit(None).cast("string"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("n_points", F.lit(0)) < window, "too_short_or_missing").when(F.col("n_segments").isNull(), "no_segments").otherwise("ok")
    start = -F.col("best.back")
    place = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    return rows.select(
        *star_key(curves), F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), "best_seg_score", "mean_seg_score", "median_seg_score", "std_seg_score", "p95_seg_score",
        status.alias("status"), F.coalesce("error", F.lit("")).alias("error"), place(F.floor(start / stride)).alias("best_seg_idx"), place(start).alias("best_start"), place(start + window).alias("best_end"),
        F.col("best.t_first").alias("best_t0"), F.col("best.t_last").alias("best_t1"),
    )


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.avg("label").alias("pos_share"), F.countDistinct("star_id").alias("n_stars"))


def describe(df: DataFrame, column: str) -> DataFrame:
    stats = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    return stats.crossJoin(F.broadcast(exact_quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})))


def quantiles(df: DataFrame, column: str, at: list[float], exact: bool = True) -> DataFrame:
    """(q, value); not ``exact``: by a sketch in one pass (see ranks.approximate_quantiles)."""
    values = (exact_quantiles if exact else approximate_quantiles)(df, column, {f"_{i}": q for i, q in enumerate(at)})
    return values.select(F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"_{i}").alias("value")) for i, q in enumerate(at)))).alias("x")).select("x.q", "x.value")


def mode_or_first(df: DataFrame, key: str, column: str) -> DataFrame:
    """The most frequent value of a column for each key, the smallest of equals."""
    return df.groupBy(key).agg(F.mode(column, True).alias(column))


def histogram(df: DataFrame, column: str, bins: int, lo: float, hi: float) -> DataFrame:
    b = F.least(F.width_bucket(column, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).alias("bin")
    return df.select(b).groupBy("bin").agg(F.count("*").alias("n"))


def depth_by_label(windows: DataFrame, value: str = "flux") -> DataFrame:
    """Fifth percentile and minimum of each window, then their median and mean by label."""
    each = checkpointed(window_depths(windows, value))
    means = each.groupBy("label").agg(F.avg("q05").alias("q05_mean"), F.avg("lo").alias("min_mean"))
    return means.join(exact_quantiles(each, "q05", {"q05_median": 0.5}, "label"), "label").join(exact_quantiles(each, "lo", {"min_median": 0.5}, "label"), "label")


def window_depths(windows: DataFrame, value: str = "flux") -> DataFrame:
    return windows.groupBy(*window_key(windows), "label").agg(F.percentile(value, F.lit(0.05)).alias("q05"), F.min(value).alias("lo"))


def deepest_positives(windows: DataFrame, n: int = 12, value: str = "flux") -> DataFrame:
    """The positive windows with the lowest fifth percentiles."""
    each = window_depths(windows.where("label = 1"), value)
    return each.orderBy("q05", *window_key(windows)).limit(n)


def channel_health(df: DataFrame, column: str, tolerance: float = 1e-3) -> DataFrame:
    near = lambda v: F.avg(F.when(F.abs(F.col(column) - v) <= tolerance, 1.0).otherwise(0.0))
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), near(0).alias("near_zero"), near(1).alias("near_one"))


def tensor_sanity(windows: DataFrame, value: str = "flux") -> DataFrame:
    """Zeros, energy and spread over all windows, and the range of the windows' own shares."""
    each = windows.groupBy(*window_key(windows)).agg(F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("z"), F.avg(F.abs(value)).alias("e"), F.count(value).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    mean = F.sum("_s") / F.sum("_n")
    return each.agg(*(f(c).alias(f"{c}_{n}") for c in ("z", "e") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))), F.sqrt(F.greatest(F.sum("_q") / F.sum("_n") - mean * mean, F.lit(0.0))).alias("std"))


def star_counts(df: DataFrame) -> DataFrame:
    n = df.groupBy("star_id").count()
    return n.agg(F.count("*").alias("n_stars"), F.max("count").alias("most"))


# ---- ranking -----------------------------------------------------------------------------------------------------------------


def md5_key(seed: str, *columns: str) -> Column:
    """A random-looking, engine-independent order of rows."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def cap_per_star(df: DataFrame, cap: int, seed: str) -> DataFrame:
    """At most ``cap`` windows of a star, positives at most half of it, chosen by digest."""
    order = Window.partitionBy("star_id", "label").orderBy(md5_key(seed, "star_id", "start"))
    rows = df.withColumn("_n", F.row_number().over(order))
    taken = F.least(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).over(Window.partitionBy("star_id")), F.lit(cap // 2))
    rows = rows.withColumn("_pos", taken)
    return rows.where(F.when(F.col("label") == 1, F.col("_n") <= F.col("_pos")).otherwise(F.col("_n") <= cap - F.col("_pos"))).drop("_n", "_pos")


def head_per_group(df: DataFrame, keys: list[str], k: int, n: int, score: str = "p") -> DataFrame:
    """The best ``k`` rows of each group, then the best ``n`` of all."""
    return ranked(df, keys, score).where(F.col("_rank") <= k).drop("_rank").orderBy(F.desc(score), "star_id", "start").limit(n)


def nlargest(df: DataFrame, n: int, score: str = "p") -> DataFrame:
    return df.orderBy(F.desc(score), "star_id", "start").limit(n)


def star_ranked_hard_negatives(df: DataFrame, stars: int, n: int) -> DataFrame:
    """The highest windows of the negative stars that rank highest."""
    worst = star_scores(df).where("y_star = 0").orderBy(F.desc("top_mean"), "star_id").limit(stars)
    return nlargest(df.where("label = 0").join(worst.select("star_id"), "star_id", "left_semi"), n)


def hard_negative_bank(df: DataFrame, per_star: int, bank: int, take: int) -> DataFrame:
    stars = df.groupBy("star_id").agg(F.max("label").alias("_s")).where("_s = 0").select("star_id")
    rows = df.where("label = 0").join(stars, "star_id", "left_semi")
    return nlargest(head_per_group(rows, ["star_id"], per_star, bank), take)


def mine_hard_negatives(df: DataFrame, per_star: int, pool: int, take: int, seed: str) -> DataFrame:
    """The highest scores of a digest-drawn pool of negatives with at most ``per_star`` of a star."""
    w = Window.partitionBy("star_id").orderBy(md5_key(seed, "star_id", "start"))
    rows = df.where("label = 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_star).drop("_n")
    return nlargest(rows.orderBy(md5_key(seed, "star_id", "start"), "star_id", "start").limit(pool), take)


def precision_at(df: DataFrame, ks: list[int], score: str, label: str, tie: str) -> DataFrame:
    """Precision and lift at each k of the best rows; only the best max(ks) are ranked together."""
    top = df.select(F.col(score).alias("s"), F.col(label).alias("y"), F.col(tie).alias("t")).orderBy(F.desc("s"), "t").limit(max(ks))
    rows = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("s"), "t"))).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("_r <= k")
    base = df.agg(F.avg(label).alias("_base"))
    return rows.groupBy("k").agg(F.avg("y").alias("precision"), F.count("*").alias("n")).crossJoin(F.broadcast(base)).select("k", "n", "precision", F.try_divide("precision", "_base").alias("lift"))


def false_positive_windows(df: DataFrame, stars: int, n: int) -> DataFrame:
    worst = star_scores(df).where("y_star = 0").orderBy(F.desc("score_max"), "star_id").limit(stars)
    return nlargest(df.join(worst.select("star_id"), "star_id", "left_semi"), n)


def gallery_rows(df: DataFrame, n: int) -> DataFrame:
    """The highest negatives, the highest positives and the lowest positives."""
    df = checkpointed(df)
    part = lambda name, rows, order: rows.orderBy(order, "star_id", "start").limit(n).withColumn("category", F.lit(name))
    pos, neg = df.where("label = 1"), df.where("label = 0")
    return part("hard_negative", neg, F.desc("p")).unionByName(part("true_positive", pos, F.desc("p"))).unionByName(part("false_negative", pos, F.asc("p")))


def star_top_windows(df: DataFrame, star: Column, k: int = 12) -> DataFrame:
    return df.where(F.col("star_id") == star).orderBy(F.desc("p"), "start").limit(k)


def vetting_lists(summary: DataFrame, few: int = 20, n: int = 50) -> DataFrame:
    """Short curves by priority, long ones by best score."""
    ok = summary.where("status = 'ok'").withColumn("priority", F.col("best") - 0.5 * F.col("std"))
    short = ok.where(F.col("n_segments") <= few).orderBy(F.desc("priority"), F.desc("best"), "star_id").limit(n).withColumn("list", F.lit("normal"))
    return short.unionByName(ok.where(F.col("n_segments") > few).orderBy(F.desc("best"), "star_id").limit(n).withColumn("list", F.lit("long")))


def decimal_text(x: Column, digits: int) -> Column:
    """``x`` with ``digits`` places, rounded by its exact binary value as C's printf does, ties to even.

    format_string rounds the decimal digits that Java shows, half up: 0.5503125, which is stored as 0.55031249999999998, gives
    0.550313 and not 0.550312. Numbers whose last place is beyond 2**50 are left to it, as are 0, NaN and infinities.
    """
    scale = 10**digits
    size = F.abs(x)
    below = F.floor(size * scale)
    # Twice the distance to the half above ``below``, in two products that are exact since each factor has few bits.
    head = size.cast("float").cast("double")
    over = (head * (2.0 * scale) - (below * 2 + 1).cast("double")) + (size - head) * (2.0 * scale)
    n = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
    return F.when((size > 0) & (size * scale < 2.0**50), text).otherwise(F.format_string(f"%.{digits}f", x))


def best_as_text(digits: int, column: str, k: int) -> Column:
    """Aggregate over ``ranked`` rows: a column of the best ``k`` as text, best first; empty if none is known."""
    best = F.collect_list(F.when((F.col("_rank") <= k) & F.col(column).isNotNull(), F.struct("_rank", column)))
    return F.concat_ws(",", F.transform(F.array_sort(best), lambda x: decimal_text(x[column], digits)))


def top_strings(df: DataFrame, k: int = 5) -> DataFrame:
    """A star's best scores and their times as text, best first; times are empty if none is known."""
    return ranked(df, ["star_id"]).groupBy("star_id").agg(best_as_text(4, "p", k).alias("top_scores"), best_as_text(6, "seg_mid_time", k).alias("top_times"))


# ---- metrics -------------------------------------------------------------------------------------------------------------------


def curve(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """A row for each distinct score: positives and negatives at it, and at it or above, with both totals."""
    y = F.col(label)
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    rows = global_cumsum(by, "threshold", ["pos", "neg"])
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))))


def roc_auc(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """Share of pairs in the right order, ties half; null for one class."""
    area = F.sum(F.col("pos") * (F.col("all_neg") - F.col("cum_neg")) + F.col("pos") * F.col("neg") * 0.5)
    pairs = F.first("all_pos") * F.first("all_neg")
    return curve(df, score, label).agg(F.when(pairs > 0, area / pairs).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """Sum over distinct scores of the gain in recall times the precision there."""
    gain = F.try_divide("pos", "all_pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return curve(df, score, label).agg(F.sum(gain).alias("average_precision"))


def curve_points(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    c = curve(df, score, label)
    return c.select("threshold", F.try_divide("cum_pos", "all_pos").alias("tpr"), F.try_divide("cum_neg", "all_neg").alias("fpr"), (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))


def youden_threshold(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    p = curve_points(df, score, label).withColumn("youden", F.round(F.col("tpr") - F.col("fpr"), 12))
    return p.orderBy(F.desc("youden"), F.desc("threshold")).limit(1).select("threshold", "youden")


def choose_threshold(df: DataFrame, mode: str, target_recall: float = 0.65, score: str = "p", label: str = "label") -> DataFrame:
    """The threshold that is best by balanced accuracy, F1, accuracy, or the highest that reaches a recall; no rows: 0.5."""
    tp, fp, allp, alln = F.col("cum_pos"), F.col("cum_neg"), F.col("all_pos"), F.col("all_neg")
    value = {
        "balanced_accuracy": (F.try_divide(tp, allp) + F.try_divide(alln - fp, alln)) / 2,
        "f1": F.try_divide(2 * tp, allp + tp + fp),
        "accuracy": F.try_divide(tp + alln - fp, allp + alln),
        "recall": F.when(F.try_divide(tp, allp) >= target_recall, F.col("threshold")),
    }[mode]
    best = curve(df, score, label).select("threshold", F.round(value, 12).alias("value")).where("value is not null").orderBy(F.desc("value"), F.desc("threshold")).limit(1)
    return best.agg(F.coalesce(F.max("threshold"), F.lit(0.5)).alias("threshold"), F.max("value").alias("value"))


def confusion(df: DataFrame, threshold: float, score: str = "p", label: str = "label") -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = df.agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_report(df: DataFrame, threshold: float, score: str = "p", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support of each class, and their plain and weighted means."""
    rows = confusion(df, threshold, score, label).selectExpr("stack(2, '1', tp, fp, fn, '0', tn, fn, fp) as (class, hit, wrong, missed)")
    each = rows.select("class", F.coalesce(F.try_divide("hit", F.col("hit") + F.col("wrong")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hit", F.col("hit") + F.col("missed")), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * F.col("hit"), 2 * F.col("hit") + F.col("wrong") + F.col("missed")), F.lit(0.0)).alias("f1"), (F.col("hit") + F.col("missed")).alias("support"))
    names = ("precision", "recall", "f1")
    macro = each.agg(F.lit("macro").alias("class"), *(F.avg(n).alias(n) for n in names), F.sum("support").alias("support"))
    weighted = each.agg(F.lit("weighted").alias("class"), *((F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted)


def eval_report(df: DataFrame, split: str = "split", ks: tuple = (10, 50), modes: tuple = ("max", "mean", "topk_mean"), k: int = 10) -> DataFrame:
    """(split, level, metric, value): for each split the metrics of its windows, of its stars by each aggregate, and of its best rows."""
    rows = checkpointed(df.where(F.col(split).isNotNull()).select(F.col(split).alias("split"), *window_key(df), "label", "p"))
    tie = F.concat_ws("|", "star_id", F.lpad(F.col("start").cast("string"), 8, "0"))
    truth = rows.groupBy("split", "star_id").agg(F.max("label").alias("label"))
    every = rows.select("split", F.lit("window").alias("level"), "label", "p", tie.alias("t"))
    for mode in modes:
        scored = aggregate_scores(rows, ["split", "star_id"], mode, k).join(truth, ["split", "star_id"])
        every = every.union(scored.select("split", F.lit(f"star_{mode}"), "label", F.round("score", 12), "star_id"))
    every = checkpointed(every.withColumn("_k", F.concat_ws("|", "split", "level")))
    counts = every.groupBy("_k", "p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    runs = global_cumsum(counts, "p", ["pos", "neg"], "_k")
    total = every.groupBy("_k", "split", "level").agg(F.sum("label").alias("ap"), F.sum(1 - F.col("label")).alias("an"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    area = F.sum(F.col("pos") * (F.col("an") - F.col("cum_neg")) + F.col("pos") * F.col("neg") * 0.5)
    gain = F.sum(F.try_divide("pos", "ap") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    sums = runs.join(total, "_k").groupBy("_k", "split", "level", "ap", "an", "lo", "hi").agg(F.try_divide(area, F.col("ap") * F.col("an")).alias("roc_auc"), gain.alias("average_precision"))
    whole = sums.select("split", "level", "roc_auc", "average_precision", F.try_divide("ap", F.col("ap") + F.col("an")).alias("base_rate"), (F.col("ap") + F.col("an")).cast("double").alias("n"), "lo", "hi")
    named = lambda df: F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in df.columns[2:]))).alias("x")
    report = whole.select("split", "level", named(whole)).select("split", "level", "x.metric", "x.value")
    place = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("p"), "t"))
    best = every.withColumn("_r", place).where(F.col("_r") <= max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("_r <= k")
    base = total.select("_k", F.try_divide("ap", F.col("ap") + F.col("an")).alias("_base"))
    at = best.groupBy("_k", "split", "level", "k").agg(F.avg("label").alias("precision")).join(base, "_k").select("split", "level", "k", "precision", F.try_divide("precision", "_base").alias("lift"))
    for metric in ("precision", "lift"):
        report = report.union(at.select("split", "level", F.concat(F.lit(f"{metric}_at_"), F.col("k").cast("string")), metric))
    return report


def r_squared(df: DataFrame, y: str, fitted: str) -> DataFrame:
    """1 - squared error / squared deviation from the mean."""
    return df.agg((1 - F.try_divide(F.sum(F.pow(F.col(y) - F.col(fitted), F.lit(2))), F.var_pop(y) * F.count(y))).alias("r2"))
