"""The reference workflows as chains of operators, from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..operators import embeddings as E
from ..operators import sampling as S
from ..operators import scores as R
from ..operators import signals as C
from ..operators import triage as T
from ..operators import windows as W
from ..operators.ranks import global_cumsum
from ..sources import catalogs as A
from ..sources.score_log import by_digest, of_chunk, score_and_append
from ..storage import checkpointed, new_folder, written


def label_mission(catalog: DataFrame, points: DataFrame, mission: str, window: int, stride: int, least: int, more: DataFrame | None = None) -> DataFrame:
    """Labelled segments of a mission's catalog stars: ids, ephemerides on the curves' clocks, windows, points in transit, labels.

    ``more``: ephemerides besides those of the catalog.
    """
    # Both are computed once: ids and missions are nested conditions, which the optimiser would copy into every filter above.
    named = checkpointed(I.add_star_id(catalog))
    ephemeris = I.prepare_ephemeris(named)
    ephemeris = checkpointed((ephemeris.unionByName(more) if more is not None else ephemeris).where(F.col("mission") == mission))
    points = points.where(F.col("mission") == mission)
    curves = points.groupBy("star_id", "mission").agg(F.count("*").alias("n_points"))
    stars = named.select("star_id", "mission").unionByName(ephemeris.select("star_id", "mission"))
    segments = W.mission_segments(stars, curves, mission, window, stride)
    labels = W.label_by_count(segments, W.in_transit_any(points, W.on_curve_clock(ephemeris, points)), least)
    return W.attach_labels(segments, labels.select("star_id", "mission", "start", "end", "label"))


def mission_training_set(scored: DataFrame, seed: str = "7", per_star: int = 4, pool: int = 100, take: int = 30) -> DataFrame:
    """The balanced windows of the training stars with mined hard negatives at double weight; ``n_leaks``: stars in two splits."""
    scored = checkpointed(scored)
    split = S.stratified_star_split(scored, seed)
    train = scored.join(split.where("split = 'train'").select("star_id"), "star_id", "left_semi")
    hard = R.mine_hard_negatives(train, per_star, pool, take, "m")
    leaks = S.split_overlap(scored.select("star_id").join(split.select("star_id", "split"), "star_id")).agg(F.coalesce(F.sum("n_shared"), F.lit(0)).alias("n_leaks"))
    return S.augment_with_hard_negatives(S.balanced_train_set(train, hard, "b", 1, 0.0), hard).crossJoin(F.broadcast(leaks))


def capped_training_set(products: DataFrame, ephemeris: DataFrame, missions: list[str], window: int, stride: int, cap: int, seed: str = "h") -> DataFrame:
    """Capped, weighted and split windows: star_id, mission, start, label, weight, split, values.

    ``products``: points with mission, preferred mission and product_id. Each star's first mission with products is taken and
    its first files are stitched, curves are scaled by median and deviation, windows centered, labelled by overlap with a
    transit of ``ephemeris``, weighted by whether the star has one, capped for each star, and stars split without leaks.
    """
    picked = A.pick_mission(products.select("star_id", "mission", "preferred", "product_id").distinct(), missions).select("star_id", "mission", "product_id", "file_no")
    points = A.stitch(products.drop("preferred", "idx").join(picked, ["star_id", "mission", "product_id"])).select("star_id", "mission", "idx", "time", "flux")
    flat = checkpointed(C.mad_normalize(points, ["star_id", "mission"]).drop("flux").withColumnRenamed("norm", "flux"))
    lengths = flat.groupBy("star_id", "mission").agg(F.count("*").alias("n_points"))
    cut = C.center_window(W.window_points(flat, W.make_segments(lengths, window, stride), window, stride))
    # All that is needed of a window is gathered once: its first and last time, and its values.
    key = W.window_key(cut)
    packed = cut.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("idx", "time", "centered"))).alias("_v"))
    packed = written(packed.select(*key, F.get("_v.time", F.lit(0)).alias("t_first"), F.element_at("_v.time", -1).alias("t_last"), F.col("_v.centered").alias("values")))
    labels = W.confidence_weight(W.label_by_overlap(packed.drop("values"), ephemeris), ephemeris)
    chosen = checkpointed(R.cap_per_star(labels, cap, seed))
    rows = chosen.join(S.group_split(chosen, seed).select("star_id", "split"), "star_id")
    return rows.join(packed.drop("t_first", "t_last"), ["star_id", "mission", "start"])


def injected_dataset(targets: DataFrame, points: DataFrame, window: int, stride: int, detrend: int, share: float = 0.5, seed: str = "s", depth_unit: float = 1e-6, priority: tuple = (), banned: tuple = ()) -> DataFrame:
    """Windows with injected transits, written by split and read again: star_id, mission, start, end, split, label, values, ch1.

    ``targets``: target ids with a position. ``points`` of several products of a star (product_id and provenance) are those of the
    first usable one by ``priority``, with a new index. Stars are split by position, ``share`` of the stars gets a transit, curves are
    detrended and scaled, windows are labelled by a transit in their middle, and the second channel holds differences.
    """
    order = global_cumsum(targets.withColumn("one", F.lit(1)), "pos", ["one"], descending=False).select(F.col("target").alias("star_id"), (F.col("cum_one") - 1).alias("place"))
    split = S.positional_split(order, "place").select("star_id", "split")
    chosen = S.choose_stars(split, share, seed, True)
    curves = points.join(split.select("star_id"), "star_id", "left_semi")
    if "product_id" in points.columns:
        lengths = curves.groupBy("star_id", "provenance", "product_id").agg(F.count("time").alias("n_time"), F.count("flux").alias("n_flux"))
        best = A.pick_product(lengths, list(priority), list(banned)).select("star_id", "product_id")
        picked = curves.join(best, ["star_id", "product_id"], "left_semi").withColumn("file_no", F.lit(1))
        curves = A.stitch(picked).select("star_id", "mission", "idx", "time", "flux")
    positive = C.inject_box_transits(curves.join(chosen, "star_id", "left_semi"), seed, depth_unit)
    own = ("period_days", "duration_days", "depth_ppm", "t0", "injected")
    plain = curves.join(chosen, "star_id", "left_anti")
    both = checkpointed(positive.unionByName(plain, allowMissingColumns=True))
    flat = C.robust_scale(C.detrend(both.drop(*own), detrend).drop("flux", "trend").withColumnRenamed("flat", "flux"), ["star_id", "mission"]).drop("flux").withColumnRenamed("scaled", "flux")
    lengths = both.groupBy("star_id", "mission").agg(F.count("*").alias("n_points"))
    cut = C.diff_channel(W.window_points(flat, W.make_segments(lengths, window, stride), window, stride))
    ephemeris = both.where("period_days is not null").select("star_id", "mission", "period_days", "duration_days", F.col("t0").alias("t0_mission")).distinct()
    labels = W.label_centered(W.segment_times(cut), ephemeris)
    packed = cut.groupBy("star_id", "mission", "start", "end").agg(F.array_sort(F.collect_list(F.struct("idx", "flux", "ch1"))).alias("_v"))
    rows = packed.join(labels, ["star_id", "mission", "start"]).join(split, "star_id")
    return written(rows.select("star_id", "mission", "start", "end", "split", "label", F.col("_v.flux").alias("values"), F.col("_v.ch1").alias("ch1")), "windows", ("split",))


SCORE_ROW = "star_id string, mission string, n_points long, n_segments long, best double, std double, best_start long, status string"


def score_curves(points: DataFrame, window: int, stride: int, detrend: int, scorer=E.dip_score) -> tuple[DataFrame, DataFrame]:
    """Prepared curves, and the rows of their scores: without missing points, detrended, scaled by median and deviation, clipped."""
    curves = C.drop_nan_and_rescale(points).drop("flux").withColumnRenamed("relative", "flux")
    flat = C.detrend(curves, detrend).drop("flux", "trend").withColumnRenamed("flat", "flux")
    flat = checkpointed(C.mad_normalize(flat, ["star_id", "mission"], clip=10.0).drop("flux").withColumnRenamed("norm", "flux"))
    lengths = flat.groupBy("star_id", "mission").agg(F.count("*").alias("n_points"))
    scored = scorer(W.window_points(flat, W.make_segments(lengths, window, stride), window, stride))
    return flat, R.score_summary(lengths, scored, window)


def vet(points: DataFrame, lists: DataFrame, window: int, stride: int, detrend: int, few: int = 20, scorer=E.dip_score) -> tuple[DataFrame, DataFrame]:
    """The picked stars scored once more from their points, without regard to earlier scores, and the extract's rows of them."""
    flat, again = score_curves(points.join(lists.select("star_id"), "star_id", "left_semi"), window, stride, detrend, scorer)
    again = checkpointed(again)
    return again, T.vetting_extract(flat, again, window, stride, few)


def score_and_vet(points: DataFrame, wanted: DataFrame, done: DataFrame, window: int, stride: int, detrend: int, few: int = 20, n: int = 50, log: str | None = None, save_every: int = 100_000) -> DataFrame:
    """Vetting lists with the best score when scored again and the extract's rows, of the wanted stars that no earlier run has scored.

    Scores are appended to a score log in chunks, so a run that fails goes on where it was.
    """
    stars = checkpointed(A.append_scores(wanted.select("star_id").distinct(), done, "star_id"))
    points = by_digest(points.join(stars, "star_id", "left_semi"))
    score = lambda chunk: score_curves(of_chunk(points, chunk), window, stride, detrend)[1]
    summary = checkpointed(score_and_append(stars, log or new_folder(points.sparkSession, "scores"), score, SCORE_ROW, save_every=save_every))
    lists = checkpointed(R.vetting_lists(summary, few, n))
    again, extract = vet(points.drop("_digest"), lists, window, stride, detrend, few)
    counts = extract.groupBy("star_id").agg(F.count("*").alias("n_extract"))
    return lists.join(again.select("star_id", F.col("best").alias("best_again")), "star_id", "left").join(counts, "star_id", "left")


def survey(points: DataFrame, window: int, stride: int, k: int = 5, scorer=E.dip_score) -> DataFrame:
    """(star_id, score): a whole catalog's stars by the mean of the best windows of their normalised curves, best first."""
    rows = E.score_stars(points, window, stride, k, scorer)
    return rows.groupBy("star_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "star_id")


def triage_windows(points: DataFrame, segments: DataFrame, scorer, window: int, stride: int, q: float = 0.99, path: str | None = None, **filters) -> DataFrame:
    """The triage table of stored ``segments``: their windows are cut again from the curves, filtered, scored, and sorted out."""
    cut = checkpointed(W.window_points(points, segments, window, stride))
    keep = W.filter_segments(cut, **filters).select("star_id", "mission", "start")
    scored = scorer(cut.join(keep, ["star_id", "mission", "start"], "left_semi"))
    rows = scored.join(W.segment_times(cut).select("star_id", "mission", "start", "seg_mid_time"), ["star_id", "mission", "start"])
    return triage_run(rows, q, path)


def triage_run(scored: DataFrame, q: float = 0.99, path: str | None = None) -> DataFrame:
    """The triage table at the scores' own quantile, written as CSV in its order and read again."""
    scored = checkpointed(scored)
    threshold = T.threshold_from_percentile(scored, q).first()["threshold"]
    table = T.sorted_triage(T.triage_table(scored, threshold if threshold is not None else 1.0))
    path = path or f"{new_folder(scored.sparkSession, 'triage')}/triage.csv"
    A.write_table(table, path)
    return scored.sparkSession.read.schema(table.schema).option("header", True).csv(path)


def evaluate(scored: DataFrame, split: DataFrame, bank: tuple = (3, 200, 50), worst: tuple = (5, 40)) -> DataFrame:
    """The evaluation report of each split, with the fused star score, the hard-negative bank, false positives and leaks between splits."""
    rows = checkpointed(scored.join(split.select("star_id", "split"), "star_id"))
    report = R.eval_report(rows)
    fused = R.star_scores(rows).select(F.col("y_star").alias("label"), F.round(R.score_fused(), 12).alias("p"))
    more = {
        ("fused", "average_precision"): R.average_precision(fused), ("fused", "roc_auc"): R.roc_auc(fused),
        ("hard_negative_bank", "mean"): R.hard_negative_bank(rows, *bank).agg(F.avg("p")), ("false_positives", "mean"): R.false_positive_windows(rows, *worst).agg(F.avg("p")),
        ("leaks", "n"): S.split_overlap(rows).agg(F.coalesce(F.sum("n_shared"), F.lit(0)).cast("double")),
    }
    for (level, metric), value in more.items():
        report = report.unionByName(value.toDF("value").select(F.lit("all").alias("split"), F.lit(level).alias("level"), F.lit(metric).alias("metric"), "value"))
    return report


def embedding_report(vectors: DataFrame, windows: DataFrame, lines: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(part, name, value): health of the vectors, pooled stars, mean of loose scores, fit of smoothed scores on the fifth held
    out and those above their 99 % cut, held-out accuracy of a classifier, the spread of two components, the weirdest vectors and the nearest ones.

    ``vectors``: key, vec and a numeric ``score``; ``windows``: star_id, start, p, vec; ``lines``: text of loose scores.
    """
    vectors = checkpointed(vectors.select(key, vec, "score"))
    rows = lambda part, df: df.select(F.lit(part).alias("part"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns))).alias("x")).select("part", "x.name", "x.value")
    named = lambda part, df, name, value: df.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    health = E.embedding_health(vectors, vec)
    pooled = E.pool_embeddings(windows)
    smooth = checkpointed(E.boosted_smooth_scores(vectors, "score", key, vec).select(key, vec, "score", "smooth", "split"))
    middle = F.round(F.percentile_approx("score", 0.5), 9)
    labelled = vectors.crossJoin(F.broadcast(vectors.agg(middle.alias("_m")))).withColumn("label", (F.col("score") > F.col("_m")).cast("int"))
    judged = E.binary_embedding_classifier(labelled.select(key, vec, "label"), key, vec=vec).where("split = 'test'")
    spread = E.pca(vectors, 2, vec).agg(F.stddev_pop(F.col("pc")[0]).alias("pc0"), F.stddev_pop(F.col("pc")[1]).alias("pc1"))
    out = rows("health", health).unionByName(rows("pooled", pooled.agg(F.count("vec").alias("n_stars"), F.count("reason").alias("n_bad"))))
    out = out.unionByName(rows("loose_scores", A.loose_scores(lines).agg(F.avg("score").alias("mean"), F.count("*").alias("n"))))
    out = out.unionByName(rows("smooth", R.r_squared(smooth.where("split = 'test'"), "score", "smooth"))).unionByName(rows("smooth", E.above_cut(smooth, "smooth").agg(F.count("*").alias("n_above"))))
    out = out.unionByName(rows("classifier", judged.agg(F.avg((F.col("label") == (F.col("probability") >= 0.5).cast("int")).cast("int")).alias("accuracy"), F.count("*").alias("n"))))
    out = out.unionByName(rows("components", spread)).unionByName(named("weird", E.weird_stars(smooth, key, vec), key, "outlier_score"))
    best = smooth.orderBy(F.desc("smooth"), key)
    return out.unionByName(named("nearest", E.nearest_to(smooth, best, 15, key, vec), key, "distance"))
