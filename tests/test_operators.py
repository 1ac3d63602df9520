"""Properties and edge rows of the light-curve operators."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumiset.functions import ids
from lumiset.operators import embeddings, ranks, sampling, scores, signals, triage, windows
from lumiset.plans import fixtures
from lumiset.schemas import CATALOG, EPHEMERIS, ensure_columns, require_columns
from lumiset.sources import catalogs, layout, score_log
from lumiset.streaming import star_scores


def test_windows_of_short_and_exact_curves(spark):
    curves = spark.createDataFrame([("a", "k2", 0), ("b", "k2", 3), ("c", "k2", 4), ("d", "k2", 9)], "star_id string, mission string, n_points long")
    rows = {(r.star_id, r.start, r.end) for r in windows.make_segments(curves, 4, 2).collect()}
    assert rows == {("c", 0, 4), ("d", 0, 4), ("d", 2, 6), ("d", 4, 8)}
    assert {(r.star_id, r.start) for r in windows.tumbling_segments(curves, 4).collect()} == {("d", 0), ("d", 4)}
    n = {r.star_id: r.n for r in curves.select("star_id", windows.count_windows(F.col("n_points"), 4, 2).alias("n")).collect()}
    assert n == {"a": 0, "b": 0, "c": 1, "d": 3}


def test_overlap_closed_form_is_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, a := rng.uniform(0, 50), a + rng.uniform(0, 5), rng.uniform(-20, 20), p := rng.uniform(0.5, 30), p * rng.uniform(0.01, 0.19)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, a double, b double, t0 double, p double, d double")
    got = {r.i: r.hit for r in df.select("i", windows.overlaps_transit(*(F.col(c) for c in ("a", "b", "t0", "p", "d"))).alias("hit")).collect()}
    for i, a, b, t0, p, d in rows:
        assert got[i] == any(t0 + k * p + 1.5 * d >= a and t0 + k * p - 1.5 * d <= b for k in range(int((a - t0) / p) - 3, int((b - t0) / p) + 4))


def test_in_transit_edges(spark):
    df = spark.createDataFrame([(0.1, 0.0, 0.25, 0.02), (-0.3, 0.0, 0.25, 0.12), (0.0, 0.0, 0.0, 0.1), (0.0, 0.0, 1.0, 0.5), (None, 0.0, 1.0, 0.1), (2.0, 0.0, 1.0, 0.1)], "t double, t0 double, p double, d double")
    hit = [r.h for r in df.select(windows.in_transit(F.col("t"), F.col("t0"), F.col("p"), F.col("d")).alias("h")).collect()]
    assert hit == [False, False, False, False, False, True]


def test_metrics_against_loops(spark):
    rng = random.Random(5)
    data = [(f"s{i % 7}", i, rng.randrange(20) / 20, int(rng.random() < 0.3)) for i in range(300)]
    df = spark.createDataFrame(data, "star_id string, start int, p double, label int")
    pos, neg = [p for *_, p, y in data if y], [p for *_, p, y in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert scores.roc_auc(df).first()[0] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted({p for *_, p, _ in data}, reverse=True):
        tp = sum(p >= t for p in pos)
        ap, last = ap + (tp / len(pos) - last) * tp / (tp + sum(p >= t for p in neg)), tp / len(pos)
    assert scores.average_precision(df).first()[0] == pytest.approx(ap)
    one = df.where("label = 0")
    assert scores.roc_auc(one).first()[0] is None
    assert scores.choose_threshold(one.where("p > 2"), "f1").first()["threshold"] == 0.5


def test_splits_are_disjoint_and_complete(spark):
    rows = [(f"s{i}", j, int(i % 5 == 0)) for i in range(60) for j in range(3)]
    df = spark.createDataFrame(rows, "star_id string, start int, label int")
    split = sampling.stratified_star_split(df, "1").collect()
    assert len(split) == len({r.star_id for r in split}) == 60
    assert {(r.has_pos, r.split) for r in split} == {(y, s) for y in (0, 1) for s in ("train", "val", "test")}
    joined = df.join(sampling.stratified_star_split(df, "1").select("star_id", "split"), "star_id")
    assert sampling.split_overlap(joined).count() == 0


def test_ids_of_all_shapes(spark):
    df = spark.createDataFrame([("EPIC 1",), ("EPIC-1",), ("EPIC__1",), ("  ",), ("nan",), (None,)], "x string")
    assert [r[0] for r in df.select(ids.normalize_star_id(ids.clean(F.col("x")))).collect()] == ["EPIC_1", "EPIC_1", "EPIC_1", None, None, None]
    got = catalogs.load_ids(spark.createDataFrame([("EPIC 12.0", 3), ("12", 1), ("x", 2), (None, 0)], "x string, pos int"), "x", "pos")
    assert [(r.target, r.pos) for r in got.collect()] == [("12", 1)]


def test_schema_helpers(spark):
    df = ensure_columns(spark.createDataFrame([(float("nan"), "a")], "period_days double, star_id string"), EPHEMERIS)
    assert df.columns == EPHEMERIS.fieldNames() and df.first()["period_days"] is None
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(df, ["nothing"])


def test_scaling_keeps_length_with_broken_points(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 2.0, float("nan"), None, 4.0, 3.0])], "star_id string, idx int, flux double")
    rows = {r.idx: r.scaled for r in signals.robust_scale(df, ["star_id"]).collect()}
    assert len(rows) == 6 and rows[2] == rows[3] == 0 and rows[4] == pytest.approx(1.5 / (1.25**0.5 + 1e-8))
    broken = df.withColumn("flux", F.when(F.col("idx") == 4, float("inf")).otherwise(F.col("flux")))
    # An infinite point makes the deviation not finite, and then no point has a finite scaled value.
    assert [r.scaled for r in signals.robust_scale(broken, ["star_id"]).collect()] == [0.0] * 6
    assert signals.drop_nan_and_rescale(df).count() == 4


def two_missions(spark):
    """One star with a curve of 32 points in each of two missions, and a planet in one."""
    points = spark.createDataFrame([("K2-398", m, i, i / 10, float(i % 5)) for m in ("k2", "tess") for i in range(32)], "star_id string, mission string, idx long, time double, flux double")
    ephemeris = spark.createDataFrame([("K2-398", "k2", 1.0, 0.0, 0.15)], "star_id string, mission string, period_days double, t0_mission double, duration_days double")
    return points, ephemeris


def test_missions_of_a_star_are_apart(spark):
    points, ephemeris = two_missions(spark)
    hits = windows.in_transit_any(points, ephemeris)
    assert hits.count() == 64 and {r.mission for r in hits.where("hit = 1").collect()} == {"k2"}
    curves = points.groupBy("star_id", "mission").agg(F.count("*").alias("n_points"))
    segments = windows.make_segments(curves, 16, 16)
    cut = windows.window_points(points, segments, 16, 16)
    assert cut.count() == 64
    labels = {(r.mission, r.start): r.label for r in windows.label_by_count(segments, hits, 1).collect()}
    assert labels == {("k2", 0): 1, ("k2", 16): 1, ("tess", 0): 0, ("tess", 16): 0}
    times = windows.segment_times(cut)
    for f in (windows.label_by_overlap, windows.label_centered):
        found = {(r.mission, r.start): r.label for r in f(times, ephemeris).collect()}
        assert len(found) == 4 and found["tess", 0] == found["tess", 16] == 0
    weights = {r.mission: r.weight for r in windows.confidence_weight(segments, ephemeris).collect()}
    assert weights == {"k2": 1.0, "tess": 0.3}
    assert signals.detrend(points, 9).count() == signals.robust_scale(points, ["star_id", "mission"]).count() == 64
    assert signals.diff_channel(cut).where("idx = start and ch1 = 0").count() == 4


def test_labels_follow_the_curves_clock(spark):
    points, ephemeris = two_missions(spark)
    late = points.withColumn("time", F.col("time") + ids.BKJD)
    assert windows.in_transit_any(late, windows.on_curve_clock(ephemeris, late)).where("hit = 1").count() == windows.in_transit_any(points, windows.on_curve_clock(ephemeris, points)).where("hit = 1").count() == 4
    segments = windows.make_segments(points.groupBy("star_id", "mission").agg(F.count("*").alias("n_points")), 16, 16)
    rows = {r.label: (r.n, r.lo, r.hi) for r in windows.count_diagnostic(segments, late, ephemeris, 1).collect()}
    assert rows == {0: (2, 0, 0), 1: (2, 2, 2)}


def test_detrend_of_a_long_curve(spark):
    n, half = 200_000, 50
    rng = np.random.default_rng(1)
    flux = 1 + 1e-3 * np.sin(np.arange(n) / 500) + rng.normal(0, 1e-4, n)
    df = spark.createDataFrame(pd.DataFrame({"star_id": "a", "idx": np.arange(n), "flux": flux}))
    got = {r.idx: r.trend for r in signals.detrend(df, 2 * half + 1).where("idx % 9973 = 0 or idx > 199990").collect()}
    for i, trend in got.items():
        k = np.arange(max(0, i - half), min(n, i + half + 1))
        assert abs(np.polynomial.polynomial.polyfit(k - i, flux[k], 2)[0] - trend) < 1e-9


def test_clipped_detrend_is_the_loop(spark):
    """Three rounds of three deviations against a loop over polynomial fits, for windows of any size, with gaps and two missions."""
    rng = np.random.default_rng(4)
    for window in (7, 101):
        curves = {}
        for mission, n in (("k2", 400), ("tess", 57), ("kepler", 2)):
            y = 2 + np.sin(np.arange(n) / 30) + rng.normal(0, 0.01, n)
            y[::17] += rng.normal(0, 0.5, len(y[::17]))
            y[5:9] = np.nan
            curves[mission] = y
        rows = [("a", m, i, float(v)) for m, y in curves.items() for i, v in enumerate(y)]
        df = spark.createDataFrame(rows, "star_id string, mission string, idx long, flux double")
        got = {(r.mission, r.idx): r for r in signals.detrend(df, window, clip_rounds=3).collect()}
        assert len(got) == len(rows)
        for m, y in curves.items():
            n, h, use = len(y), window // 2, ~np.isnan(y)

            def fit():
                out = np.full(n, np.nan)  # noqa: B023
                for i in range(n):  # noqa: B023
                    k = np.arange(max(0, i - h), min(n, i + h + 1))  # noqa: B023
                    k = k[use[k]]  # noqa: B023
                    if len(k) >= 3:
                        out[i] = np.linalg.lstsq(np.vander((k - i).astype(float), 3, increasing=True), y[k], rcond=None)[0][0]  # noqa: B023
                return out

            for _ in range(3):
                d = np.where(use, y - fit(), np.nan)
                use &= ~(np.abs(d) > 3 * np.nanstd(d)) if np.isfinite(d).any() else use
            trend = fit()
            assert m == "kepler" or (~use).sum() > 4
            for i in range(n):
                r = got[m, i]
                assert (r.trend is None) == bool(np.isnan(trend[i])) and (r.trend is None or abs(r.trend - trend[i]) < 1e-7)
                assert np.isnan(y[i]) == bool(np.isnan(r.flat)) and (np.isnan(y[i]) or r.flat == pytest.approx(y[i] / r.trend if r.trend is not None else y[i], abs=1e-12))


def strata(spark, n_pos, n_neg):
    rows = [(f"s{i:03}", int(i < n_pos)) for i in range(n_pos + n_neg)]
    return spark.createDataFrame(rows, "star_id string, label int")


def sizes(split):
    out = {}
    for r in split.collect():
        out[r.split, r.has_pos] = out.get((r.split, r.has_pos), 0) + 1
    return out


def test_split_quotas_by_largest_remainders(spark):
    def quotas(n, take):
        """Whole parts, then the largest remainders; the positive stratum first."""
        whole = {k: take * v // sum(n.values()) for k, v in n.items()}
        order = sorted(n, key=lambda k: (-(take * n[k] % sum(n.values())), -k))
        return {k: whole[k] + (order.index(k) < take - sum(whole.values())) for k in n}

    for n_pos, n_neg in ((10, 10), (1, 19), (19, 1), (0, 20), (7, 0), (1, 1), (3, 50), (33, 68)):
        n = {1: n_pos, 0: n_neg}
        t = quotas(n, math.ceil(0.15 * (n_pos + n_neg)))
        left = {k: n[k] - t[k] for k in n}
        v = quotas(left, math.ceil(0.15 * sum(left.values()))) if sum(left.values()) else {1: 0, 0: 0}
        want = {("test", k): t[k] for k in n} | {("val", k): v[k] for k in n} | {("train", k): left[k] - v[k] for k in n}
        assert sizes(sampling.stratified_star_split(strata(spark, n_pos, n_neg), "1")) == {k: x for k, x in want.items() if x}
    assert sizes(sampling.stratified_star_split(strata(spark, 10, 10), "1")) == {("test", 1): 2, ("test", 0): 1, ("val", 1): 1, ("val", 0): 2, ("train", 1): 7, ("train", 0): 7}
    assert sizes(sampling.stratified_star_split(strata(spark, 1, 19), "1"))["train", 1] == 1
    assert sampling.stratified_star_split(strata(spark, 0, 0), "1").count() == 0


def test_small_split_has_positives_everywhere(spark):
    for n_pos, n_neg in ((3, 2), (3, 60), (4, 1), (5, 0)):
        got = sizes(sampling.small_split(strata(spark, n_pos, n_neg), "2"))
        assert min(got[s, 1] for s in ("train", "val", "test")) >= 1 and sum(got.values()) == n_pos + n_neg
        n_test = math.ceil(0.15 * (n_pos + n_neg))
        assert got["test", 1] + got.get(("test", 0), 0) == n_test and got["val", 1] + got.get(("val", 0), 0) == math.ceil(0.15 * (n_pos + n_neg - n_test))
    with pytest.raises(Exception, match="too few to split"):
        sampling.small_split(strata(spark, 2, 2), "2").collect()


def test_catalog_columns_under_other_names(spark, tmp_path):
    """Names that differ in case only are two columns; a row's id is the first whole number, then the first text."""
    path = tmp_path / "catalog.csv"
    path.write_text('\ufeff# a note\nKIC,kic,EPIC,"TIC ID",tic,toi,pl_orbper,Hostname\n1.0,2,,,,,3.5,h\n,2,,,,,,h\nx,7.0,,,,,,\n,,5,,,,,\n,,,nan,9,,,\n,,,,,101.01,,\n,,,,,,,"Host, b"\n'.replace("\ufeff# a note\n", "# a note\n\ufeff"))
    df = catalogs.read_catalog(spark, str(path))
    rows = {r.target: r for r in ids.target_and_mission(df).collect()}
    assert {t: r.target_mission for t, r in rows.items()} == {"KIC 1": "Kepler", "KIC 2": "Kepler", "KIC 7": "Kepler", "EPIC 5": "K2", "TIC 9": "TESS", "TOI 101.01": "TESS", "Host, b": None}
    assert rows["KIC 1"].pl_orbper == 3.5 and rows["KIC 1"].hostname == "h" and [f.name for f in df.schema] == CATALOG.fieldNames()
    only = spark.createDataFrame([("x", "y", "8")], "a string, b string, c string").toDF("kic", "KIC", "kepid")
    assert ids.target_and_mission(only).first()["target"] == "KIC 8" and ids.target_and_mission(spark.createDataFrame([("k",)], "other string")).first()["target"] is None
    (tmp_path / "empty.csv").write_text("")
    assert catalogs.read_catalog(spark, str(tmp_path / "empty.csv")).count() == 0


def test_score_rows_over_batches_are_those_of_all_windows(spark, tmp_path):
    """All sixteen fields after three batches and after merging them: equal, but that quantiles are values at a rank."""
    rng = random.Random(8)
    rows = [(f"s{k % 4}", m, 4 * i, rng.choice([0.1, 0.9, rng.random()]), float(i), i + 0.5) for k in range(4) for m in ("k2", "tess")[: 1 + k % 2] for i in range(5 + 40 * k)]
    df = spark.createDataFrame(rows, "star_id string, mission string, start long, p double, t_first double, t_last double")
    curves = spark.createDataFrame([(f"s{k}", m, 4 * (5 + 40 * k) + 12) for k in range(4) for m in ("k2", "tess")[: 1 + k % 2]] + [("short", "k2", 3), ("gone", "k2", 99), ("bad", "k2", None)], "star_id string, mission string, n_points long")
    errors = spark.createDataFrame([("bad", "k2", "cannot be read")], "star_id string, mission string, error string")
    for k in range(3):
        df.where(F.col("start") / 4 % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    star_scores.stream_star_scores(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "log"), 1).awaitTermination()
    star_scores.compact(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    want = {(r.star_id, r.mission): r.asDict() for r in scores.score_rows(curves, df, 16, 4, errors).collect()}
    assert len(want) == 9 and all(len(r) == 16 for r in want.values()) and {r["status"] for r in want.values()} == {"ok", "too_short_or_missing", "no_segments", "error"}
    for sink in ("out", "one"):
        got = {(r.star_id, r.mission): r.asDict() for r in star_scores.score_rows_so_far(spark, str(tmp_path / sink), curves, 16, 4, errors).collect()}
        assert got.keys() == want.keys()
        for key, r in got.items():
            p = sorted(x[3] for x in rows if x[:2] == key)
            for name, value in r.items():
                if p and name in ("median_seg_score", "p95_seg_score"):
                    q = 0.5 if name[0] == "m" else 0.95
                    between = want[key][name] - 1e-12, want[key][name] + 1e-12
                    assert value == p[math.ceil(q * len(p)) - 1] and np.searchsorted(p, between[0]) - 1 <= q * len(p) <= np.searchsorted(p, between[1], "right") + 1
                else:
                    assert value == pytest.approx(want[key][name], abs=1e-9) if isinstance(value, float) else value == want[key][name]


def test_sketches_keep_ranks(spark):
    """Stored by parts and merged, a million values have ranks within 0.001."""
    rows = spark.range(1_000_000).select((F.col("id") % 5).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    parts = rows.groupBy("g").agg(ranks.quantile_sketch(F.col("v")).alias("s"))
    merged = parts.agg(ranks.merge_sketches("s").alias("s"))
    at = {f"q{int(1000 * q)}": q for q in (0.001, 0.25, 0.5, 0.95, 0.999)}
    got = merged.select(*(ranks.sketch_quantile(F.col("s"), q).alias(n) for n, q in at.items())).first()
    below = rows.agg(*(F.avg((F.col("v") <= got[n]).cast("double")).alias(n) for n in at)).first()
    assert all(abs(below[n] - q) < 1e-3 for n, q in at.items())
    assert ranks.approximate_quantiles(rows.where("v < 0"), "v", {"x": 0.5}).first()["x"] is None


def test_few_hard_negatives_leave_their_places_to_others(spark):
    """Ten negatives are wanted, half of them hard, and there are two hard ones: eight others come in."""
    df = spark.createDataFrame([(f"s{i:02}", 0, i / 40, int(i % 4 == 0)) for i in range(40)], "star_id string, start long, p double, label int")
    hard = scores.nlargest(df.where("label = 0"), 2)
    rows = sampling.balanced_train_set(df, hard, "b", 1, 0.5).collect()
    assert len({r.star_id for r in rows}) == len(rows) == 20 and sum(r.label for r in rows) == 10
    assert {r.star_id for r in hard.collect()} <= {r.star_id for r in rows}


def test_text_of_scores_is_rounded_by_the_stored_value(spark):
    """0.5503125 lies below the half and 0.0453125 on it; Java's digits would round both up."""
    rng = random.Random(9)
    values = [0.5503125, 0.0690625, 0.0453125, 0.0078125, 2.5, 1e-9, 0.0, -0.5503125, -3.25, 0.9999996, 12345.9999999, 2455197.5503125, 1e12, *(rng.uniform(0, 400) for _ in range(500)), *(rng.randrange(10**9) / 10**7 for _ in range(2000)), *((2 * rng.randrange(2**20) + 1) / 2**7 for _ in range(100))]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (4, 6):
        got = df.select("x", scores.decimal_text(F.col("x"), digits).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.x:.{digits}f}" for r in got]
    star = spark.createDataFrame([("a", 0, 0.5, 0.5503125)], "star_id string, start long, p double, seg_mid_time double")
    assert scores.top_strings(star).first().top_times == "0.550312"


def test_forests_of_many_curves_are_those_grown_one_by_one():
    """Equal values, columns and rows, missing values, one row, and counts that are no power of two."""
    rng = np.random.default_rng(4)
    for n, d, kinds in ((1, 3, 5), (2, 16, 3), (13, 16, 1000), (13, 16, 3), (29, 5, 4), (64, 7, 50)):
        x = rng.integers(0, kinds, (6, n, d)).astype(float)
        x[0] = 1.0
        x[1, n // 2, 0] = np.nan
        limit = int(np.ceil(np.log2(max(2, n))))
        for one, scored in zip(x, embeddings._score_together(x, 25), strict=True):
            forest = [[n, embeddings._grow(one, np.random.default_rng(t), 0, limit)] for t in range(25)]
            assert np.array_equal(embeddings._score(one, forest), scored)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_are_scored_without_copies_of_points(spark):
    """The only rows made are the windows themselves: before, each point was copied for every window that holds it."""
    from lumiset.plans import fixtures

    assert plan_of(fixtures.scored(spark, "/root/testdata/sf0.001")).count("Generate explode") == 1


def test_gallery_computes_its_rows_once(spark):
    df = spark.createDataFrame([("a", 0, 0.5, 1), ("b", 0, 0.7, 0)], "star_id string, start long, p double, label int")
    gallery = scores.gallery_rows(df.repartition(3).withColumn("star_id", F.md5("star_id")), 1)
    assert "md5" not in plan_of(gallery) and "Repartition" not in plan_of(gallery) and gallery.count() == 3


def test_median_and_deviation_deal_rows_once(spark):
    df = spark.createDataFrame([("a", "k2", i, float(x)) for i, x in enumerate((5, 1, 4, 9, 2))] + [(None, "k2", 0, 1.0)], "star_id string, mission string, idx long, flux double")
    out = signals.mad_normalize(df, ["star_id", "mission"])
    assert "Join" not in plan_of(out) and {r.idx: round(r.norm, 3) for r in out.collect()} == {0: 0.5, 1: -1.5, 2: 0.0, 3: 2.5, 4: -1.0}
    dips = embeddings.dip_score(df.withColumn("start", F.lit(0)))
    assert "Join" not in plan_of(dips) and [round(r.p, 3) for r in dips.collect()] == [0.6]


def test_chunks_read_their_own_part_of_a_table(spark):
    """All rows of a chunk's targets and no others come back, and the read is bounded by the chunk's digests."""
    rows = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 40).alias("star_id"), "id")
    table = score_log.by_digest(rows)
    chunk = spark.createDataFrame([("s3",), ("s17",), ("none",)], "star_id string")
    part = score_log.of_chunk(table, chunk)
    assert sorted(r.id for r in part.collect()) == [i for i in range(400) if i % 40 in (3, 17)] and part.columns == ["star_id", "id"]
    assert "PushedFilters: [IsNotNull(_digest), GreaterThanOrEqual(_digest" in part._jdf.queryExecution().executedPlan().toString()


def test_means_at_the_limit_do_not_depend_on_the_order_of_rows(spark):
    """Both curves' values are 640.00 in all; added in order, one has a mean of 40 and the other one just below, and backwards the other way round."""
    curves = {
        "a": [74.42, 56.75, 21.83, 11.99, 28.64, 20.76, 61.26, 14.46, 25.9, 35.02, 95.49, 28.1, 13.24, 56.39, 38.53, 57.22],
        "b": [5.77, 75.21, 57.72, 11.78, 27.36, 23.88, 42.18, 62.18, 3.94, 1.15, 72.26, 22.68, 57.47, 0.08, 23.58, 152.76],
    }
    rows = [(star, "k2", 0, k, x) for star, values in curves.items() for k, x in enumerate(values)] + [("c", "k2", 0, k, None) for k in range(16)] + [("d", "k2", 0, 0, None), ("d", "k2", 0, 1, -41.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "star_id string, mission string, start long, idx long, flux double").coalesce(1)
        got = {r.star_id: r.mean_abs for r in windows.filter_segments(df, least_abs=40.0).collect()}
        assert got == {"a": 40.0, "d": 41.0}


def test_rounding_is_that_of_sql(spark):
    """0.695978499 + 1e-9 is 0.6959784999999999 by its digits and gives 695978.5 when scaled."""
    rng = random.Random(4)
    values = [0.695978499, 0.0, -0.5, 2.5e-7, 1e17, 1.7e308, -1e305, math.inf, math.nan, *((1000 * rng.randrange(10**6) + 499) / 1e9 for _ in range(500)), *((2 * rng.randrange(10**7) + 1) / 2e9 * rng.choice((1, -1)) for _ in range(500))]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = zip([r[0] for r in df.select(fixtures.rounded(F.col("x"), 9)).collect()], [r.x for r in fixtures.tidy(df).collect()], strict=True)
    expected = duckdb.execute("SELECT round(x, 9), round(x + 1e-9, 6) + 0e0 FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
    assert [repr(r) for r in got] == [repr(r) for r in expected]


def test_score_log_goes_on_after_a_failure(spark, tmp_path):
    """The second chunk fails; the next run keeps the first and scores each other star once."""
    log, schema = str(tmp_path / "log"), "star_id string, best double"
    stars = spark.createDataFrame([(f"s{i:02}",) for i in range(23)] + [("s01",), (None,)], "star_id string")
    calls = []

    def score(fails):
        def run(chunk):
            names = [r.star_id for r in chunk.collect()]
            calls.append(names)
            if fails and len(calls) == 2:
                raise RuntimeError("stopped")
            return chunk.select("star_id", F.lit(1.0).alias("best"))

        return run

    with pytest.raises(RuntimeError, match="stopped"):
        score_log.score_and_append(stars, log, score(True), schema, save_every=5)
    assert len(score_log.committed(spark, log)) == 1 and score_log.scores_so_far(spark, log, schema).count() == 5
    (tmp_path / "log" / "chunks" / "unfinished").mkdir()
    first, calls[:] = calls[0], []
    out = score_log.score_and_append(stars, log, score(False), schema, save_every=5)
    assert sorted(len(c) for c in calls) == [3, 5, 5, 5] and not {x for c in calls for x in c} & set(first)
    assert sorted(r.star_id for r in out.collect()) == [f"s{i:02}" for i in range(23)] and not (tmp_path / "log" / "chunks" / "unfinished").exists()
    calls[:] = []
    assert score_log.score_and_append(stars, log, score(False), schema, save_every=5).count() == 23 and not calls
    assert score_log.score_and_append(stars.limit(2), log, score(False), schema, resume=False).count() == 2
    assert score_log.scores_so_far(spark, str(tmp_path / "none"), schema).count() == 0


def test_clustered_tables_join_without_exchange(spark):
    """Windows and labels of one mission: its partition only, and no rows are dealt anew by star."""
    points, ephemeris = two_missions(spark)
    segments = windows.make_segments(points.groupBy("star_id", "mission").agg(F.count("*").alias("n_points")), 16, 16)
    p, e, s = layout.clustered(points, "points", buckets=3), layout.clustered(ephemeris, "ephemeris", (), buckets=3), layout.clustered(segments, "segments", ("start",), buckets=3)
    here = F.col("mission") == "k2"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = windows.window_points(p.where(here), s.where(here), 16, 16)
        labels = windows.label_by_count(s.where(here), windows.in_transit_any(p.where(here), e.where(here)), 1)
        for df, n in ((cut, 32), (labels, 2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "PartitionFilters" in plan and "k2" in plan
            assert df.count() == n
        assert {(r.start, r.label) for r in labels.collect()} == {(0, 1), (16, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4()}", "w").close()
        return lambda x: x.max(1)

    rows = spark.range(600).select("id", F.array(*(F.col("id") % k * 1.0 for k in (3, 5, 7))).alias("values")).repartition(12)
    got = {r.id: r.score for r in embeddings.score_windows_loaded(rows, load, 3, batch=16).collect()}
    assert got == {i: float(max(i % 3, i % 5, i % 7)) for i in range(600)}
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) >= 1
    with pytest.raises(Exception, match="scores for"):
        embeddings.score_windows_loaded(rows, lambda: lambda x: x.max(1)[1:], 3).collect()


def test_boosted_models_on_held_out_rows(spark):
    rng = random.Random(3)
    points = [(f"s{i:02}", 0, j, rng.gauss(0, 1) - 6 * (i % 2) * (j == 5)) for i in range(60) for j in range(12)]
    features = embeddings.window_features(spark.createDataFrame(points, "star_id string, start int, idx int, flux double")).withColumn("label", F.substring("star_id", 2, 2).cast("int") % 2).withColumn("weight", F.lit(1.0))
    scored = embeddings.boosted_window_classifier(features, sampling.stratified_star_split(features, "1"), "weight", rounds=5)
    held = scored.where("split = 'test'")
    assert held.count() == 9 and scores.roc_auc(held, "score").first()[0] > 0.9 and scored.count() == 60
    x, y, df = vectors(spark, 500)
    smooth = embeddings.boosted_smooth_scores(df.withColumn("score", F.when(F.col("vec_id") != 9, F.col("score"))), "score", "vec_id", rounds=15)
    test = smooth.where("split = 'test'")
    assert test.count() == 100 and smooth.where("smooth is null").count() == 0 and scores.r_squared(test.where("vec_id != 7"), "score", "smooth").first()[0] > 0.7


def test_folds_and_extracts_of_two_missions(spark):
    points, ephemeris = two_missions(spark)
    both = ephemeris.unionByName(ephemeris.withColumn("mission", F.lit("tess")).withColumn("period_days", F.lit(1.6)))
    folded = triage.phase_fold(points, both)
    assert folded.count() == 64 and {(r.mission, r.period_days) for r in folded.collect()} == {("k2", 1.0), ("tess", 1.6)}
    assert triage.phase_fold(points, both, 4).groupBy("mission").count().count() == 2
    late = points.withColumn("flux", F.when(F.col("mission") == "tess", F.col("flux") + 1000).otherwise(F.col("flux")))
    curves = points.groupBy("star_id", "mission").agg(F.count("*").alias("n_points"))
    summary = scores.score_summary(curves, embeddings.dip_score(windows.window_points(points, windows.make_segments(curves, 16, 16), 16, 16)), 16)
    assert summary.count() == 2
    rows = triage.vetting_extract(late, summary, 16, 16).collect()
    assert {(r.mission, r.panel) for r in rows} == {(m, p) for m in ("k2", "tess") for p in ("curve", "best")} and all(abs(r.residual) < 10 for r in rows)


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice([rng.random(), 0.5, -1.0])) for _ in range(999)] + [("a", None), ("c", 7.0)]
    df = spark.createDataFrame(data, "g string, v double")
    for q in (0.0, 0.31, 0.5, 0.99, 1.0):
        assert ranks.exact_quantiles(df, "v", {"x": q}).first()["x"] == pytest.approx(np.quantile([v for _, v in data if v is not None], q))
        by = {r.g: r.x for r in ranks.exact_quantiles(df, "v", {"x": q}, "g").collect()}
        assert by == pytest.approx({k: np.quantile([v for g, v in data if g == k and v is not None], q) for k in "abc"})
    assert ranks.exact_quantiles(df.where("v > 9"), "v", {"x": 0.5}).first()["x"] is None


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([("a", 0, 0.4, 0), ("b", 0, 0.6, 0)], "star_id string, start int, p double, label int")
    assert scores.average_precision(df).first()[0] is None and scores.average_precision(df.where("p > 1")).first()[0] is None
    assert scores.youden_threshold(df).first()["youden"] is None
    report = {(r.level, r.metric): r.value for r in scores.eval_report(df.withColumn("split", F.lit("val"))).collect()}
    assert report["window", "roc_auc"] is None and report["window", "n"] == 2 and report["star_max", "base_rate"] == 0
    assert scores.eval_report(df.withColumn("split", F.lit("val")).where("p > 1")).count() == 0


def test_segment_outside_its_curve_is_an_error(spark):
    curves = spark.createDataFrame([("a", "k2", 10)], "star_id string, mission string, n_points long")
    rows = spark.createDataFrame([("a", "k2", 0, 8), ("a", "k2", 2, 10)], 'star_id string, mission string, start long, end long')
    assert windows.slice_strict(rows, curves).count() == 2
    for bad in (("a", "k2", 4, 12), ("a", "k2", -1, 7), ("b", "k2", 0, 8)):
        with pytest.raises(Exception, match="not inside the curve"):
            windows.slice_strict(rows.union(spark.createDataFrame([bad], rows.schema)), curves).collect()


def test_stream_adds_up_a_star_over_batches(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 3}", i, i / 100) for i in range(30)], "star_id string, start int, p double")
    for k in range(3):
        rows.where(F.col("start") % 3 == k).union(rows.where(F.col("start") == 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows.where("start < 9").select(F.lit("s0").alias("star_id"), "start", "p").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        star_scores.stream_star_scores(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "log"), 1).awaitTermination()
    got = {r.star_id: (r.n_segments, r.best, round(r["mean"], 9)) for r in star_scores.star_scores_so_far(spark, str(tmp_path / "out")).collect()}
    assert got == {"s0": (19, 0.27, round((sum(range(0, 30, 3)) + 36) / 1900, 9)), "s1": (10, 0.28, 0.145), "s2": (10, 0.29, 0.155)}


def vectors(spark, n=200, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    x[7] = 12
    y = x @ np.arange(1, 7) + 2
    return x, y, spark.createDataFrame([(i, v.tolist(), float(s)) for i, (v, s) in enumerate(zip(x, y, strict=True))], "vec_id long, embedding array<double>, score double")


def test_components_and_regression_of_embeddings(spark):
    x, y, df = vectors(spark)
    got = np.array([r.pc for r in embeddings.pca(df, 2).orderBy("vec_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs((u * s)[:, :2]), abs=1e-6)
    smooth = embeddings.smooth_scores(df, "score")
    assert scores.r_squared(smooth, "score", "smooth").first()[0] > 0.999
    cut = np.quantile([r.smooth for r in smooth.collect()], 0.99)
    assert {r.vec_id for r in embeddings.above_cut(smooth, "smooth").collect()} == {r.vec_id for r in smooth.collect() if r.smooth >= cut}


def test_classifiers_on_held_out_rows(spark):
    x, y, df = vectors(spark, 600)
    rows = embeddings.binary_embedding_classifier(df.withColumn("label", (F.col("score") > 2).cast("int")), "vec_id").collect()
    shares = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    assert len(rows) == 600 and abs(shares["val"] - 90) <= 1 and abs(shares["test"] - 90) <= 1
    test = [r for r in rows if r.split == "test"]
    assert np.mean([(r.probability >= 0.5) == r.label for r in test]) > 0.9 and all(0 <= r.probability <= 1 for r in rows)
    rng = random.Random(3)
    points = [(f"s{i}", 0, j, rng.gauss(0, 1) - 6 * (i % 2) * (j == 5)) for i in range(80) for j in range(12)]
    features = embeddings.window_features(spark.createDataFrame(points, "star_id string, start int, idx int, flux double")).withColumn("label", F.substring("star_id", 2, 3).cast("int") % 2)
    trained = embeddings.train_window_classifier(features.where("star_id < 's5'"))
    held = trained(features.where("star_id >= 's5'")).collect()
    assert np.mean([(r.score >= 0.5) == r.label for r in held]) > 0.9


def test_isolated_rows_score_highest(spark):
    _, _, df = vectors(spark)
    rows = embeddings.anomaly_scores(df, "vec_id", dims=4).collect()
    assert max(rows, key=lambda r: r.outlier_score).vec_id == 7 and all(0 < r.outlier_score < 1 for r in rows)
    assert {r.vec_id for r in rows if r.flag} >= {7} and sum(r.flag for r in rows) == 2
    best = embeddings.weird_stars(df.withColumn("smooth", F.col("score")), "vec_id", best=50, n=5).collect()
    top = {r.vec_id for r in df.orderBy(F.desc("score")).limit(50).collect()}
    assert len(best) == 5 and {r.vec_id for r in best} <= top and [r.outlier_score for r in best] == sorted((r.outlier_score for r in best), reverse=True)


@pytest.mark.parametrize("fit_on_self", [False, True])
def test_anomalies_of_curves(spark, fit_on_self):
    rng = random.Random(6)
    points = [(f"s{s}", "k2", i, i * 0.1, rng.gauss(0, 0.1) + (9 if s == 1 and 80 <= i < 88 else 0)) for s in range(3) for i in range(160)]
    df = spark.createDataFrame(points, "star_id string, mission string, idx long, time double, flux double")
    rows = embeddings.star_anomalies(df, 8, 8, fit_on_self=fit_on_self, part=4).collect()
    assert len(rows) == 60 and max(rows, key=lambda r: r.outlier_score)[0:1] == ("s1",) and max(rows, key=lambda r: r.outlier_score).start == 80
    halves = lambda p, w, s: embeddings.plain_segments(p, w, s).where("start < 80")
    assert embeddings.star_anomalies(df, 8, 8, halves, fit_on_self).count() == 30


def test_score_of_a_star_is_that_of_its_best_windows(spark):
    points, _ = two_missions(spark)
    rows = embeddings.score_stars(points, 8, 8, 2).collect()
    assert len(rows) == 4 and all(r.score == pytest.approx(np.mean([x.p for x in rows if x.mission == r.mission])) for r in rows)


def test_no_period_from_few_windows(spark):
    df = spark.createDataFrame([("a", i, 0.9, float(i)) for i in range(2)], "star_id string, start int, p double, seg_mid_time double")
    assert triage.estimate_period(df, 0.8).count() == 0
    many = spark.createDataFrame([("a", i, 0.9, 2.5 * i) for i in range(12)], "star_id string, start int, p double, seg_mid_time double")
    assert triage.estimate_period(many, 0.8).first()["period_days"] == pytest.approx(2.5, abs=0.1)


def test_sink_refuses_other_suffixes(spark, tmp_path):
    df = spark.range(3)
    catalogs.write_table(df, str(tmp_path / "a.csv"))
    assert sorted(r.id for r in spark.read.option("header", True).csv(str(tmp_path / "a.csv")).collect()) == ["0", "1", "2"]
    catalogs.write_table(df, str(tmp_path / "a.parquet"))
    assert spark.read.parquet(str(tmp_path / "a.parquet")).count() == 3
    with pytest.raises(ValueError, match="csv"):
        catalogs.write_table(df, str(tmp_path / "a.txt"))


def test_spark_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_positions_take_no_window_over_all_rows(spark):
    from lumiset.plans import queries

    plan = queries.QUERIES["j5_positional_split"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan
