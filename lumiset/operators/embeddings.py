"""Star embeddings, window scoring by models, and outlier search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import checkpointed
from .ranks import digest_ranks, exact_quantiles
from .sampling import row_split
from .scores import ranked
from .signals import mad_normalize
from .windows import make_segments, star_key, window_key
from .windows import window_points as cut_points


def finite_vector(c: str) -> Column:
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def norm(c: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pool_embeddings(windows: DataFrame, k: int = 5) -> DataFrame:
    """Unit mean of a star's vectors of its best ``k`` windows that are finite; a star without one has a reason instead."""
    w = Window.partitionBy("star_id").orderBy(F.desc("p"), "start")
    top = windows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).withColumn("_ok", finite_vector("vec"))
    parts = top.where("_ok").select("star_id", F.posexplode("vec").alias("i", "x")).groupBy("star_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy("star_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    rows = top.select("star_id").distinct().join(mean, "star_id", "left").withColumn("_n", norm("mean"))
    good = F.col("mean").isNotNull() & (F.col("_n") > 0)
    reason = F.when(F.col("mean").isNull(), "all segments non-finite").when(~(F.col("_n") > 0), "bad norm")
    return rows.select("star_id", F.when(good, F.expr("transform(mean, x -> x / _n)")).alias("vec"), reason.alias("reason"))


def quarantine(pooled: DataFrame) -> DataFrame:
    return pooled.where("reason is not null").select("star_id", "reason")


def embedding_health(df: DataFrame, vec: str = "embedding") -> DataFrame:
    bad = lambda f: F.aggregate(vec, F.lit(0), lambda s, x: s + F.when(f(x), 1).otherwise(0))
    rows = df.select(F.size(vec).alias("d"), bad(F.isnan).alias("nan"), bad(lambda x: F.abs(x) == F.lit(float("inf"))).alias("inf"), F.array_max(F.transform(vec, F.abs)).alias("m"), norm(vec).alias("n"))
    return rows.agg(F.max("d").alias("dim"), F.sum("nan").alias("n_nan"), F.sum("inf").alias("n_inf"), F.max("m").alias("max_abs"), F.sum(F.when(F.col("nan") + F.col("inf") > 0, 1).otherwise(0)).alias("bad_rows"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"), F.min("n").alias("norm_min"), F.max("n").alias("norm_max"))


def nearest_to(df: DataFrame, query: DataFrame, k: int, key: str, vec: str) -> DataFrame:
    """The ``k`` rows nearest by cosine to a one-row ``query`` (key, vec), which is one vector and so broadcast."""
    q = query.limit(1).select(F.col(key).alias("_qk"), F.col(vec).alias("_q"))
    rows = df.crossJoin(F.broadcast(q)).where(F.col(key) != F.col("_qk"))
    d = 1 - dot(vec, "_q") / (norm(vec) * norm("_q"))
    return rows.select(key, F.round(d, 9).alias("distance")).orderBy("distance", key).limit(k)


def score_windows(windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], value: str = "values") -> DataFrame:
    """``score`` for each window by a user's model: ``predict`` takes a (batch, points) array and returns one number a row."""
    schema = T.StructType([*windows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf[value].tolist(), np.float64)
            yield pdf.assign(score=np.asarray(predict(x), np.float64) if len(pdf) else np.zeros(0))

    return windows.mapInPandas(run, schema)


def score_windows_loaded(windows: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], points: int, value: str = "values", batch: int = 1024) -> DataFrame:
    """``score`` for each window by a model that ``load`` builds once in each Python worker, not once a task or batch.

    ``load`` takes nothing and returns a function from a (rows, ``points``) array to one number a row; another count of numbers is
    an error. So a model file is read where it is needed and never travels with the plan. All windows have ``points`` values.
    """

    def made():
        model = load()

        def predict(x: np.ndarray) -> np.ndarray:
            out = np.asarray(model(x), np.float64).reshape(-1)
            if len(out) != len(x):
                raise ValueError(f"the model gave {len(out)} scores for {len(x)} windows")
            return out

        return predict

    score = predict_batch_udf(made, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[points]])
    return windows.withColumn("score", score(F.col(value)))


def pack_windows(windows: DataFrame, value: str = "flux") -> DataFrame:
    """(star_id, mission, start, end, values): one array a window, in order."""
    return windows.groupBy("star_id", "mission", "start", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", value))), lambda s: s[value]).alias("values"))


def dip_score(windows: DataFrame, value: str = "flux") -> DataFrame:
    """Depth of a window's minimum in robust deviations below its median, as x / (1 + x): a scorer that needs no model."""
    key = window_key(windows)
    each = windows.dropna(subset=key).groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    each = each.withColumn("_med", middle("_v")).withColumn("_dev", F.sort_array(F.transform("_v", lambda v: F.abs(v - F.col("_med")))))
    x = (F.col("_med") - F.get("_v", F.lit(0))) / (middle("_dev") + 1e-6)
    return each.select(*key, (x / (1 + x)).alias("p"))


def middle(values: str) -> Column:
    """Median of a sorted array; null of an empty one."""
    n = F.size(values)
    lo, hi = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.when(lo == hi, lo).otherwise(lo * 0.5 + hi * 0.5)


def score_stars(points: DataFrame, window: int, stride: int, k: int = 5, scorer: Callable[[DataFrame], DataFrame] = dip_score) -> DataFrame:
    """The best ``k`` windows of each normalised curve with their scores and the mean of them, ``score``, which is the star's."""
    flat = mad_normalize(points, star_key(points)).drop("flux").withColumnRenamed("norm", "flux")
    curves = points.groupBy(*star_key(points)).agg(F.count("*").alias("n_points"))
    top = ranked(scorer(cut_points(flat, make_segments(curves, window, stride), window, stride)), star_key(points)).where(F.col("_rank") <= k).drop("_rank")
    return top.withColumn("score", F.avg("p").over(Window.partitionBy(*star_key(points))))


def window_features(windows: DataFrame, value: str = "flux") -> DataFrame:
    w = windows.groupBy(*window_key(windows)).agg(F.avg(value).alias("f_mean"), F.stddev_pop(value).alias("f_std"), F.min(value).alias("f_min"), F.max(value).alias("f_max"), F.percentile(value, F.lit(0.05)).alias("f_q05"), F.percentile(value, F.lit(0.5)).alias("f_med"))
    return w


FEATURES = ["f_mean", "f_std", "f_min", "f_max", "f_q05", "f_med"]


def train_window_classifier(features: DataFrame, weight: str | None = None):
    """A logistic model over window statistics, with row weights; returns the fitted pipeline parts as one function."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_v", handleInvalid="skip")
    model = LogisticRegression(featuresCol="_v", labelCol="label", maxIter=30, **({"weightCol": weight} if weight else {})).fit(assembler.transform(features))
    return lambda df: model.transform(assembler.transform(df)).withColumn("score", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def boosted_window_classifier(features: DataFrame, split: DataFrame, weight: str | None = None, rounds: int = 20, depth: int = 4) -> DataFrame:
    """``features`` with their star's ``split`` and ``score``, the probability of label 1, by boosted trees.

    Trees grow on the windows of the training stars, with row weights, until those of the validation stars get no better; the
    test stars' windows are scored only. Windows of stars in no split are left out.
    """
    rows = checkpointed(features.join(split.select("star_id", "split"), "star_id"))
    parts = VectorAssembler(inputCols=FEATURES, outputCol="_v", handleInvalid="skip").transform(rows).withColumn("_val", F.col("split") == "val")
    known = checkpointed(parts.where("split != 'test'"))
    more = {"weightCol": weight} if weight else {}
    if not known.where("_val").isEmpty():
        more["validationIndicatorCol"] = "_val"
    model = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7, **more).fit(known)
    return model.transform(parts).withColumn("score", vector_to_array("probability")[1]).drop("_v", "_val", "rawPrediction", "probability", "prediction")


def pca(df: DataFrame, k: int, vec: str = "embedding") -> DataFrame:
    """``pc``: the first ``k`` principal components of centred vectors."""
    v = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    v = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    return PCA(k=k, inputCol="_c", outputCol="_p").fit(v).transform(v).withColumn("pc", vector_to_array("_p")).drop("_v", "_c", "_p")


def smooth_scores(df: DataFrame, score: str, vec: str = "embedding") -> DataFrame:
    """``smooth``: scores regressed on the embedding."""
    v = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return LinearRegression(featuresCol="_v", labelCol=score, predictionCol="smooth", regParam=1e-3).fit(v).transform(v).drop("_v")


def boosted_smooth_scores(df: DataFrame, score: str, key: str, vec: str = "embedding", held_out: float = 0.2, seed: str = "42", rounds: int = 20, depth: int = 4) -> DataFrame:
    """``smooth``: scores regressed on the embedding by boosted trees, and ``split``: a share by digest is held out of the fit ("test").

    So what the smoothed scores explain is measured on rows that the trees have not seen. Rows without a score are smoothed too.
    """
    ranked = digest_ranks(df.withColumn("_g", F.lit(1)), ["_g"], F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), [key])
    rows = checkpointed(ranked.withColumn("split", F.when(F.col("_r") <= F.ceil(F.col("_n") * held_out), "test").otherwise("train")).drop("_g", "_r", "_n"))
    v = rows.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    fit = GBTRegressor(featuresCol="_v", labelCol=score, predictionCol="smooth", maxIter=rounds, maxDepth=depth, seed=7)
    return fit.fit(v.where((F.col("split") == "train") & F.col(score).isNotNull())).transform(v).drop("_v")


def above_cut(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """The rows at the column's quantile ``q`` or above."""
    cut = exact_quantiles(df, column, {"_cut": q})
    return df.crossJoin(F.broadcast(cut)).where(F.col(column) >= F.col("_cut")).drop("_cut")


def binary_embedding_classifier(df: DataFrame, key: str, vec: str = "embedding", hidden: int = 16, seed: str = "7", dims: int | None = None) -> DataFrame:
    """``split`` (70/15/15 of each label by digest) and ``probability`` that the label is 1, by a small perceptron fitted on train.

    All vectors have ``dims`` components, or as many as the first one.
    """
    rows = checkpointed(row_split(df, seed, (0.7, 0.15, 0.15), key).withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double")))))
    dims = dims or len(rows.select(vec).first()[0])
    model = MultilayerPerceptronClassifier(layers=[dims, hidden, 2], featuresCol="_v", labelCol="label", seed=7, maxIter=40).fit(rows.where("split = 'train'"))
    return model.transform(rows).withColumn("probability", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "prediction")


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> list:
    """An isolation tree as nested [feature, cut, left, right] or [size]."""
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth >= limit or not len(spread):
        return [len(x)]
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return [f, cut, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)]


def _expected(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _depths(x: np.ndarray, tree: list) -> np.ndarray:
    out = np.zeros(len(x))
    stack = [(tree, np.arange(len(x)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        if len(node) == 1:
            out[rows] = depth + _expected(node[0])
            continue
        left = x[rows, node[0]] < node[1]
        stack += [(node[2], rows[left], depth + 1), (node[3], rows[~left], depth + 1)]
    return out


def _score(x: np.ndarray, forest: list) -> np.ndarray:
    return 2.0 ** -np.mean([_depths(x, t) / max(float(_expected(n)), 1e-9) for n, t in forest], axis=0) if len(x) else np.zeros(0)


def _words(trees: int, n: int) -> np.ndarray:
    """The first ``n`` random words of each tree's generator, that of ``_grow`` over ``default_rng(tree)``."""
    return np.array([np.random.default_rng(t).bit_generator.random_raw(n) for t in range(trees)], np.uint64).reshape(trees, n)


def _score_together(x: np.ndarray, trees: int) -> np.ndarray:
    """``_score`` of the rows of many curves, each by a forest grown on all its own rows: (curves, rows, values) to (curves, rows).

    The trees are those of ``_grow``, draw by draw: all trees of all curves take their next node together, from left to right. A
    node is named by the number of rows to the left of it. A choice of one in ``k`` takes half a random word, a cut a whole one.
    """
    curves, n, d = x.shape
    limit, lanes, low = int(np.ceil(np.log2(max(2, n)))), curves * trees, np.uint64(0xFFFFFFFF)
    words = _words(trees, 3 * n + 16)
    curve, tree = np.repeat(np.arange(curves), trees), np.tile(np.arange(trees), curves)
    node, out = np.zeros((lanes, n), np.int64), np.zeros((lanes, n))
    depth, at = np.zeros((lanes, n + 1), np.int64), np.zeros(lanes, np.int64)
    used, half, has_half = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint64), np.zeros(lanes, bool)

    def next_half(who: np.ndarray) -> np.ndarray:
        fresh = who[~has_half[who]]
        word, kept = words[tree[fresh], used[fresh]], half[who]
        used[fresh] += 1
        half[fresh] = word >> np.uint64(32)
        value = np.where(has_half[who], kept, 0).astype(np.uint64)
        value[~has_half[who]] = word & low
        has_half[who] = ~has_half[who]
        return value

    active = np.arange(lanes)
    while len(active):
        if used.max() + n + 8 > words.shape[1]:
            words = _words(trees, 2 * words.shape[1])
        own = node[active] == at[active, None]
        count, here = own.sum(1), depth[active, at[active]]
        rows = x[curve[active]]
        lo = np.where(own[:, :, None], rows, np.inf).min(1)
        hi = np.where(own[:, :, None], rows, -np.inf).max(1)
        spread = hi > lo
        k = spread.sum(1)
        split = (count > 1) & (here < limit) & (k > 0)
        leaf = ~split
        out[active[leaf]] += own[leaf] * (here[leaf] + _expected(count[leaf]))[:, None]
        at[active[leaf]] += count[leaf]
        who, ks = active[split], k[split].astype(np.uint64)
        if len(who):
            pick, todo = np.zeros(len(who), np.uint64), np.flatnonzero(ks > 1)
            while len(todo):
                product = next_half(who[todo]) * ks[todo]
                pick[todo] = product >> np.uint64(32)
                todo = todo[(product & low) < (np.uint64(1 << 32) - ks[todo]) % ks[todo]]
            f = np.argmax(np.cumsum(spread[split], 1) > pick.astype(np.int64)[:, None], 1)
            r = np.arange(len(who))
            u = (words[tree[who], used[who]] >> np.uint64(11)) * 2.0**-53
            used[who] += 1
            a, b = lo[split][r, f], hi[split][r, f]
            if not np.isfinite(b - a).all():
                raise OverflowError("values between which a tree cuts must lie in a finite range")
            left = rows[split][r, :, f] < (a + (b - a) * u)[:, None]
            right = own[split] & ~left
            start = at[who] + count[split] - right.sum(1)
            depth[who, at[who]] = depth[who, start] = here[split] + 1
            node[who] = np.where(right, start[:, None], node[who])
        active = active[at[active] < n]
    share = out.reshape(curves, trees, n) / max(float(_expected(n)), 1e-9)
    return 2.0 ** -share.mean(1)


def _score_curves(values: pd.Series, n: pd.Series, trees: int, lanes: int = 4096) -> pd.Series:
    """Scores of curves given as all values of their windows in a row; curves of one shape go together, so many at once."""
    out, shapes = [None] * len(values), {}
    for i, (v, k) in enumerate(zip(values, n, strict=True)):
        shapes.setdefault((int(k), len(v) // int(k)), []).append(i)
    for (k, d), own in shapes.items():
        step = max(1, lanes * 200 // (trees * k * max(d, 1)))
        for j in range(0, len(own), step):
            part = own[j : j + step]
            scores = _score_together(np.array([np.asarray(values.iloc[i], float).reshape(k, d) for i in part]), trees)
            for i, row in zip(part, scores, strict=True):
                out[i] = row
    return pd.Series(out)


def isolation_forest(df: DataFrame, vec: str, key: str, trees: int = 100, size: int = 256) -> DataFrame:
    """``outlier_score``: higher is more isolated. Trees grow on digest samples of at most ``size`` rows, which bounds them."""
    import json

    sample = df.select(key, F.col(vec).alias("_x")).orderBy(F.md5(F.col(key).cast("string")), key).limit(trees * size // 4)
    dealt = sample.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(F.pmod(F.xxhash64(key, "_t"), F.lit(trees)) < max(4, trees // 25))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_t"].iloc[0])
        rng = np.random.default_rng(t)
        x = np.array(pdf.sort_values(key)["_x"].tolist(), float)
        x = x[rng.permutation(len(x))[:size]]
        return pd.DataFrame({"tree": [json.dumps([len(x), _grow(x, rng, 0, int(np.ceil(np.log2(max(2, len(x))))))])]})

    forest = [json.loads(r["tree"]) for r in dealt.groupBy("_t").applyInPandas(grow, "tree string").collect()]
    box = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(outlier_score=_score(np.array(pdf[vec].tolist(), float), box.value))

    return df.mapInPandas(score, T.StructType([*df.schema.fields, T.StructField("outlier_score", T.DoubleType())]))


def anomaly_scores(df: DataFrame, key: str, vec: str = "embedding", dims: int = 20, flag_from: float = 0.99) -> DataFrame:
    """``dims`` principal components, or all if there are fewer, standardised, then the isolation forest; the highest scores are flagged."""
    first = df.select(F.size(vec)).first()
    p = pca(df.select(key, vec), min(dims, first[0]) if first else dims, vec).withColumn("_v", array_to_vector("pc"))
    p = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(p).transform(p).select(key, vector_to_array("_s").alias("x"))
    scored = isolation_forest(p, "x", key)
    scored = checkpointed(scored)
    cut = exact_quantiles(scored, "outlier_score", {"_cut": flag_from})
    return scored.crossJoin(F.broadcast(cut)).select(key, "outlier_score", (F.col("outlier_score") >= F.col("_cut")).cast("int").alias("flag"))


def weird_stars(df: DataFrame, key: str, vec: str = "embedding", score: str = "smooth", best: int = 200, n: int = 20) -> DataFrame:
    """The ``n`` most isolated of the ``best`` rows by score."""
    top = df.orderBy(F.desc(score), key).limit(best)
    return anomaly_scores(top, key, vec).orderBy(F.desc("outlier_score"), key).limit(n)


def plain_segments(points: DataFrame, window: int, stride: int) -> DataFrame:
    """(star_id, mission, start, values) of the regular windows: the segmentation that ``star_anomalies`` takes by default."""
    curves = points.groupBy(*star_key(points)).agg(F.count("*").alias("n_points"))
    return pack_windows(cut_points(points, make_segments(curves, window, stride), window, stride)).drop("end")


def star_anomalies(points: DataFrame, window: int, stride: int, segment: Callable[[DataFrame, int, int], DataFrame] = plain_segments, fit_on_self: bool = False, trees: int = 100, size: int = 256, part: int = 1024) -> DataFrame:
    """``outlier_score`` of each window. ``segment`` cuts curves: (points, window, stride) to rows with star_id, start and values.

    One forest for all windows, or one of each curve's own: it grows on at most ``size`` of its windows, by digest, and scores
    the curve in parts of about ``part`` windows, so tasks stay bounded on any curve. Curves of at most ``size`` windows are
    scored by their own trees many at a time.
    """
    import json

    rows = segment(points, window, stride)
    key = star_key(rows)
    if not fit_on_self:
        return isolation_forest(rows.withColumn("_k", F.concat_ws("|", *key, "start")), "values", "_k", trees, size).drop("_k")
    lengths = F.count("*").over(Window.partitionBy(*key))
    rows = checkpointed(rows.withColumn("_all", lengths))
    most = min(size, part)
    rest = [c for c in rows.columns if c not in (*key, "_all")]
    short = rows.where(F.col("_all") <= most).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", *(c for c in rest if c != "start")))).alias("_w"))
    small_score = F.pandas_udf(lambda values, n: _score_curves(values, n, trees), "array<double>")
    short = short.withColumn("_s", small_score(F.flatten(F.transform("_w", lambda w: w["values"].cast("array<double>"))), F.size("_w")))
    short = short.select(*key, F.explode(F.arrays_zip("_w", "_s")).alias("_x")).select(*key, "_x._w.*", F.col("_x._s").alias("outlier_score"))
    rows = rows.where(F.col("_all") > most).drop("_all")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("start")["values"].tolist(), float)
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        return pdf[key].iloc[:1].assign(forest=json.dumps([[len(x), _grow(x, np.random.default_rng(t), 0, limit)] for t in range(trees)]))

    ranked = digest_ranks(rows, key, F.md5(F.concat_ws("|", *key, "start")), ["start"])
    names = ", ".join(f"{k} string" for k in key)
    forests = ranked.where(F.col("_r") <= size).select(*key, "start", "values").groupBy(*key).applyInPandas(grow, f"{names}, forest string")
    parts = rows.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("_n"))
    dealt = rows.join(parts, key).withColumn("_part", F.pmod(F.xxhash64("start"), F.col("_n")).cast("int")).drop("_n")
    spread = forests.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        forest = json.loads(right["forest"].iloc[0])
        return left.drop(columns="_part").assign(outlier_score=_score(np.array(left["values"].tolist(), float), forest))

    schema = T.StructType([*rows.schema.fields, T.StructField("outlier_score", T.DoubleType())])
    return dealt.groupBy(*key, "_part").cogroup(spread.groupBy(*key, "_part")).applyInPandas(score, schema).unionByName(short)
