"""Splits, balanced sets and samples by digest order: exact counts, the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed
from .ranks import digest_ranks
from .scores import md5_key, nlargest

SPLITS = ("train", "val", "test")


def shuffle(df: DataFrame, seed: str, *key: str) -> DataFrame:
    """A column ``shuffle_key`` by which rows sort in a random-looking, repeatable order."""
    return df.withColumn("shuffle_key", md5_key(seed, *key))


def ranks(df: DataFrame, keys: list[str], seed: str, *key: str) -> DataFrame:
    """``_r``: a row's place by digest in its group, from 1, and ``_n`` the group's rows; groups can be as large as the table."""
    return digest_ranks(df, keys, md5_key(seed, *key), list(key))


def star_table(labelled: DataFrame) -> DataFrame:
    """(star_id, has_pos): 1 where a star has a positive window; windows without a label count as negative."""
    return labelled.groupBy("star_id").agg(F.coalesce(F.max("label"), F.lit(0)).cast("int").alias("has_pos"))


def positive_quota(n: Column, n_pos: Column, take: Column) -> Column:
    """How many of ``take`` of ``n`` stars are positive, by largest remainders: the whole part of its share for each stratum, and
    the star that is left to the one with the larger remainder, the positive ones if both are a half. Whole numbers only."""
    return F.call_function("div", 2 * take * n_pos + n, 2 * n)


def _star_split(labelled: DataFrame, seed: str, test: float, val: float, every: bool, least: int) -> DataFrame:
    r = ranks(star_table(labelled), ["has_pos"], seed, "star_id")
    sizes = r.groupBy().agg(F.count("*").alias("_all"), F.coalesce(F.sum("has_pos"), F.lit(0)).alias("_pos"))
    few = F.concat(F.col("_all").cast("string"), F.lit(f" stars are too few to split; {least} are needed"))
    n = F.when(F.col("_all") >= least, F.col("_all")).otherwise(F.raise_error(few).cast("bigint")) if least else F.col("_all")
    sizes = sizes.select(n.alias("_all"), "_pos")
    # Of three positive stars or more, each split gets one where ``every`` asks for it.
    spare = F.when(F.col("_pos") >= 3, 1).otherwise(0) if every else F.lit(0)
    sizes = sizes.withColumn("_t", F.least(F.ceil(F.col("_all") * test), F.col("_all"))).withColumn("_spare", spare)
    sizes = sizes.withColumn("_tp", F.least(F.greatest(positive_quota(F.col("_all"), F.col("_pos"), F.col("_t")), F.col("_spare")), F.col("_pos") - 2 * F.col("_spare")))
    left, left_pos = F.col("_all") - F.col("_t"), F.col("_pos") - F.col("_tp")
    sizes = sizes.withColumn("_v", F.least(F.ceil(left * val), left))
    sizes = sizes.withColumn("_vp", F.least(F.greatest(F.when(left > 0, positive_quota(left, left_pos, F.col("_v"))).otherwise(0), F.col("_spare")), left_pos - F.col("_spare")))
    n_test = F.when(F.col("has_pos") == 1, F.col("_tp")).otherwise(F.col("_t") - F.col("_tp"))
    n_val = F.when(F.col("has_pos") == 1, F.col("_vp")).otherwise(F.col("_v") - F.col("_vp"))
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return r.crossJoin(F.broadcast(sizes)).select("star_id", "has_pos", split.alias("split"))


def stratified_star_split(labelled: DataFrame, seed: str, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """(star_id, has_pos, split): ceil(test * n) of the n stars in test, then ceil(val * m) of the m that are left in val.

    Both are dealt to stars with and without a positive window by largest remainders, so a split has its size whatever the
    strata's sizes, and a stratum of one star is not used up by a small split. Inside a stratum stars go by digest order.
    """
    return _star_split(labelled, seed, test, val, False, 0)


def small_split(labelled: DataFrame, seed: str, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """``stratified_star_split`` for few stars: from three positive stars on every split has one, in the place of a negative one.

    Fewer than five stars are an error when the split is computed.
    """
    return _star_split(labelled, seed, test, val, True, 5)


def group_split(labelled: DataFrame, seed: str, share: float = 0.2) -> DataFrame:
    """(star_id, has_pos, split): int(share * n) stars in test, of which int(share * n0) are negative; then the same for val."""
    r = ranks(star_table(labelled), ["has_pos"], seed, "star_id")
    sizes = r.groupBy().agg(F.count("*").alias("_all"), F.sum(1 - F.col("has_pos")).alias("_n0"))
    rows = r.crossJoin(F.broadcast(sizes))
    take0 = F.floor(F.col("_n0") * share)
    take = F.when(F.col("has_pos") == 0, take0).otherwise(F.floor(F.col("_all") * share) - take0)
    return rows.select("star_id", "has_pos", F.when(F.col("_r") <= take, "test").when(F.col("_r") <= 2 * take, "val").otherwise("train").alias("split"))


def positional_split(df: DataFrame, position: str) -> DataFrame:
    """80/10/10 by position, val and test with one row at least from three rows on; one or two rows: train, then val."""
    n = df.agg(F.count("*").alias("_n"))
    rows = df.crossJoin(F.broadcast(n)).withColumn("_p", F.col(position))
    a = F.when(F.col("_n") <= 2, 1).when(F.col("_n") == 3, 1).otherwise(F.greatest(F.rint(F.col("_n") * 0.8), F.lit(1.0)))
    b = F.when(F.col("_n") <= 2, 2).when(F.col("_n") == 3, 2).otherwise(a + F.greatest(F.rint(F.col("_n") * 0.1), F.lit(1.0)))
    return rows.withColumn("split", F.when(F.col("_p") < a, "train").when(F.col("_p") < b, "val").otherwise("test")).drop("_n", "_p")


def balanced_train_set(df: DataFrame, hard: DataFrame, seed: str, ratio: int = 1, hard_frac: float = 0.0) -> DataFrame:
    """All positives, ``hard_frac`` of the negatives from the hard ones, the others by digest; ``ratio`` negatives a positive.

    Where there are fewer hard ones than that share, the others fill their places.
    """
    df = checkpointed(df)
    pos, neg = df.where("label = 1"), df.where("label = 0")
    sizes = df.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).first()
    n_neg = min(sizes["n"] or 0, ratio * (sizes["p"] or 0))
    chosen = checkpointed(nlargest(hard, round(hard_frac * n_neg)))
    n_hard = chosen.count()
    rest = neg.join(chosen.select("star_id", "start"), ["star_id", "start"], "left_anti")
    easy = ranks(rest.withColumn("_g", F.lit(1)), ["_g"], seed, "star_id", "start").where(F.col("_r") <= n_neg - n_hard).select(df.columns)
    return pos.unionByName(chosen.select(df.columns)).unionByName(easy)


def oversample(df: DataFrame) -> DataFrame:
    """The rarer label's rows repeated so that both labels have equally many, the first by digest once more where it is uneven."""
    r = ranks(df, ["label"], "oversample", "star_id", "start")
    most = df.groupBy("label").count().agg(F.max("count").alias("_most"))
    rows = r.crossJoin(F.broadcast(most))
    times = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_r") <= F.col("_most") % F.col("_n"), 1).otherwise(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint")))).drop("_r", "_n", "_most")


def class_weight(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(1 - F.col("label")).alias("n0"), F.sum("label").alias("n1")).selectExpr("stack(2, 0, 1D, 1, try_divide(n0, n1)) as (label, weight)")


def choose_stars(stars: DataFrame, share: float, seed: str, force: bool = False) -> DataFrame:
    """int(share * n + 0.5) stars by digest, one at least if forced."""
    r = ranks(stars.select("star_id", F.lit(1).alias("_g")), ["_g"], seed, "star_id")
    k = F.floor(F.col("_n") * share + 0.5)
    return r.where(F.col("_r") <= (F.greatest(k, F.lit(1)) if force else k)).select("star_id")


def sample_rows(df: DataFrame, n: int, seed: str, *key: str) -> DataFrame:
    return df.orderBy(md5_key(seed, *key), *key).limit(n)


def row_split(df: DataFrame, seed: str, shares: tuple = (0.7, 0.15, 0.15), *key: str) -> DataFrame:
    """Rows of each label in the given shares, by digest; quotas are rounded half to even and the first split gets the rest."""
    r = ranks(df, ["label"], seed, *key)
    n_test, n_val = F.rint(F.col("_n") * shares[2]), F.rint(F.col("_n") * shares[1])
    return r.withColumn("split", F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")).drop("_r", "_n")


def augment_with_hard_negatives(train: DataFrame, hard: DataFrame, weight: float = 2.0) -> DataFrame:
    return train.withColumn("weight", F.lit(1.0)).unionByName(hard.withColumn("weight", F.lit(weight)), allowMissingColumns=True)


def split_overlap(df: DataFrame) -> DataFrame:
    """How many stars two splits share: all counts are 0 in a split without leaks."""
    stars = df.select("star_id", "split").distinct()
    a, b = stars.withColumnRenamed("split", "a"), stars.withColumnRenamed("split", "b")
    return a.join(b, "star_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))
