"""Light-curve views over the test tables, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import windows as W

WINDOW, STRIDE, LEAST = 16, 4, 4


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded as SQL rounds doubles: the scaled value, halves away from zero. F.round goes by the digits that Java shows."""
    scale = 10.0**digits
    return F.when(F.abs(x) < 1e299, F.round(x * scale) / scale).otherwise(x)  # larger ones have no places, and would overflow


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits and whole numbers as bigint, as the SQL side gives them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c.cast("double") + 1e-9, 6) + F.lit(0.0)  # means that end in a 5 are rounded alike by every order of adding
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def prefix(user):
    return F.when(user % 3 == 0, "KIC_").when(user % 3 == 1, "EPIC_").otherwise("TIC_")


def mission(user):
    return F.when(user % 3 == 0, "kepler").when(user % 3 == 1, "k2").otherwise("tess")


def by_time():
    return Window.partitionBy("user_id").orderBy("time")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Points with their user, by whom and by time they are dealt and sorted."""
    u = F.col("user_id")
    time = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("double") / 86400000000.0
    rows = load(spark, d, "events").select("user_id", time.alias("time"), F.col("value").cast("double").alias("flux"))
    idx = F.row_number().over(by_time()).cast("bigint") - 1
    return rows.select("user_id", F.concat(prefix(u), u.cast("string")).alias("star_id"), mission(u).alias("mission"), idx.alias("idx"), "time", "flux")


def points(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).drop("user_id")


def curves(pts: DataFrame) -> DataFrame:
    return pts.groupBy("star_id", "mission").agg(F.count("*").alias("n_points"))


def ephemeris(spark: SparkSession, d: str, second: bool = False) -> DataFrame:
    u = F.col("user_id")
    users = load(spark, d, "events").select("user_id").distinct()
    star = [F.concat(prefix(u), u.cast("string")).alias("star_id"), mission(u).alias("mission")]
    p1, p2 = F.lit(2.0) + u % 5, F.lit(3.0) + u % 4
    one = users.where("user_id % 4 != 0").select(*star, p1.alias("period_days"), (F.lit(0.5) * (u % 3)).alias("t0_mission"), (F.lit(0.12) * p1).alias("duration_days"))
    two = users.where("user_id % 7 = 0").select(*star, p2.alias("period_days"), F.lit(0.25).alias("t0_mission"), (F.lit(0.1) * p2).alias("duration_days"))
    return one.union(two) if second else one


def labelled(spark: SparkSession, d: str) -> DataFrame:
    pts = points(spark, d)
    return W.label_by_count(W.make_segments(curves(pts), WINDOW, STRIDE), W.in_transit_any(pts, ephemeris(spark, d)), LEAST)


def window_points(spark: SparkSession, d: str) -> DataFrame:
    pts = points(spark, d)
    return W.window_points(pts, W.make_segments(curves(pts), WINDOW, STRIDE), WINDOW, STRIDE)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled windows with a score and their middle, the median time. Both are taken over the points that follow a window's
    first one, in the order that numbers them, so no point is copied for each window that holds it."""
    ahead = by_time().rowsBetween(0, WINDOW - 1)
    s = F.sum(F.round(F.col("flux") * 100).cast("bigint")).over(ahead) * 7919 % 1000 / 1000.0
    middle = F.lead("time", WINDOW // 2 - 1).over(by_time()) * 0.5 + F.lead("time", WINDOW // 2).over(by_time()) * 0.5
    p = _numbered(spark, d).select("star_id", "mission", F.col("idx").alias("start"), s.cast("double").alias("p"), middle.alias("seg_mid_time")).where(F.col("start") % STRIDE == 0)
    return labelled(spark, d).join(p, ["star_id", "mission", "start"]).select("star_id", "mission", "start", "end", "label", "n_hits", "p", "seg_mid_time")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Customers as catalog rows of all missions with the flaws that catalogs have."""
    k, b = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    text = k.cast("string")
    return load(spark, d, "customer").select(
        F.when(k % 5 == 0, F.concat(text, F.lit(".0"))).alias("kepid"), F.when(k % 5 == 1, text).alias("epic"), F.when(k % 5 == 2, text).alias("tid"), F.when(k % 15 == 3, text).alias("toi"),
        F.when(k % 15 == 8, F.concat(F.lit("K"), text)).alias("koi_name"), F.when(k % 7 == 0, F.concat(F.lit("Host "), text)).alias("hostname"),
        F.when(k % 11 == 0, F.lit(" K2 ")).when(k % 11 == 1, F.lit("nan")).when(k % 11 == 2, F.lit("")).alias("mission"),
        F.when(k % 13 == 0, F.concat(F.lit("EPIC -"), text)).when(k % 13 == 1, F.concat(F.lit("TIC__"), text)).when(k % 13 == 2, F.lit("none")).alias("star_id"),
        F.when(k % 6 != 0, b / 1000).alias("pl_orbper"), (F.lit(2457100.0) + k % 100).alias("pl_tranmid"), F.when(k % 4 != 0, F.lit(1.0) + k % 9).alias("pl_trandurh"), (F.lit(2.0) + k % 3).alias("pl_trandur"),
        F.when(k % 10 == 0, F.lit(3.0) + k % 8).alias("koi_period"), F.when(k % 10 == 0, F.lit(130.0) + k % 50).alias("koi_time0bk"), F.when(k % 20 == 0, F.lit(2.5)).alias("koi_duration"), F.lit(None).cast("string").alias("koi"), k.alias("row_id"),
    )


PTS = """ev AS (SELECT user_id, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 86400000000e0 AS time, CAST(value AS DOUBLE) AS flux FROM events),
pts AS (SELECT CASE user_id % 3 WHEN 0 THEN 'KIC_' WHEN 1 THEN 'EPIC_' ELSE 'TIC_' END || user_id AS star_id, CASE user_id % 3 WHEN 0 THEN 'kepler' WHEN 1 THEN 'k2' ELSE 'tess' END AS mission, user_id, row_number() OVER (PARTITION BY user_id ORDER BY time) - 1 AS idx, time, flux FROM ev),
curves AS (SELECT star_id, mission, min(user_id) AS user_id, count(*) AS n_points FROM pts GROUP BY 1, 2),
eph AS (SELECT star_id, mission, 2e0 + user_id % 5 AS period_days, 0.5e0 * (user_id % 3) AS t0_mission, 0.12e0 * (2e0 + user_id % 5) AS duration_days FROM curves WHERE user_id % 4 <> 0),
eph2 AS (SELECT * FROM eph UNION ALL SELECT star_id, mission, 3e0 + user_id % 4, 0.25e0, 0.1e0 * (3e0 + user_id % 4) FROM curves WHERE user_id % 7 = 0),
seg AS (SELECT star_id, mission, unnest(range(0, n_points - 16 + 1, 4)) AS start FROM curves WHERE n_points >= 16)"""
HIT = "CASE WHEN abs(((time - t0_mission + period_days / 2) - period_days * floor((time - t0_mission + period_days / 2) / period_days)) - period_days / 2) < duration_days / 2 AND duration_days / period_days < 0.2 THEN 1 ELSE 0 END"
LAB = f"""{PTS},
hits AS (SELECT p.star_id, p.idx, max(coalesce({HIT}, 0)) AS hit FROM pts p LEFT JOIN eph e ON p.star_id = e.star_id AND p.mission = e.mission GROUP BY 1, 2),
wp AS (SELECT s.star_id, s.mission, s.start, p.idx, p.time, p.flux FROM seg s JOIN pts p ON p.star_id = s.star_id AND p.idx >= s.start AND p.idx < s.start + 16),
lab AS (SELECT s.star_id, s.mission, s.start, s.start + 16 AS "end", CAST(sum(h.hit) AS BIGINT) AS n_hits, CASE WHEN sum(h.hit) >= 4 THEN 1 ELSE 0 END AS label FROM seg s JOIN hits h ON h.star_id = s.star_id AND h.idx >= s.start AND h.idx < s.start + 16 GROUP BY 1, 2, 3)"""
SCO = f"""{LAB},
pp AS (SELECT star_id, start, CAST(CAST(sum(CAST(round(flux * 100) AS BIGINT)) AS BIGINT) * 7919 % 1000 AS DOUBLE) / 1000e0 AS p, quantile_cont(time, 0.5) AS seg_mid_time FROM wp GROUP BY 1, 2),
sco AS (SELECT lab.*, pp.p, pp.seg_mid_time FROM lab JOIN pp USING (star_id, start)),
rk AS (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY p DESC, start) AS r FROM sco),
star AS (SELECT star_id, max(label) AS y_star, max(p) AS score_max, avg(p) FILTER (r <= 10) AS top_mean, quantile_cont(p, 0.5) FILTER (r <= 10) AS top_median, count(*) AS n, avg(CASE WHEN p > 0.6 THEN 1e0 ELSE 0e0 END) AS share_high FROM rk GROUP BY 1),
byp AS (SELECT p AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM sco GROUP BY 1),
cur AS (SELECT threshold, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS ap, CAST(sum(neg) OVER () AS DOUBLE) AS an FROM byp WINDOW w AS (ORDER BY threshold DESC))"""
CAT = """cat AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey || '.0' END AS kepid, CASE WHEN c_custkey % 5 = 1 THEN c_custkey || '' END AS epic, CASE WHEN c_custkey % 5 = 2 THEN c_custkey || '' END AS tid, CASE WHEN c_custkey % 15 = 3 THEN c_custkey || '' END AS toi,
CASE WHEN c_custkey % 15 = 8 THEN 'K' || c_custkey END AS koi_name, CASE WHEN c_custkey % 7 = 0 THEN 'Host ' || c_custkey END AS hostname, CASE c_custkey % 11 WHEN 0 THEN ' K2 ' WHEN 1 THEN 'nan' WHEN 2 THEN '' END AS mission,
CASE c_custkey % 13 WHEN 0 THEN 'EPIC -' || c_custkey WHEN 1 THEN 'TIC__' || c_custkey WHEN 2 THEN 'none' END AS star_id, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_acctbal AS DOUBLE) / 1000 END AS pl_orbper, 2457100e0 + c_custkey % 100 AS pl_tranmid,
CASE WHEN c_custkey % 4 <> 0 THEN 1e0 + c_custkey % 9 END AS pl_trandurh, 2e0 + c_custkey % 3 AS pl_trandur, CASE WHEN c_custkey % 10 = 0 THEN 3e0 + c_custkey % 8 END AS koi_period, CASE WHEN c_custkey % 10 = 0 THEN 130e0 + c_custkey % 50 END AS koi_time0bk, CASE WHEN c_custkey % 20 = 0 THEN 2.5e0 END AS koi_duration, c_custkey AS row_id FROM customer),
ids AS (SELECT *, CASE WHEN lower(trim(star_id)) IN ('', 'nan', 'none') THEN NULL ELSE regexp_replace(regexp_replace(trim(star_id), '^(KIC|KOI|EPIC|TIC|TOI)[\\s\\-]+', '\\1_'), '__+', '_', 'g') END AS given, CASE WHEN lower(trim(mission)) IN ('', 'nan', 'none') THEN NULL ELSE lower(trim(mission)) END AS m FROM cat),
named AS (SELECT * EXCLUDE (star_id, mission), coalesce(m, CASE WHEN starts_with(given, 'KIC_') THEN 'kepler' WHEN starts_with(given, 'EPIC_') THEN 'k2' WHEN starts_with(given, 'TIC_') THEN 'tess' END, CASE WHEN kepid IS NOT NULL OR koi_name IS NOT NULL THEN 'kepler' WHEN epic IS NOT NULL THEN 'k2' WHEN tid IS NOT NULL OR toi IS NOT NULL THEN 'tess' END) AS mission,
coalesce(given, 'KIC_' || CAST(CAST(kepid AS DOUBLE) AS BIGINT), 'EPIC_' || epic, 'TIC_' || tid, 'TOI_' || toi, koi_name, hostname) AS star_id FROM ids)"""


def sql(body: str, floats: str = "", ints: str = "", base: str = "") -> str:
    """A query over the views named in ``base``, with floats rounded and ints as BIGINT, as ``tidy`` does."""
    changes = [f'round({c} + 1e-9, 6) + 0e0 AS {c}' for c in floats.split()] + [f'CAST({c} AS BIGINT) AS {c}' for c in ints.split()]
    replace = f" REPLACE ({', '.join(changes)})" if changes else ""
    return f"{'WITH ' + base + ' ' if base else ''}SELECT *{replace} FROM ({body}) AS _q"
