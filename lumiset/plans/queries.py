"""One query for each operator over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..operators import embeddings as E
from ..operators import sampling as S
from ..operators import scores as R
from ..operators import signals as C
from ..operators import triage as T
from ..operators import windows as W
from ..operators.ranks import merge_sketches, quantile_sketch, sketch_quantile
from ..schemas import require_columns
from ..sources import catalogs as A
from ..sources import layout as Y
from ..sources import score_log as L
from ..storage import checkpointed, new_folder, written
from . import fixtures as X
from . import pipelines as P
from .fixtures import CAT, LAB, PTS, SCO, load, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    """Register a function (spark, sf_dir) under a name, with its SQL if it can be expressed."""

    def add(f):
        QUERIES[name] = lambda spark, d: X.tidy(f(spark, d))
        if text:
            SQL[name] = text
        return f

    return add


def simple(name: str, f, text: str | None = None) -> None:
    query(name, text)(f)


def as_csv(df) -> str:
    """The path of ``df`` as CSV."""
    path = f"{new_folder(df.sparkSession, 'csv')}/table.csv"
    A.write_table(df, path)
    return path


# ---- A: sources and sinks --------------------------------------------------------------------------------------------------

simple("a1_read_catalog", lambda s, d: A.read_catalog(s, as_csv(X.catalog(s, d).drop("koi_duration"))).select("kepid", "epic", "pl_orbper", "koi_duration", "koi"),
       sql("SELECT kepid, epic, pl_orbper, CAST(NULL AS DOUBLE) AS koi_duration, CAST(NULL AS VARCHAR) AS koi FROM cat", "pl_orbper koi_duration", base=CAT))
simple("a2_read_ephemerides", lambda s, d: A.ephemeris_table(X.catalog(s, d).select("pl_trandurh", "star_id", "pl_orbper", "pl_tranmid")),
       sql("SELECT star_id, pl_orbper, pl_tranmid, pl_trandurh, 'k2' AS mission FROM cat", "pl_orbper pl_tranmid pl_trandurh", base=CAT))


#: Ids under the archives' other names, some of them of no use in one column and good in the next.
ALIASED = "SELECT c_custkey AS row_id, CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN c_custkey || '.0' END AS k1, CASE WHEN c_custkey % 2 = 0 THEN c_custkey || '' END AS k2, CASE WHEN c_custkey % 5 = 0 THEN c_custkey || '' ELSE ' ' END AS e1, CASE WHEN c_custkey % 7 < 3 THEN 'nan' ELSE c_custkey || '.0' END AS t1, CASE WHEN c_custkey % 7 = 1 THEN c_custkey || '' END AS t2, CASE WHEN c_custkey % 7 = 2 THEN c_custkey || '.01' END AS o1 FROM customer"


def aliased(s, d):
    k = F.col("c_custkey")
    t = k.cast("string")
    whole = F.concat(t, F.lit(".0"))
    return load(s, d, "customer").select(
        k.alias("row_id"), F.when(k % 3 == 0, "x").when(k % 3 == 1, whole).alias("k1"), F.when(k % 2 == 0, t).alias("k2"), F.when(k % 5 == 0, t).otherwise(" ").alias("e1"),
        F.when(k % 7 < 3, "nan").otherwise(whole).alias("t1"), F.when(k % 7 == 1, t).alias("t2"), F.when(k % 7 == 2, F.concat(t, F.lit(".01"))).alias("o1"),
    )


simple("a1_read_catalog_aliases", lambda s, d: A.read_catalog(s, as_csv(aliased(s, d).drop("k1").withColumnsRenamed({"k2": "KIC", "e1": "EPIC", "t1": "TIC ID", "t2": "tic", "o1": "TOI", "row_id": "hostname"}))).select(F.col("hostname").cast("bigint").alias("row_id"), "kepid", "epic", "tid", "toi"),
       sql("SELECT row_id, k2 AS kepid, nullif(trim(e1), '') AS epic, CASE WHEN t1 <> 'nan' THEN t1 ELSE t2 END AS tid, o1 AS toi FROM al", base=f"al AS ({ALIASED})"))
simple("b4_target_and_mission_aliases", lambda s, d: I.target_and_mission(aliased(s, d).toDF("row_id", "KIC", "kic", "EPIC", "TIC ID", "tic_id", "TOI")).select("row_id", "target", "target_mission"),
       sql("SELECT row_id, coalesce('KIC ' || CASE WHEN row_id % 3 = 1 OR row_id % 2 = 0 THEN row_id END, 'EPIC ' || CASE WHEN row_id % 5 = 0 THEN row_id END, 'TIC ' || CASE WHEN row_id % 7 NOT IN (0, 2) THEN row_id END, 'TOI ' || o1) AS target, CASE WHEN row_id % 3 = 1 OR row_id % 2 = 0 THEN 'Kepler' WHEN row_id % 5 = 0 THEN 'K2' WHEN row_id % 7 <> 0 THEN 'TESS' END AS target_mission FROM al", base=f"al AS ({ALIASED})"))


@query("a3_confirmed_ephemerides", sql("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS star_id, pl_orbper, pl_tranmid, pl_trandurh FROM cat JOIN orders ON o_custkey = row_id WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'F' AND pl_orbper IS NOT NULL AND pl_trandurh IS NOT NULL", "pl_orbper pl_tranmid pl_trandurh", base=CAT))
def _(s, d):
    composite = X.catalog(s, d).select(F.col("row_id").alias("pl_name"), "pl_orbper", "pl_tranmid", "pl_trandurh")
    o = load(s, d, "orders").select(F.col("o_custkey").alias("pl_name"), F.col("o_custkey").cast("string").alias("star_id"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("default_flag"), F.when(F.col("o_orderstatus") == "F", "Confirmed").otherwise("CANDIDATE").alias("disposition"))
    return A.confirmed_ephemerides(composite, o)


ORD = "SELECT 'EPIC ' || o_custkey AS epic_number, o_orderkey AS pos FROM orders"
orders = lambda s, d: load(s, d, "orders").select(F.concat(F.lit("EPIC "), F.col("o_custkey").cast("string")).alias("epic_number"), F.col("o_orderkey").alias("pos"))
simple("a4_campaign_targets", lambda s, d: A.campaign_targets(orders(s, d), "pos", "EPIC_"), sql("SELECT 'EPIC_' || o_custkey AS target, min(o_orderkey) AS pos FROM orders GROUP BY 1"))
simple("a5_load_ids", lambda s, d: A.load_ids(orders(s, d), "epic_number", "pos", 50), sql("SELECT CAST(o_custkey AS VARCHAR) AS target, min(o_orderkey) AS pos FROM orders GROUP BY 1 ORDER BY pos LIMIT 50"))
simple("a6_usable_curves", lambda s, d: A.usable_curves(X.ephemeris(s, d), X.points(s, d).withColumn("empty", F.col("flux") < 1)).groupBy("star_id").agg(F.count("*").alias("n")),
       sql("SELECT star_id, count(*) AS n FROM pts WHERE NOT flux < 1 AND star_id IN (SELECT star_id FROM eph) GROUP BY 1", base=PTS))
PROD = """pr AS (SELECT DISTINCT l_suppkey AS star_id, l_returnflag || l_linestatus AS provenance, l_orderkey * 10 + l_linenumber AS product_id, l_quantity % 7 AS n_time FROM lineitem),
rr AS (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY CASE provenance WHEN 'NF' THEN 1 WHEN 'RF' THEN 2 ELSE 3 END, product_id, provenance, n_time) AS k FROM pr WHERE provenance <> 'AF')"""


def products(s, d):
    li = load(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("star_id"), F.concat("l_returnflag", "l_linestatus").alias("provenance"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("product_id"), (F.col("l_quantity") % 7).alias("n_time")).distinct().withColumn("n_flux", F.col("n_time"))


simple("a7_pick_product", lambda s, d: A.pick_product(products(s, d), ["NF", "RF"], ["AF"], tie=["product_id", "provenance", "n_time"]).select("star_id", "provenance", "product_id"),
       sql("SELECT star_id, provenance, product_id FROM rr WHERE k <= 6 AND n_time > 0 QUALIFY row_number() OVER (PARTITION BY star_id ORDER BY k) = 1", base=PROD))


@query("a8_pick_mission_and_stitch", sql("SELECT star_id, mission, product_id, file_no, row_number() OVER (PARTITION BY star_id ORDER BY file_no, product_id) - 1 AS idx FROM (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY product_id) AS file_no FROM (SELECT *, min(k) OVER (PARTITION BY star_id) AS best FROM (SELECT o_custkey AS star_id, o_orderstatus AS mission, o_orderkey AS product_id, CASE WHEN o_orderstatus = (CASE WHEN o_custkey % 2 = 0 THEN 'P' ELSE 'O' END) THEN 0 ELSE CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END END AS k FROM orders)) WHERE k = best) WHERE file_no <= 4"))
def _(s, d):
    o = load(s, d, "orders").select(F.col("o_custkey").alias("star_id"), F.col("o_orderstatus").alias("mission"), F.col("o_orderkey").alias("product_id"), F.when(F.col("o_custkey") % 2 == 0, "P").otherwise("O").alias("preferred"))
    return A.stitch(A.pick_mission(o, ["F", "O", "P"]).withColumn("time", F.col("product_id"))).select("star_id", "mission", "product_id", "file_no", "idx")


STAR = "st AS (SELECT *, row_number() OVER (PARTITION BY has_pos ORDER BY md5('{seed}|' || star_id), star_id) AS r, count(*) OVER (PARTITION BY has_pos) AS n FROM (SELECT star_id, max(label) AS has_pos FROM lab GROUP BY 1))"
#: The split's rule in general form: whole parts of each stratum's share, then one more for the largest remainders.
DEAL = "{out} AS (SELECT *, {t} * {n} // a + CASE WHEN row_number() OVER (ORDER BY {t} * {n} % a DESC, has_pos DESC) <= {t} - sum({t} * {n} // a) OVER () THEN 1 ELSE 0 END AS {q} FROM (SELECT * {drop}, CAST(ceil(sum({n}) OVER () * 0.15e0) AS BIGINT) AS {t}, CAST(sum({n}) OVER () AS BIGINT) AS a FROM {src}))"
QUOTAS = ", ".join(["strata AS (SELECT has_pos, count(*) AS n FROM st GROUP BY 1)", DEAL.format(out="qt", t="t", n="n", q="nt", drop="", src="strata"), "rest AS (SELECT *, n - nt AS m FROM qt)", DEAL.format(out="qv", t="v", n="m", q="nv", drop="EXCLUDE a", src="rest")])
STAR += ", " + QUOTAS
SHARES = "SELECT star_id, has_pos, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'val' ELSE 'train' END AS split FROM st JOIN qv USING (has_pos)"
FLOORED = "pt AS (SELECT *, n - nt AS m FROM (SELECT * REPLACE (CASE WHEN has_pos = 1 THEN greatest(nt, CASE WHEN n >= 3 THEN 1 ELSE 0 END) ELSE t - greatest(t - nt, CASE WHEN a - n >= 3 THEN 1 ELSE 0 END) END AS nt) FROM qt)), " + DEAL.format(out="pd", t="v", n="m", q="nv", drop="EXCLUDE a", src="pt") + ", pv AS (SELECT * REPLACE (CASE WHEN has_pos = 1 THEN greatest(nv, CASE WHEN n >= 3 THEN 1 ELSE 0 END) ELSE v - greatest(v - nv, CASE WHEN (SELECT sum(n) FROM pd WHERE has_pos = 1) >= 3 THEN 1 ELSE 0 END) END AS nv) FROM pd)"
simple("a9_window_table", lambda s, d: written(E.pack_windows(X.window_points(s, d)).join(S.stratified_star_split(X.labelled(s, d), "7"), "star_id"), "windows", ("split",)).select("star_id", "mission", "start", "end", "split", F.size("values").alias("n"), F.element_at("values", 1).alias("v0")),
       sql(f'SELECT star_id, mission, start, start + 16 AS "end", split, count(*) AS n, arg_min(flux, idx) AS v0 FROM wp JOIN ({SHARES}) USING (star_id) GROUP BY 1, 2, 3, 4, 5', "v0", base=f"{LAB}, {STAR.format(seed='7')}"))
simple("a10_segments", lambda s, d: written(W.make_segments(X.curves(X.points(s, d)), 16, 4), "segments"), sql('SELECT star_id, mission, start, start + 16 AS "end" FROM seg', base=PTS))
simple("a11_triage_sink", lambda s, d: P.triage_run(X.scored(s, d)).select("star_id", "best_segment_score", "top_scores"), sql("SELECT star_id, max(p) AS best_segment_score, string_agg(printf('%.4f', p), ',' ORDER BY r) FILTER (r <= 5) AS top_scores FROM rk GROUP BY 1", "best_segment_score", base=SCO))
simple("a12_append_scores", lambda s, d: A.append_scores(X.curves(X.points(s, d)), X.ephemeris(s, d), "star_id"), sql("SELECT star_id, mission, n_points FROM curves WHERE star_id NOT IN (SELECT star_id FROM eph)", base=PTS))


@query("a12_score_and_append", sql("SELECT star_id, max(p) AS best, count(*) AS n_segments FROM sco GROUP BY 1", "best", base=SCO))
def _(s, d):
    """The score log of all stars after three runs: one over the stars of one mission, one over all, and one that finds nothing to do."""
    scored = L.by_digest(X.scored(s, d).select("star_id", "mission", "p"))
    score = lambda stars: L.of_chunk(scored, stars).groupBy("star_id").agg(F.max("p").alias("best"), F.count("*").alias("n_segments"))
    log, stars = new_folder(s, "scores"), checkpointed(scored.select("star_id", "mission").distinct())
    for targets in (stars.where("mission = 'k2'"), stars, stars):
        out = L.score_and_append(targets, log, score, "star_id string, best double, n_segments long", save_every=1000)
    return out


simple("a10_clustered_layout", lambda s, d: clustered_labels(s, d, "k2"), sql("SELECT star_id, mission, start, \"end\", n_hits, label FROM lab WHERE mission = 'k2'", ints="label", base=LAB))


def clustered_labels(s, d, mission):
    """Labelled windows of a mission from tables clustered by mission and star: the joins of D6, E2 and E3 without an exchange."""
    points = Y.clustered(X.points(s, d), "points")
    segments = Y.clustered(W.make_segments(X.curves(X.points(s, d)), X.WINDOW, X.STRIDE), "segments", ("start",))
    ephemeris = Y.clustered(X.ephemeris(s, d), "ephemeris", ())
    here = F.col("mission") == mission
    hits = W.in_transit_any(points.where(here), ephemeris.where(here))
    return W.label_by_count(segments.where(here), hits, X.LEAST).select("star_id", "mission", "start", "end", "n_hits", "label")


simple("a13_embeddings", lambda s, d: written(load(s, d, "embeddings"), "embeddings").select("vec_id", F.size("embedding").alias("d"), F.element_at("embedding", 1).cast("double").alias("x0")), sql("SELECT vec_id, len(embedding) AS d, CAST(embedding[1] AS DOUBLE) AS x0 FROM embeddings", "x0", "d"))
simple("a14_ingest_status", lambda s, d: A.ingest_summary(load(s, d, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).alias("files"), (F.col("o_orderkey") % 100 / 10).alias("seconds"))),
       sql("SELECT o_orderstatus AS status, count(*) AS n, sum(o_orderkey % 3) AS files, round(sum(o_orderkey % 100 / 10e0), 4) AS seconds FROM orders GROUP BY 1", "seconds", "files"))
simple("a15_read_loose_scores", lambda s, d: A.loose_scores(load(s, d, "events").select(F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string"), F.when(F.col("user_id") % 2 == 0, ";x;").otherwise(" \t"), F.when(F.col("event_id") % 10 == 0, "n/a").otherwise((F.col("event_id") % 97).cast("string"))).alias("value"))),
       sql("SELECT 'S' || user_id % 50 AS target, avg(CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 97 AS DOUBLE) END) AS score FROM events WHERE event_id % 10 <> 0 GROUP BY 1", "score"))
simple("a16_quarantine_report", lambda s, d: E.quarantine(E.pool_embeddings(star_vectors(s, d))), sql("SELECT label AS star_id, 'all segments non-finite' AS reason FROM embeddings GROUP BY 1 HAVING label % 5 = 3", ints="star_id"))
simple("a17_skip_ledger", lambda s, d: A.skip_ledger(I.add_star_id(X.catalog(s, d)), X.curves(X.points(s, d)), 60),
       sql("SELECT CASE WHEN star_id IS NULL THEN 'no_id' WHEN n_points IS NULL THEN 'no_curve' WHEN n_points < 60 THEN 'too_short' ELSE 'ok' END AS reason, count(*) AS n FROM named LEFT JOIN (SELECT star_id, n_points FROM curves) USING (star_id) GROUP BY 1", base=f"{PTS}, {CAT}"))

# ---- B: ids and ephemerides --------------------------------------------------------------------------------------------------

simple("b1_add_star_id", lambda s, d: I.add_star_id(X.catalog(s, d)).select("row_id", "star_id", "mission"), sql("SELECT row_id, star_id, mission FROM named", base=CAT))
simple("b2_normalize_star_id", lambda s, d: X.catalog(s, d).select("row_id", I.normalize_star_id(F.col("star_id")).alias("id")), sql("SELECT row_id, regexp_replace(regexp_replace(trim(star_id), '^(KIC|KOI|EPIC|TIC|TOI)[\\s\\-]+', '\\1_'), '__+', '_', 'g') AS id FROM cat", base=CAT))
simple("b3_repair_mission", lambda s, d: X.catalog(s, d).select("row_id", I.repair_mission(I.normalize_star_id(I.clean(F.col("star_id"))), F.col("mission")).alias("mission")), sql("SELECT row_id, coalesce(CASE WHEN starts_with(given, 'EPIC_') THEN 'k2' WHEN starts_with(given, 'TIC_') THEN 'tess' END, m) AS mission FROM ids", base=CAT))
simple("b4_target_and_mission", lambda s, d: I.target_and_mission(X.catalog(s, d)).select("row_id", "target", "target_mission"),
       sql("SELECT row_id, coalesce('KIC ' || CAST(CAST(kepid AS DOUBLE) AS BIGINT), 'EPIC ' || epic, 'TIC ' || tid, 'TOI ' || toi, hostname) AS target, CASE WHEN kepid IS NOT NULL THEN 'Kepler' WHEN epic IS NOT NULL THEN 'K2' WHEN tid IS NOT NULL OR toi IS NOT NULL THEN 'TESS' END AS target_mission FROM cat", base=CAT))
simple("b5_canon_epic", lambda s, d: load(s, d, "customer").select("c_custkey", I.canon_digits(F.col("c_name")).alias("digits")), sql("SELECT c_custkey, regexp_replace(c_name, '\\D+', '', 'g') AS digits FROM customer"))
simple("b6_prepare_ephemeris", lambda s, d: I.prepare_ephemeris(I.add_star_id(X.catalog(s, d))),
       sql(PREPARED := "SELECT DISTINCT * FROM (SELECT star_id, mission, CASE mission WHEN 'tess' THEN pl_orbper ELSE coalesce(pl_orbper, koi_period) END AS period_days, CASE mission WHEN 'tess' THEN pl_tranmid - 2457000 ELSE coalesce(koi_time0bk, pl_tranmid - 2454833) END AS t0_mission, CASE mission WHEN 'tess' THEN coalesce(pl_trandurh, pl_trandur) ELSE coalesce(koi_duration, pl_trandurh, pl_trandur) END / 24 AS duration_days FROM named WHERE star_id IS NOT NULL AND mission IN ('kepler', 'k2', 'tess')) WHERE period_days > 0 AND duration_days > 0 AND duration_days / period_days < 0.2", "period_days t0_mission duration_days", base=CAT))
SIMPLE = "SELECT * FROM (SELECT star_id, mission, CASE WHEN koi_period IS NOT NULL THEN koi_period ELSE pl_orbper END AS period_days, CASE WHEN koi_period IS NOT NULL THEN koi_time0bk ELSE pl_tranmid - CASE WHEN mission = 'tess' THEN 2457000 ELSE 2454833 END END AS t0_mission, coalesce(CASE WHEN koi_period IS NOT NULL THEN koi_duration ELSE coalesce(pl_trandurh, pl_trandur) END, 6) / 24 AS duration_days FROM named) WHERE period_days IS NOT NULL AND t0_mission IS NOT NULL"
simple("b7_simple_ephemeris", lambda s, d: I.simple_ephemeris(I.add_star_id(X.catalog(s, d))),
       sql(SIMPLE, "period_days t0_mission duration_days", base=CAT))
shifted = lambda s, d: X.points(s, d).withColumn("time", F.col("time") + F.when(F.col("mission") == "k2", 2454833.0).when(F.col("mission") == "tess", 50000.0).otherwise(0.0))
simple("b8_guess_time_base", lambda s, d: I.guess_time_base(shifted(s, d)).join(X.ephemeris(s, d), ["star_id", "mission"]).select("star_id", "time_base", I.convert_t0(F.col("t0_mission"), F.col("mission"), F.col("time_base")).alias("t0")),
       sql("SELECT star_id, CASE mission WHEN 'k2' THEN 'BJD' WHEN 'tess' THEN 'UNKNOWN' ELSE 'REDUCED' END AS time_base, t0_mission + CASE WHEN mission = 'k2' THEN 2454833 ELSE 0 END AS t0 FROM eph", "t0", base=PTS))
simple("b9_target_key", lambda s, d: load(s, d, "customer").select("c_custkey", I.target_key(F.concat(F.lit("K/"), F.col("c_mktsegment"), F.lit(" x"))).alias("key")), sql("SELECT c_custkey, translate('K/' || c_mktsegment || ' x', ' /', '__') AS key FROM customer"))
simple("b10_status_ok", lambda s, d: load(s, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "OK").otherwise("error")).where(A.status_ok()).select("o_orderkey"), sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"))
simple("b11_priority", lambda s, d: summary(s, d).select("star_id", I.priority("best", "std").alias("priority")), sql("SELECT star_id, max(p) - 0.5 * stddev_pop(p) AS priority FROM curves LEFT JOIN sco USING (star_id) GROUP BY 1", "priority", base=SCO))
simple("b12_star_label", lambda s, d: R.aggregate_scores(X.scored(s, d), ["star_id"], "max").select("star_id", I.star_label("score", 0.9).alias("star_label")), sql("SELECT star_id, CASE WHEN score_max >= 0.9 THEN 'TRANSIT' ELSE 'NO_TRANSIT' END AS star_label FROM star", base=SCO))
simple("b13_label_column", lambda s, d: load(s, d, "labels").select("doc_id", F.col("toxic").alias("target")).select("doc_id", I.label_column(load(s, d, "labels").select(F.col("toxic").alias("target")))), sql("SELECT doc_id, coalesce(CAST(toxic AS INTEGER), 0) AS label FROM labels", ints="label"))
simple("b14_required_columns", lambda s, d: require_columns(X.scored(s, d), ["star_id", "p", "label"]).select("star_id", "p", "label"), sql("SELECT star_id, p, label FROM sco", "p", "label", base=SCO))

# ---- C: signals ----------------------------------------------------------------------------------------------------------------

MAD = "md AS (SELECT star_id, quantile_cont(flux, 0.5) AS med FROM pts GROUP BY 1), mm AS (SELECT star_id, any_value(med) AS med, quantile_cont(abs(flux - med), 0.5) AS mad, stddev_pop(flux) AS sd FROM pts JOIN md USING (star_id) GROUP BY 1)"
simple("c1_mad_normalize", lambda s, d: C.mad_normalize(X.points(s, d), ["star_id"], clip=5.0).select("star_id", "idx", "norm"), sql("SELECT star_id, idx, greatest(least((flux - med) / (mad + 1e-6), 5), -5) AS norm FROM pts JOIN mm USING (star_id)", "norm", base=f"{PTS}, {MAD}"))
simple("c2_robust_scale", lambda s, d: C.robust_scale(X.points(s, d), ["star_id"]).select("star_id", "idx", "scaled"), sql("SELECT star_id, idx, (flux - med) / (sd + 1e-8) AS scaled FROM pts JOIN mm USING (star_id)", "scaled", base=f"{PTS}, {MAD}"))
simple("c3_drop_nan_and_rescale", lambda s, d: C.drop_nan_and_rescale(X.points(s, d).withColumn("flux", F.when(F.col("idx") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("flux")))).select("star_id", "idx", "relative"),
       sql("SELECT star_id, row_number() OVER (PARTITION BY star_id ORDER BY idx) - 1 AS idx, flux / quantile_cont(flux, 0.5) OVER (PARTITION BY star_id) AS relative FROM pts WHERE idx % 7 <> 3", "relative", base=PTS))
simple("c4_detrend", lambda s, d: C.detrend(X.points(s, d), 21).select("star_id", "idx", "trend", "flat"),
       sql("SELECT star_id, idx, t AS trend, CASE WHEN abs(t) > 1e-12 THEN flux / t ELSE flux END AS flat FROM (SELECT *, (b0 * (m2 * m4 - m3 * m3) - m1 * (b1 * m4 - b2 * m3) + m2 * (b1 * m3 - b2 * m2)) / (n * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2)) AS t FROM (SELECT a.star_id, a.idx, a.flux, CAST(count(*) AS DOUBLE) AS n, CAST(sum(b.idx - a.idx) AS DOUBLE) AS m1, CAST(sum((b.idx - a.idx) ** 2) AS DOUBLE) AS m2, CAST(sum((b.idx - a.idx) ** 3) AS DOUBLE) AS m3, CAST(sum((b.idx - a.idx) ** 4) AS DOUBLE) AS m4, sum(b.flux) AS b0, sum(b.flux * (b.idx - a.idx)) AS b1, sum(b.flux * (b.idx - a.idx) ** 2) AS b2 FROM pts a JOIN pts b ON a.star_id = b.star_id AND b.idx BETWEEN a.idx - 10 AND a.idx + 10 GROUP BY 1, 2, 3))", "trend flat", base=PTS))
MASKED = "SELECT star_id, idx, flux, m, CASE WHEN abs(d) > 1e-9 THEN (b0 * (m2 * m4 - m3 * m3) - m1 * (b1 * m4 - b2 * m3) + m2 * (b1 * m3 - b2 * m2)) / d END AS t FROM (SELECT *, n * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2) AS d FROM (SELECT a.star_id, a.idx, a.flux, a.m, CAST(count(*) FILTER (b.m) AS DOUBLE) AS n, CAST(sum(b.idx - a.idx) FILTER (b.m) AS DOUBLE) AS m1, CAST(sum((b.idx - a.idx) ** 2) FILTER (b.m) AS DOUBLE) AS m2, CAST(sum((b.idx - a.idx) ** 3) FILTER (b.m) AS DOUBLE) AS m3, CAST(sum((b.idx - a.idx) ** 4) FILTER (b.m) AS DOUBLE) AS m4, sum(b.flux) FILTER (b.m) AS b0, sum(b.flux * (b.idx - a.idx)) FILTER (b.m) AS b1, sum(b.flux * (b.idx - a.idx) ** 2) FILTER (b.m) AS b2 FROM {src} a JOIN {src} b ON a.star_id = b.star_id AND b.idx BETWEEN a.idx - 10 AND a.idx + 10 GROUP BY 1, 2, 3, 4))"
CLIP = "SELECT star_id, idx, flux, m AND coalesce(abs(flux - t) <= 1.5e0 * sd, true) AS m FROM (SELECT *, stddev_pop(flux - t) FILTER (m) OVER (PARTITION BY star_id) AS sd FROM {src})"
ROUNDS = f"r0 AS (SELECT star_id, idx, flux, true AS m FROM pts), f0 AS MATERIALIZED ({MASKED.format(src='r0')}), r1 AS MATERIALIZED ({CLIP.format(src='f0')}), f1 AS MATERIALIZED ({MASKED.format(src='r1')}), r2 AS MATERIALIZED ({CLIP.format(src='f1')})"
simple("c4_detrend_clipped", lambda s, d: C.detrend(X.points(s, d), 21, clip_rounds=2, sigma=1.5).select("star_id", "idx", "trend", "flat"),
       sql(f"SELECT star_id, idx, t AS trend, CASE WHEN abs(t) > 1e-12 THEN flux / t ELSE flux END AS flat FROM ({MASKED.format(src='r2')})", "trend flat", base=f"{PTS}, {ROUNDS}"))
simple("c5_raw_plus_flat", lambda s, d: C.detrend(X.points(s, d), 21).groupBy("star_id").agg(F.count("flux").alias("n_raw"), F.count("flat").alias("n_flat")), sql("SELECT star_id, count(*) AS n_raw, count(*) AS n_flat FROM pts GROUP BY 1", base=PTS))
simple("c6_diff_channel", lambda s, d: C.diff_channel(X.window_points(s, d)).select("star_id", "start", "idx", "ch1"), sql("SELECT star_id, start, idx, coalesce(flux - lag(flux) OVER (PARTITION BY star_id, start ORDER BY idx), 0) AS ch1 FROM wp", "ch1", base=LAB))
simple("c7_adapt_channels", lambda s, d: C.adapt_channels(C.adapt_channels(X.window_points(s, d), 1, 2), 2, 1).groupBy("star_id").agg(F.count("*").alias("n")), sql("SELECT star_id, count(*) AS n FROM wp GROUP BY 1", base=LAB))
simple("c8_clean_window", lambda s, d: X.window_points(s, d).select("star_id", "start", "idx", C.clean_window(F.when(F.col("idx") % 9 == 4, F.lit(float("inf"))).otherwise(F.col("flux"))).alias("x")), sql("SELECT star_id, start, idx, CASE WHEN idx % 9 = 4 THEN 0 ELSE greatest(least(flux, 10), -10) END AS x FROM wp", "x", base=LAB))
simple("c9_center_window", lambda s, d: C.center_window(X.window_points(s, d)).select("star_id", "start", "idx", "centered"), sql("SELECT star_id, start, idx, flux - quantile_cont(flux, 0.5) OVER (PARTITION BY star_id, start) AS centered FROM wp", "centered", base=LAB))
U = lambda name: f"(CAST(('0x' || substr(md5('s-{name}|' || star_id), 1, 8)) AS BIGINT) / 4294967296e0)"
simple("c10_inject_box_transits", lambda s, d: C.inject_box_transits(X.points(s, d), "s", 1.0).select("star_id", "idx", "injected", "flux"),
       sql("SELECT star_id, idx, h AS injected, flux - h * ppm AS flux FROM (SELECT *, CASE WHEN b > a AND abs(((time - t0 + per / 2) - per * floor((time - t0 + per / 2) / per)) - per / 2) <= dur / 2 THEN 1 ELSE 0 END AS h FROM (SELECT *, a + u0 * least(b - a, per) AS t0 FROM (SELECT *, min(time) OVER w AS a, max(time) OVER w AS b, 0.7e0 + " + U("period") + " * 19.3e0 AS per, (1 + " + U("hours") + " * 5) / 24 AS dur, 200 + " + U("ppm") + " * 3800 AS ppm, " + U("t0") + " AS u0 FROM pts WINDOW w AS (PARTITION BY star_id))))", "flux", "injected", base=PTS))
simple("c11_min_center_crop", lambda s, d: C.min_center_crop(X.window_points(s, d), 8).select("star_id", "start", "crop_pos", "flux"),
       sql("SELECT star_id, start, idx - start - l AS crop_pos, flux FROM (SELECT *, greatest(least(first_value(idx - start) OVER (PARTITION BY star_id, start ORDER BY flux, idx) - 4, 8), 0) AS l FROM wp) WHERE idx - start >= l AND idx - start < l + 8", "flux", base=LAB))
simple("c12_center_crop_bin_mean", lambda s, d: C.center_crop_bin_mean(X.window_points(s, d), 10, 3), sql("SELECT star_id, mission, start, (idx - start - 3) // 3 AS bin, avg(flux) AS mean FROM wp WHERE idx - start >= 3 AND idx - start < 12 GROUP BY 1, 2, 3, 4", "mean", base=LAB))
simple("c13_mad_clip", lambda s, d: C.mad_clip(X.points(s, d), ["star_id"], k=1.0).select("star_id", "idx", "clipped"), sql("SELECT star_id, idx, greatest(least(flux, med + mad + 1e-6), med - mad - 1e-6) AS clipped FROM pts JOIN mm USING (star_id)", "clipped", base=f"{PTS}, {MAD}"))
simple("c14_residual", lambda s, d: C.mad_clip(X.points(s, d), ["star_id"], k=1.0).select("star_id", "idx", (F.col("flux") - F.col("clipped")).alias("residual")), sql("SELECT star_id, idx, flux - greatest(least(flux, med + mad + 1e-6), med - mad - 1e-6) AS residual FROM pts JOIN mm USING (star_id)", "residual", base=f"{PTS}, {MAD}"))

# ---- D: windows ------------------------------------------------------------------------------------------------------------------

curves = lambda s, d: X.curves(X.points(s, d))
simple("d1_make_segments", lambda s, d: W.make_segments(curves(s, d), 32, 8), sql('SELECT star_id, mission, start, start + 32 AS "end" FROM (SELECT star_id, mission, unnest(range(0, n_points - 32 + 1, 8)) AS start FROM curves WHERE n_points >= 32)', base=PTS))
simple("d2_tumbling_segments", lambda s, d: W.tumbling_segments(curves(s, d), 16), sql('SELECT star_id, mission, start, start + 16 AS "end" FROM (SELECT star_id, mission, unnest(range(0, n_points - 16, 16)) AS start FROM curves WHERE n_points >= 16)', base=PTS))
simple("d3_count_windows", lambda s, d: curves(s, d).select("star_id", W.count_windows(F.col("n_points"), 64, 8).alias("n")), sql("SELECT star_id, CASE WHEN n_points >= 64 THEN 1 + (n_points - 64) // 8 ELSE 0 END AS n FROM curves", ints="n", base=PTS))
simple("d4_mission_segments", lambda s, d: W.mission_segments(X.ephemeris(s, d), curves(s, d), "k2", 16, 4), sql("SELECT star_id, mission, start, start + 16 AS \"end\" FROM seg WHERE mission = 'k2' AND star_id IN (SELECT star_id FROM eph)", base=PTS))
simple("d5_slice_segment", lambda s, d: W.slice_padded(X.points(s, d), W.make_segments(curves(s, d).withColumn("n_points", F.col("n_points") + 3), 16, 16)).groupBy("star_id", "start").agg(F.count("*").alias("n"), F.sum("flux").alias("total")),
       sql("SELECT s.star_id, s.start, CAST(16 AS BIGINT) AS n, coalesce(sum(flux), 0) AS total FROM (SELECT star_id, unnest(range(0, n_points + 3 - 16 + 1, 16)) AS start FROM curves WHERE n_points + 3 >= 16) s LEFT JOIN pts p ON p.star_id = s.star_id AND p.idx >= s.start AND p.idx < s.start + 16 GROUP BY 1, 2", "total", base=PTS))
simple("d6_windows_from_meta", lambda s, d: X.window_points(s, d).select("star_id", "start", "idx", "flux"), sql("SELECT star_id, start, idx, flux FROM wp", "flux", base=LAB))
simple("d7_segment_times", lambda s, d: W.segment_times(X.window_points(s, d)), sql("SELECT star_id, mission, start, quantile_cont(time, 0.5) AS seg_mid_time, min(time) AS t_first, max(time) AS t_last FROM wp GROUP BY 1, 2, 3", "seg_mid_time t_first t_last", base=LAB))
simple("d8_filter_segments", lambda s, d: W.filter_segments(X.window_points(s, d), least_abs=40.0), sql("SELECT * FROM (SELECT star_id, mission, start, avg(CASE WHEN flux = 0 THEN 1e0 ELSE 0e0 END) AS zero_share, avg(abs(flux)) AS mean_abs FROM wp GROUP BY 1, 2, 3) WHERE zero_share <= 0.5 AND mean_abs >= 40", "zero_share mean_abs", base=LAB))
simple("d9_window_plan", lambda s, d: W.window_plan(curves(s, d), 64, 8), sql("SELECT mission, count(*) AS n_stars, sum(n) AS n_windows, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS n_short FROM (SELECT mission, CASE WHEN n_points >= 64 THEN 1 + (n_points - 64) // 8 ELSE 0 END AS n FROM curves) GROUP BY ROLLUP (mission)", ints="n_windows n_short", base=PTS))
simple("d10_bounds_filter", lambda s, d: W.slice_skipping(W.make_segments(curves(s, d).withColumn("n_points", F.col("n_points") + 9), 16, 4), curves(s, d), 16), sql('SELECT star_id, mission, start, start + 16 AS "end" FROM seg', base=PTS))

# ---- E: labels -------------------------------------------------------------------------------------------------------------------

times = lambda s, d: W.segment_times(X.window_points(s, d))
TIMES = f"{LAB}, tm AS (SELECT star_id, mission, start, min(time) AS a, max(time) AS b FROM wp GROUP BY 1, 2, 3)"
simple("e1_in_transit", lambda s, d: X.points(s, d).join(X.ephemeris(s, d), ["star_id", "mission"]).select("star_id", "idx", W.in_transit(F.col("time"), F.col("t0_mission"), F.col("period_days"), F.col("duration_days")).cast("int").alias("hit")), sql(f"SELECT p.star_id, p.idx, {X.HIT} AS hit FROM pts p JOIN eph e ON p.star_id = e.star_id AND p.mission = e.mission", ints="hit", base=PTS))
simple("e2_in_transit_any", lambda s, d: W.in_transit_any(X.points(s, d), X.ephemeris(s, d, True)), sql(f"SELECT p.star_id, p.mission, p.idx, max(coalesce({X.HIT}, 0)) AS hit FROM pts p LEFT JOIN eph2 e ON p.star_id = e.star_id AND p.mission = e.mission GROUP BY 1, 2, 3", ints="hit", base=PTS))
simple("e3_label_by_count", lambda s, d: X.labelled(s, d).select("star_id", "mission", "start", "end", "n_hits", "label"), sql("SELECT * FROM lab", ints="label", base=LAB))
simple("e4_attach_labels", lambda s, d: W.attach_labels(W.make_segments(curves(s, d), 16, 4), (lab := X.labelled(s, d).where("label = 1 or start % 8 = 0")).unionByName(lab).select("star_id", "mission", "start", "end", "label")), sql('SELECT star_id, mission, start, "end", label FROM lab', ints="label", base=LAB))
simple("e5_label_by_overlap", lambda s, d: W.label_by_overlap(times(s, d), X.ephemeris(s, d)), sql("SELECT t.star_id, t.mission, t.start, max(CASE WHEN ceil((a - 1.5 * duration_days - t0_mission) / period_days) <= floor((b + 1.5 * duration_days - t0_mission) / period_days) THEN 1 ELSE 0 END) AS label FROM tm t LEFT JOIN eph e ON t.star_id = e.star_id AND t.mission = e.mission GROUP BY 1, 2, 3", ints="label", base=TIMES))
simple("e6_label_centered", lambda s, d: W.label_centered(times(s, d), X.ephemeris(s, d)),
       sql("SELECT star_id, mission, start, max(CASE WHEN abs(t - (a + b) / 2) <= 0.15 * (b - a) / 2 AND least(b, t + duration_days / 2) - greatest(a, t - duration_days / 2) >= 0.7 * duration_days THEN 1 ELSE 0 END) AS label FROM (SELECT t.star_id, t.mission, t.start, a, b, duration_days, t0_mission + round_even(((a + b) / 2 - t0_mission) / period_days, 0) * period_days AS t FROM tm t LEFT JOIN eph e ON t.star_id = e.star_id AND t.mission = e.mission) GROUP BY 1, 2, 3", ints="label", base=TIMES))
simple("e7_star_label", lambda s, d: W.star_labels(X.labelled(s, d)), sql("SELECT star_id, max(label) AS label_star FROM lab GROUP BY 1", ints="label_star", base=LAB))
simple("e8_confidence_weight", lambda s, d: W.confidence_weight(X.labelled(s, d), X.ephemeris(s, d)).select("star_id", "start", "weight"), sql("SELECT star_id, start, CASE WHEN star_id IN (SELECT star_id FROM eph) THEN 1.0 ELSE 0.3 END AS weight FROM lab", "weight", base=LAB))
simple("e9_label_diagnostic", lambda s, d: W.label_diagnostic(X.labelled(s, d)), sql("SELECT label, count(*) AS n, avg(n_hits) AS mean, stddev_samp(n_hits) AS std, min(n_hits) AS lo, quantile_cont(n_hits, 0.25) AS q25, quantile_cont(n_hits, 0.5) AS q50, quantile_cont(n_hits, 0.75) AS q75, max(n_hits) AS hi FROM lab GROUP BY 1", "mean std q25 q50 q75", "label", base=LAB))

# ---- F: joins --------------------------------------------------------------------------------------------------------------------

simple("f1_left_join", lambda s, d: W.make_segments(curves(s, d), 16, 4).join(X.labelled(s, d).where("label = 1").select("star_id", "mission", "start", "end", "label"), ["star_id", "mission", "start", "end"], "left"), sql('SELECT star_id, mission, start, "end", CASE WHEN label = 1 THEN 1 END AS label FROM lab', ints="label", base=LAB))
simple("f2_star_planet_join", lambda s, d: curves(s, d).join(X.ephemeris(s, d, True), ["star_id", "mission"]).select("star_id", "n_points", "period_days"), sql("SELECT star_id, n_points, period_days FROM curves JOIN (SELECT star_id, mission, period_days FROM eph2) USING (star_id, mission)", "period_days", base=PTS))
simple("f3_interval_join", lambda s, d: times(s, d).join(X.ephemeris(s, d), ["star_id", "mission"]).where(W.overlaps_transit(F.col("t_first"), F.col("t_last"), F.col("t0_mission"), F.col("period_days"), F.col("duration_days"), 0.5)).select("star_id", "start"), sql("SELECT t.star_id, t.start FROM tm t JOIN eph e ON t.star_id = e.star_id AND t.mission = e.mission WHERE ceil((a - 0.5 * duration_days - t0_mission) / period_days) <= floor((b + 0.5 * duration_days - t0_mission) / period_days)", base=TIMES))
simple("f4_semi_join", lambda s, d: X.labelled(s, d).join(X.ephemeris(s, d).where("mission = 'tess'"), "star_id", "left_semi").select("star_id", "start"), sql("SELECT star_id, start FROM lab WHERE star_id IN (SELECT star_id FROM eph WHERE mission = 'tess')", base=LAB))
simple("f5_anti_join", lambda s, d: X.labelled(s, d).join(X.ephemeris(s, d), "star_id", "left_anti").select("star_id", "start"), sql("SELECT star_id, start FROM lab WHERE star_id NOT IN (SELECT star_id FROM eph)", base=LAB))
simple("f6_embedding_scores", lambda s, d: load(s, d, "embeddings").select(F.col("vec_id").alias("k"), "label").join(R.aggregate_scores(X.scored(s, d), ["star_id"], "mean").select(F.regexp_extract("star_id", r"_(\d+)$", 1).cast("bigint").alias("k"), "score"), "k"), sql("SELECT e.vec_id AS k, e.label, s.score FROM embeddings e JOIN (SELECT CAST(regexp_extract(star_id, '_(\\d+)$', 1) AS BIGINT) AS k, avg(p) AS score FROM sco GROUP BY 1) s ON e.vec_id = s.k", "score", "label", base=SCO))
simple("f7_lookup_join", lambda s, d: curves(s, d).drop("mission").join(X.ephemeris(s, d).select("star_id", "mission"), "star_id", "left").select("star_id", F.coalesce("mission", F.lit("unknown")).alias("mission")), sql("SELECT c.star_id, coalesce(e.mission, 'unknown') AS mission FROM curves c LEFT JOIN eph e ON c.star_id = e.star_id", base=PTS))
simple("f8_two_table_join", lambda s, d: load(s, d, "orders").join(load(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n")), sql("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"))
simple("f9_one_pass_star_table", lambda s, d: R.star_scores(X.scored(s, d)), sql("SELECT * FROM star", "score_max top_mean top_median share_high", "y_star", base=SCO))
simple("f10_key_join", lambda s, d: X.scored(s, d).select("star_id", "start", "p").join(C.center_window(X.window_points(s, d)).groupBy("star_id", "start").agg(F.min("centered").alias("lo")), ["star_id", "start"]), sql("SELECT star_id, start, p, lo FROM sco JOIN (SELECT star_id, start, min(flux) - quantile_cont(flux, 0.5) AS lo FROM wp GROUP BY 1, 2) USING (star_id, start)", "p lo", base=SCO))

# ---- G: aggregations --------------------------------------------------------------------------------------------------------------

simple("g1_topk_mean", lambda s, d: R.aggregate_scores(X.scored(s, d), ["star_id"], "topk_mean", 5), sql("SELECT star_id, avg(p) AS score FROM rk WHERE r <= 5 GROUP BY 1", "score", base=SCO))
simple("g2_star_scores", lambda s, d: R.star_scores(X.scored(s, d)).select("star_id", "y_star", "score_max", "top_mean", "top_median", "n"), sql("SELECT star_id, y_star, score_max, top_mean, top_median, n FROM star", "score_max top_mean top_median", "y_star", base=SCO))
simple("g3_score_fused", lambda s, d: R.star_scores(X.scored(s, d)).select("star_id", R.score_fused().alias("score_fused")), sql("SELECT star_id, top_median + 0.10 * share_high - 0.20 * (score_max - top_mean) AS score_fused FROM star", "score_fused", base=SCO))


def summary(s, d):
    return R.score_summary(X.curves(X.points(s, d)), X.scored(s, d), X.WINDOW)


SUMM = f"{SCO}, summ AS (SELECT c.star_id, c.mission, c.n_points, count(p) AS n_segments, max(p) AS best, avg(p) AS mean, quantile_cont(p, 0.5) AS median, stddev_pop(p) AS std, quantile_cont(p, 0.95) AS p95, arg_min(start, -p * 1000000 + start / 1e6) AS best_start FROM curves c LEFT JOIN sco USING (star_id) GROUP BY 1, 2, 3)"
simple("g4_score_summary", summary, sql("SELECT *, best_start + 16 AS best_end, CASE WHEN n_points < 16 THEN 'too_short_or_missing' WHEN n_segments = 0 THEN 'no_segments' ELSE 'ok' END AS status FROM summ", "best mean median std p95", base=SUMM))
timed = lambda s, d: X.scored(s, d).join(W.segment_times(X.window_points(s, d)).select("star_id", "mission", "start", "t_first", "t_last"), ["star_id", "mission", "start"])
NUMBERS = "best_seg_score mean_seg_score median_seg_score std_seg_score p95_seg_score best_t0 best_t1"
ROWS = """SELECT c.star_id, c.mission, c.n_points, count(p) AS n_segments, max(p) AS best_seg_score, avg(p) AS mean_seg_score, {q50} AS median_seg_score, stddev_pop(p) AS std_seg_score, {q95} AS p95_seg_score,
CASE WHEN c.n_points < 16 THEN 'too_short_or_missing' WHEN count(p) = 0 THEN 'no_segments' ELSE 'ok' END AS status, '' AS error, coalesce(any_value(start) FILTER (r = 1) // 4, -1) AS best_seg_idx, coalesce(any_value(start) FILTER (r = 1), -1) AS best_start, coalesce(any_value(start) FILTER (r = 1) + 16, -1) AS best_end, any_value(a) FILTER (r = 1) AS best_t0, any_value(b) FILTER (r = 1) AS best_t1
FROM curves c LEFT JOIN (SELECT rk.star_id, start, p, r, a, b FROM rk JOIN (SELECT star_id, start, min(time) AS a, max(time) AS b FROM wp GROUP BY 1, 2) USING (star_id, start)) x ON x.star_id = c.star_id GROUP BY 1, 2, 3"""
simple("g4_score_rows", lambda s, d: R.score_rows(X.curves(X.points(s, d)), timed(s, d), X.WINDOW, X.STRIDE), sql(ROWS.format(q50="quantile_cont(p, 0.5)", q95="quantile_cont(p, 0.95)"), NUMBERS, "best_seg_idx best_start best_end", base=SCO))
simple("g5_triage_scores", lambda s, d: T.triage_table(X.scored(s, d)).select("star_id", "n_segments", "best_segment_score", "topN_mean", "topN_std", "consistency_score", "mission"), sql("SELECT star_id, count(*) AS n_segments, max(p) AS best_segment_score, avg(p) FILTER (r <= 10) AS \"topN_mean\", stddev_pop(p) FILTER (r <= 10) AS \"topN_std\", avg(p) FILTER (r <= 10) - stddev_pop(p) FILTER (r <= 10) AS consistency_score, min(mission) AS mission FROM rk GROUP BY 1", "best_segment_score topN_mean topN_std consistency_score", base=SCO))
simple("g6_split_summary", lambda s, d: R.split_summary(X.labelled(s, d).withColumnRenamed("mission", "split")), sql("SELECT mission AS split, count(*) AS n, sum(label) AS n_pos, avg(label) AS pos_share, count(DISTINCT star_id) AS n_stars FROM lab GROUP BY 1", "pos_share", "n_pos", base=LAB))
DESC = "count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS lo, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS hi"
simple("g7_describe", lambda s, d: R.describe(X.scored(s, d), "p"), sql(f"SELECT {DESC.format(c='p')} FROM sco", "mean std lo q25 q50 q75 hi", base=SCO))
simple("g8_quantiles", lambda s, d: R.quantiles(X.scored(s, d), "p", [0.5, 0.9, 0.99]), sql("SELECT unnest([0.5e0, 0.9e0, 0.99e0]) AS q, unnest(quantile_cont(p, [0.5, 0.9, 0.99])) AS value FROM sco", "q value", base=SCO))


@query("g8_quantiles_by_sketch", sql("SELECT unnest([0.1e0, 0.5e0, 0.9e0, 0.99e0]) AS q, true AS within", "q"))
def _(s, d):
    """Whether quantiles of all prices, from sketches by return flag that were stored and merged, have ranks within 0.001."""
    prices = load(s, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    stored = written(prices.groupBy("l_returnflag").agg(quantile_sketch(F.col("v")).alias("sketch")), "sketches")
    merged = stored.agg(merge_sketches("sketch").alias("sketch"))
    values = merged.select(F.explode(F.array(*(F.struct(F.lit(q).alias("q"), sketch_quantile(F.col("sketch"), q).alias("value")) for q in (0.1, 0.5, 0.9, 0.99)))).alias("x")).select("x.q", "x.value")
    share = lambda c: F.avg(c.cast("double"))
    ranks = prices.crossJoin(F.broadcast(values)).groupBy("q").agg(share(F.col("v") < F.col("value")).alias("below"), share(F.col("v") <= F.col("value")).alias("upto"))
    return ranks.select("q", ((F.col("below") - 0.001 <= F.col("q")) & (F.col("q") <= F.col("upto") + 0.001)).alias("within"))


simple("g9_threshold_from_percentile", lambda s, d: T.threshold_from_percentile(X.scored(s, d)), sql("SELECT quantile_cont(p, 0.99) AS threshold FROM sco", "threshold", base=SCO))
simple("g10_mean_per_key", lambda s, d: R.aggregate_scores(X.scored(s, d), ["star_id"], "mean"), sql("SELECT star_id, avg(p) AS score FROM sco GROUP BY 1", "score", base=SCO))
simple("g11_mode", lambda s, d: R.mode_or_first(load(s, d, "events"), "user_id", "event_type"), sql("SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) = 1"))
simple("g12_depth_by_label", lambda s, d: R.depth_by_label(X.window_points(s, d).join(X.labelled(s, d).select("star_id", "start", "label"), ["star_id", "start"])), sql("SELECT label, quantile_cont(q, 0.5) AS q05_median, avg(q) AS q05_mean, quantile_cont(m, 0.5) AS min_median, avg(m) AS min_mean FROM (SELECT star_id, start, quantile_cont(flux, 0.05) AS q, min(flux) AS m FROM wp GROUP BY 1, 2) JOIN lab USING (star_id, start) GROUP BY 1", "q05_median q05_mean min_median min_mean", "label", base=LAB))
simple("g12_deepest_positives", lambda s, d: R.deepest_positives(X.window_points(s, d).join(X.labelled(s, d).select("star_id", "start", "label"), ["star_id", "start"])).select(*KEYS, "q05"), sql("SELECT star_id, start, quantile_cont(flux, 0.05) AS q05 FROM wp JOIN (SELECT star_id, start FROM lab WHERE label = 1) USING (star_id, start) GROUP BY star_id, mission, start ORDER BY q05, star_id, mission, start LIMIT 12", "q05", base=LAB))
simple("g13_channel_health", lambda s, d: R.channel_health(X.scored(s, d), "p"), sql("SELECT avg(p) AS mean, stddev_pop(p) AS std, avg(CASE WHEN abs(p) <= 1e-3 THEN 1e0 ELSE 0e0 END) AS near_zero, avg(CASE WHEN abs(p - 1) <= 1e-3 THEN 1e0 ELSE 0e0 END) AS near_one FROM sco", "mean std near_zero near_one", base=SCO))
simple("g14_tensor_sanity", lambda s, d: R.tensor_sanity(X.window_points(s, d)), sql("SELECT min(z) AS z_min, avg(z) AS z_mean, max(z) AS z_max, min(e) AS e_min, avg(e) AS e_mean, max(e) AS e_max, (SELECT stddev_pop(flux) FROM wp) AS std FROM (SELECT avg(CASE WHEN flux = 0 THEN 1e0 ELSE 0e0 END) AS z, avg(abs(flux)) AS e FROM wp GROUP BY star_id, start)", "z_min z_mean z_max e_min e_mean e_max std", base=LAB))
simple("g15_star_counts", lambda s, d: R.star_counts(X.labelled(s, d)), sql("SELECT count(*) AS n_stars, max(c) AS most FROM (SELECT star_id, count(*) AS c FROM lab GROUP BY 1)", base=LAB))
simple("g16_histogram", lambda s, d: R.histogram(X.scored(s, d), "p", 50, 0.0, 1.0), sql("SELECT least(CAST(floor(p * 50) AS BIGINT) + 1, 50) AS bin, count(*) AS n FROM sco GROUP BY 1", ints="bin", base=SCO))

# ---- H: rankings ------------------------------------------------------------------------------------------------------------------

KEYS = ("star_id", "start")
MD5 = "md5('{seed}|' || star_id || '|' || start)"
simple("h1_cap_per_star", lambda s, d: R.cap_per_star(X.labelled(s, d), 6, "h").select(*KEYS, "label"), sql("SELECT star_id, start, label FROM (SELECT *, row_number() OVER (PARTITION BY star_id, label ORDER BY " + MD5.format(seed="h") + ") AS n, least(sum(label) OVER (PARTITION BY star_id), 3) AS pos FROM lab) WHERE CASE WHEN label = 1 THEN n <= pos ELSE n <= 6 - pos END", ints="label", base=LAB))
simple("h2_head_per_group", lambda s, d: R.head_per_group(X.scored(s, d), ["star_id"], 3, 40).select(*KEYS, "p"), sql("SELECT star_id, start, p FROM rk WHERE r <= 3 ORDER BY p DESC, star_id, start LIMIT 40", "p", base=SCO))
simple("h3_nlargest", lambda s, d: R.nlargest(X.scored(s, d), 25).select(*KEYS, "p"), sql("SELECT star_id, start, p FROM sco ORDER BY p DESC, star_id, start LIMIT 25", "p", base=SCO))
simple("h4_star_ranked_hard_negatives", lambda s, d: R.star_ranked_hard_negatives(X.scored(s, d), 10, 60).select(*KEYS, "p"), sql("SELECT star_id, start, p FROM sco WHERE label = 0 AND star_id IN (SELECT star_id FROM star WHERE y_star = 0 ORDER BY round(top_mean, 9) DESC, star_id LIMIT 10) ORDER BY p DESC, star_id, start LIMIT 60", "p", base=SCO))
simple("h5_hard_negative_bank", lambda s, d: R.hard_negative_bank(X.scored(s, d), 3, 200, 50).select(*KEYS, "p"), sql("SELECT star_id, start, p FROM (SELECT * FROM rk WHERE r <= 3 AND star_id IN (SELECT star_id FROM star WHERE y_star = 0) ORDER BY p DESC, star_id, start LIMIT 200) ORDER BY p DESC, star_id, start LIMIT 50", "p", base=SCO))
simple("h6_mine_hard_negatives", lambda s, d: R.mine_hard_negatives(X.scored(s, d), 4, 100, 30, "m").select(*KEYS, "p"), sql("SELECT star_id, start, p FROM (SELECT * FROM (SELECT *, " + MD5.format(seed="m") + " AS k, row_number() OVER (PARTITION BY star_id ORDER BY " + MD5.format(seed="m") + ") AS n FROM sco WHERE label = 0) WHERE n <= 4 ORDER BY k LIMIT 100) ORDER BY p DESC, star_id, start LIMIT 30", "p", base=SCO))
simple("h7_precision_at_k", lambda s, d: R.precision_at(X.scored(s, d).withColumn("t", F.concat_ws("|", "star_id", F.lpad(F.col("start").cast("string"), 6, "0"))), [10, 50, 100], "p", "label", "t"), sql("SELECT k, count(*) AS n, avg(label) AS precision, avg(label) / (SELECT avg(label) FROM sco) AS lift FROM (SELECT *, row_number() OVER (ORDER BY p DESC, star_id || '|' || lpad(CAST(start AS VARCHAR), 6, '0')) AS g FROM sco), (SELECT unnest([10, 50, 100]) AS k) WHERE g <= k GROUP BY 1", "precision lift", "k", base=SCO))
simple("h8_false_positive_windows", lambda s, d: R.false_positive_windows(X.scored(s, d), 5, 40).select(*KEYS, "p"), sql("SELECT star_id, start, p FROM sco WHERE star_id IN (SELECT star_id FROM star WHERE y_star = 0 ORDER BY score_max DESC, star_id LIMIT 5) ORDER BY p DESC, star_id, start LIMIT 40", "p", base=SCO))
simple("h9_gallery_rows", lambda s, d: R.gallery_rows(X.scored(s, d), 5).select("category", *KEYS, "p"), sql("SELECT * FROM (SELECT 'hard_negative' AS category, star_id, start, p FROM sco WHERE label = 0 ORDER BY p DESC, star_id, start LIMIT 5) UNION ALL SELECT * FROM (SELECT 'true_positive', star_id, start, p FROM sco WHERE label = 1 ORDER BY p DESC, star_id, start LIMIT 5) UNION ALL SELECT * FROM (SELECT 'false_negative', star_id, start, p FROM sco WHERE label = 1 ORDER BY p, star_id, start LIMIT 5)", "p", base=SCO))
simple("h10_star_top_windows", lambda s, d: R.star_top_windows(X.scored(s, d), F.lit("EPIC_1"), 12).select(*KEYS, "p"), sql("SELECT star_id, start, p FROM rk WHERE star_id = 'EPIC_1' AND r <= 12", "p", base=SCO))
simple("h11_vetting_lists", lambda s, d: R.vetting_lists(summary(s, d), 13, 8).select("list", "star_id", "best", "priority"), sql("SELECT * FROM (SELECT 'normal' AS list, star_id, best, best - 0.5 * std AS priority FROM summ WHERE n_segments BETWEEN 1 AND 13 ORDER BY priority DESC, best DESC, star_id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'long', star_id, best, best - 0.5 * std FROM summ WHERE n_segments > 13 ORDER BY best DESC, star_id LIMIT 8)", "best priority", base=SUMM))
simple("h12_keep_first", lambda s, d: A.keep_first(load(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"), sql("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1"))
simple("h13_running_sum", lambda s, d: C.diff_channel(X.window_points(s, d)).groupBy("star_id", "start").agg(F.sum("ch1").alias("drift")), sql("SELECT star_id, start, arg_max(flux, idx) - arg_min(flux, idx) AS drift FROM wp GROUP BY 1, 2", "drift", base=LAB))
simple("h14_top_strings", lambda s, d: R.top_strings(X.scored(s, d)), sql("SELECT star_id, string_agg(printf('%.4f', p), ',' ORDER BY r) AS top_scores, string_agg(printf('%.6f', seg_mid_time), ',' ORDER BY r) AS top_times FROM rk WHERE r <= 5 GROUP BY 1", base=SCO))

# ---- I, J: sets, samples, splits ---------------------------------------------------------------------------------------------------

simple("i1_union_all", lambda s, d: X.labelled(s, d).where("label = 1").select(*KEYS, "label").unionByName(X.labelled(s, d).where("label = 0").select(*KEYS), allowMissingColumns=True), sql("SELECT star_id, start, CASE WHEN label = 1 THEN 1 END AS label FROM lab", ints="label", base=LAB))
HALVES = "halves AS (SELECT star_id, CASE WHEN start % 8 = 0 THEN 'train' ELSE 'val' END AS split FROM lab)"
simple("i2_split_overlap", lambda s, d: S.split_overlap(X.labelled(s, d).withColumn("split", F.when(F.col("start") % 8 == 0, "train").otherwise("val"))), sql("SELECT 'train' AS a, 'val' AS b, count(*) AS n_shared FROM (SELECT star_id FROM halves GROUP BY 1 HAVING count(DISTINCT split) = 2)", base=f"{LAB}, {HALVES}"))
simple("i3_distinct", lambda s, d: X.labelled(s, d).select("star_id", "mission").distinct(), sql("SELECT DISTINCT star_id, mission FROM lab", base=LAB))
simple("i4_except", lambda s, d: curves(s, d).select("star_id").subtract(X.ephemeris(s, d).select("star_id")), sql("SELECT star_id FROM curves EXCEPT SELECT star_id FROM eph", base=PTS))
simple("j1_shuffle", lambda s, d: S.shuffle(X.labelled(s, d), "7", *KEYS).select(*KEYS, "shuffle_key"), sql("SELECT star_id, start, " + MD5.format(seed="7") + " AS shuffle_key FROM lab", base=LAB))
simple("j2_stratified_star_split", lambda s, d: S.stratified_star_split(X.labelled(s, d), "7"), sql(SHARES, ints="has_pos", base=f"{LAB}, {STAR.format(seed='7')}"))
simple("j3_small_split", lambda s, d: S.small_split(X.labelled(s, d), "3"), sql(SHARES.replace("JOIN qv", "JOIN pv"), ints="has_pos", base=f"{LAB}, {STAR.format(seed='3')}, {FLOORED}"))
simple("j4_group_split", lambda s, d: S.group_split(X.labelled(s, d), "5"), sql("SELECT star_id, has_pos, CASE WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CASE WHEN has_pos = 0 THEN floor(n0 * 0.2e0) ELSE floor(a * 0.2e0) - floor(n0 * 0.2e0) END AS k FROM st, (SELECT count(*) AS a, sum(1 - has_pos) AS n0 FROM st))", ints="has_pos", base=f"{LAB}, {STAR.format(seed='5')}"))
simple("j5_positional_split", lambda s, d: S.positional_split(from_first(load(s, d, "customer"), "c_custkey"), "pos").select("c_custkey", "split"), sql("SELECT c_custkey, CASE WHEN pos < round_even(n * 0.8e0, 0) THEN 'train' WHEN pos < round_even(n * 0.8e0, 0) + round_even(n * 0.1e0, 0) THEN 'val' ELSE 'test' END AS split FROM (SELECT c_custkey, c_custkey - min(c_custkey) OVER () AS pos, count(*) OVER () AS n FROM customer)"))


def from_first(df, key):
    least = df.agg(F.min(key).alias("_least"))
    return df.crossJoin(F.broadcast(least)).select(key, (F.col(key) - F.col("_least")).alias("pos"))


def balanced(s, d):
    x = checkpointed(X.scored(s, d))
    return S.balanced_train_set(x, R.nlargest(x.where("label = 0"), 40), "b", 2, 0.1)


simple("j6_balanced_train_set", lambda s, d: balanced(s, d).select(*KEYS, "label"), sql("SELECT star_id, start, label FROM sco WHERE label = 1 UNION ALL SELECT star_id, start, label FROM hard UNION ALL SELECT * FROM (SELECT star_id, start, label FROM sco ANTI JOIN hard USING (star_id, start) WHERE label = 0 ORDER BY " + MD5.format(seed="b") + " LIMIT (SELECT n - h FROM nn))", ints="label", base=SCO + ", nn AS (SELECT least(sum(1 - label), 2 * sum(label)) AS n, least(40, CAST(round_even(0.1e0 * least(sum(1 - label), 2 * sum(label)), 0) AS BIGINT)) AS h FROM sco), hard AS (SELECT star_id, start, label FROM (SELECT *, row_number() OVER (ORDER BY p DESC, star_id, start) AS g FROM sco WHERE label = 0) WHERE g <= (SELECT h FROM nn))"))
simple("j7_oversample", lambda s, d: S.oversample(X.labelled(s, d)).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct(*KEYS).alias("n_rows")), sql("SELECT label, max(count(*)) OVER () AS n, count(*) AS n_rows FROM lab GROUP BY 1", ints="label n", base=LAB))
simple("j8_class_weight", lambda s, d: S.class_weight(X.labelled(s, d)), sql("SELECT 0 AS label, 1e0 AS weight UNION ALL SELECT 1, sum(1 - label) / sum(label) FROM lab", "weight", "label", base=LAB))
simple("j9_choose_positive_stars", lambda s, d: S.choose_stars(curves(s, d), 0.3, "c"), sql("SELECT star_id FROM curves QUALIFY row_number() OVER (ORDER BY md5('c|' || star_id)) <= floor(count(*) OVER () * 0.3e0 + 0.5)", base=PTS))
simple("j10_sample_rows", lambda s, d: S.sample_rows(X.labelled(s, d), 50, "s", *KEYS).select(*KEYS), sql("SELECT star_id, start FROM lab ORDER BY " + MD5.format(seed="s") + " LIMIT 50", base=LAB))
simple("j11_row_split", lambda s, d: S.row_split(X.labelled(s, d), "r", (0.7, 0.15, 0.15), *KEYS).select(*KEYS, "split"), sql("SELECT star_id, start, CASE WHEN r <= round_even(n * 0.15e0, 0) THEN 'test' WHEN r <= 2 * round_even(n * 0.15e0, 0) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY " + MD5.format(seed="r") + ") AS r, count(*) OVER (PARTITION BY label) AS n FROM lab)", base=LAB))
simple("j12_hard_negative_augment", lambda s, d: S.augment_with_hard_negatives((x := checkpointed(X.scored(s, d))).where("label = 1"), R.nlargest(x.where("label = 0"), 20)).select(*KEYS, "weight"), sql("SELECT star_id, start, 1e0 AS weight FROM sco WHERE label = 1 UNION ALL SELECT * FROM (SELECT star_id, start, 2e0 FROM sco WHERE label = 0 ORDER BY p DESC, star_id, start LIMIT 20)", "weight", base=SCO))

# ---- K: metrics --------------------------------------------------------------------------------------------------------------------

simple("k1_roc_auc", lambda s, d: R.roc_auc(X.scored(s, d)), sql("SELECT sum(pos * (an - fp) + pos * neg / 2) / any_value(ap * an) AS roc_auc FROM cur", "roc_auc", base=SCO))
simple("k2_average_precision", lambda s, d: R.average_precision(X.scored(s, d)), sql("SELECT sum(pos / ap * tp / (tp + fp)) AS average_precision FROM cur", "average_precision", base=SCO))
simple("k3_curves", lambda s, d: R.curve_points(X.scored(s, d)), sql("SELECT threshold, tp / ap AS tpr, fp / an AS fpr, tp / (tp + fp) AS precision FROM cur", "threshold tpr fpr precision", base=SCO))
simple("k4_youden", lambda s, d: R.youden_threshold(X.scored(s, d)), sql("SELECT threshold, round(tp / ap - fp / an, 12) AS youden FROM cur ORDER BY youden DESC, threshold DESC LIMIT 1", "threshold youden", base=SCO))
simple("k5_choose_threshold", lambda s, d: R.choose_threshold(X.scored(s, d), "f1").withColumn("mode", F.lit("f1")).unionByName(R.choose_threshold(X.scored(s, d), "balanced_accuracy").withColumn("mode", F.lit("balanced_accuracy"))), sql("SELECT * FROM (SELECT threshold, round(2 * tp / (ap + tp + fp), 12) AS value, 'f1' AS mode FROM cur ORDER BY value DESC, threshold DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT threshold, round((tp / ap + (an - fp) / an) / 2, 12) AS value, 'balanced_accuracy' FROM cur ORDER BY value DESC, threshold DESC LIMIT 1)", "threshold value", base=SCO))
CONF = "cf AS (SELECT CAST(sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN p < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN p < 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM sco)"
simple("k6_confusion", lambda s, d: R.confusion(X.scored(s, d), 0.5), sql("SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, 2 * tp / (2 * tp + fp + fn) AS f1 FROM cf", "accuracy balanced_accuracy f1", base=f"{SCO}, {CONF}"))
simple("k7_class_report", lambda s, d: R.class_report(X.scored(s, d), 0.5), sql("SELECT class, precision, recall, f1, support FROM cr UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM cr UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM cr", "precision recall f1", "support", base=f"{SCO}, {CONF}, cr AS (SELECT '1' AS class, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS support FROM cf UNION ALL SELECT '0', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fn + fp), tn + fp FROM cf)"))
simple("k8_baseline", lambda s, d: X.scored(s, d).agg(F.avg("label").alias("base_pr"), F.avg((F.col("p") >= 0.5).cast("int")).alias("predicted_share")), sql("SELECT avg(label) AS base_pr, avg(CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END) AS predicted_share FROM sco", "base_pr predicted_share", base=SCO))
simple("k9_r_squared", lambda s, d: R.r_squared(R.star_scores(X.scored(s, d)), "score_max", "top_mean"), sql("SELECT 1 - sum((score_max - top_mean) ** 2) / (var_pop(score_max) * count(*)) AS r2 FROM star", "r2", base=SCO))
REPORT = f"""sp AS ({SHARES}), ss AS (SELECT sco.*, split FROM sco JOIN sp USING (star_id)),
sr AS (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY p DESC, start) AS r FROM ss),
rows_ AS (SELECT split, 'window' AS level, label, p, star_id || '|' || lpad(CAST(start AS VARCHAR), 8, '0') AS t FROM ss
UNION ALL SELECT split, 'star_max', max(label), round(max(p), 12), star_id FROM sr GROUP BY split, star_id UNION ALL SELECT split, 'star_mean', max(label), round(avg(p), 12), star_id FROM sr GROUP BY split, star_id UNION ALL SELECT split, 'star_topk_mean', max(label), round(avg(p) FILTER (r <= 10), 12), star_id FROM sr GROUP BY split, star_id),
eb AS (SELECT split, level, p, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM rows_ GROUP BY 1, 2, 3),
ec AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY split, level) AS ap, sum(neg) OVER (PARTITION BY split, level) AS an FROM eb WINDOW w AS (PARTITION BY split, level ORDER BY p DESC)),
em AS (SELECT split, level, CASE WHEN any_value(ap * an) > 0 THEN sum(pos * (an - fp) + pos * neg * 0.5) / any_value(ap * an) END AS roc_auc, CASE WHEN any_value(ap) > 0 THEN sum(pos / ap * tp / (tp + fp)) END AS average_precision, any_value(ap / (ap + an)) AS base_rate, CAST(any_value(ap + an) AS DOUBLE) AS n, min(p) AS lo, max(p) AS hi FROM ec GROUP BY 1, 2),
eg AS (SELECT *, row_number() OVER (PARTITION BY split, level ORDER BY p DESC, t) AS g FROM rows_), ek AS (SELECT split, level, k, avg(label) AS precision, avg(label) / any_value(base_rate) AS lift FROM eg JOIN em USING (split, level), (SELECT unnest([10, 50]) AS k) WHERE g <= k GROUP BY 1, 2, 3),
rep AS (SELECT split, level, 'roc_auc' AS metric, roc_auc AS value FROM em UNION ALL SELECT split, level, 'average_precision', average_precision FROM em UNION ALL SELECT split, level, 'base_rate', base_rate FROM em UNION ALL SELECT split, level, 'n', n FROM em UNION ALL SELECT split, level, 'lo', lo FROM em UNION ALL SELECT split, level, 'hi', hi FROM em
UNION ALL SELECT split, level, 'precision_at_' || k, precision FROM ek UNION ALL SELECT split, level, 'lift_at_' || k, lift FROM ek)"""
EVAL = f"{SCO}, {STAR.format(seed='7')}, {REPORT}"
simple("k10_eval_report", lambda s, d: R.eval_report((x := X.scored(s, d)).join(S.stratified_star_split(x, "7").select("star_id", "split"), "star_id")), sql("SELECT * FROM rep", "value", base=EVAL))

# ---- L: triage ----------------------------------------------------------------------------------------------------------------------

HIGH = "hi AS (SELECT star_id, seg_mid_time AS t, p FROM sco WHERE p >= 0.5), pd AS (SELECT a.star_id, b.t - a.t AS d FROM hi a JOIN hi b ON a.star_id = b.star_id WHERE b.t - a.t BETWEEN 0.3 AND 50 AND a.star_id IN (SELECT star_id FROM hi GROUP BY 1 HAVING count(*) >= 3)), sp AS (SELECT star_id, min(d) AS lo, max(d) AS hi FROM pd GROUP BY 1 HAVING count(*) >= 5), bn AS (SELECT star_id, lo, hi, CASE WHEN hi > lo THEN least(floor((d - lo) / ((hi - lo) / 200)), 199) ELSE 0 END AS b, count(*) AS c FROM pd JOIN sp USING (star_id) GROUP BY 1, 2, 3, 4), per AS (SELECT star_id, lo + (b + 0.5) * (hi - lo) / 200 AS period_days FROM (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY c DESC, b) AS k FROM bn) WHERE k = 1 AND c >= 3)"
simple("l1_estimate_period", lambda s, d: T.estimate_period(X.scored(s, d), 0.5), sql("SELECT * FROM per", "period_days", base=f"{SCO}, {HIGH}"))
EPO = "ep AS (SELECT h.star_id, h.t, h.p, period_days, t0, CASE WHEN period_days > 0 THEN CAST(round_even((t - t0) / period_days, 0) AS BIGINT) ELSE -1 END AS epoch FROM hi h JOIN (SELECT star_id, min(t) AS t0 FROM hi GROUP BY 1) USING (star_id) LEFT JOIN per USING (star_id))"
simple("l2_assign_epochs", lambda s, d: T.epochs(T.hits_of(X.scored(s, d), 0.5), T.estimate_period(X.scored(s, d), 0.5)).select("star_id", F.col("seg_mid_time").alias("t"), "epoch"), sql("SELECT star_id, t, epoch FROM ep", "t", base=f"{SCO}, {HIGH}, {EPO}"))
FLAGS = """fl AS (SELECT s.star_id, coalesce(n_high, 0) AS n_segments_above_thr, CASE WHEN n_high = 1 THEN 1 ELSE 0 END AS flag_singleton_spike, cand_period_days, CASE WHEN off <= 0.35 THEN 1 ELSE 0 END AS flag_periodic,
CASE WHEN ne >= 4 AND no >= 2 AND nv >= 2 AND cand_period_days > 0 THEN abs(po - pe) END AS odd_even_score_gap, CASE WHEN half >= 2 AND zero >= 2 THEN 1 ELSE 0 END AS flag_secondary_proxy FROM (SELECT DISTINCT star_id FROM sco) s
LEFT JOIN (SELECT star_id, count(*) AS n_high, any_value(period_days) AS cand_period_days, quantile_cont(abs((t - t0) / period_days - epoch), 0.5) AS off, count(DISTINCT epoch) AS ne, count(*) FILTER (epoch % 2 = 1) AS no, count(*) FILTER (epoch % 2 = 0) AS nv, avg(p) FILTER (epoch % 2 = 1) AS po, avg(p) FILTER (epoch % 2 = 0) AS pe FROM ep GROUP BY 1) h ON h.star_id = s.star_id
LEFT JOIN (SELECT star_id, sum(CASE WHEN abs(ph - 0.5) <= 0.08 THEN 1 ELSE 0 END) AS half, sum(CASE WHEN least(ph, 1 - ph) <= 0.08 THEN 1 ELSE 0 END) AS zero FROM (SELECT star_id, (t - t0) / period_days - floor((t - t0) / period_days) AS ph FROM (SELECT star_id, seg_mid_time AS t, min(seg_mid_time) OVER (PARTITION BY star_id) AS t0 FROM sco WHERE p >= 0.425) JOIN per USING (star_id)) GROUP BY 1) z ON z.star_id = s.star_id)"""
TRI = f"{SCO}, {HIGH}, {EPO}, {FLAGS}"
simple("l3_triage_flags", lambda s, d: T.triage_flags(X.scored(s, d), 0.5), sql("SELECT * FROM fl", "cand_period_days odd_even_score_gap", "flag_singleton_spike flag_periodic flag_secondary_proxy", base=TRI))
simple("l4_triage_table", lambda s, d: T.sorted_triage(T.triage_table(X.scored(s, d), 0.5)).select("star_id", "n_segments", "best_segment_score", "consistency_score", "top_scores", "flag_periodic", "n_segments_above_thr"), sql("SELECT star_id, count(*) AS n_segments, max(p) AS best_segment_score, avg(p) FILTER (r <= 10) - stddev_pop(p) FILTER (r <= 10) AS consistency_score, string_agg(printf('%.4f', p), ',' ORDER BY r) FILTER (r <= 5) AS top_scores, any_value(flag_periodic) AS flag_periodic, any_value(n_segments_above_thr) AS n_segments_above_thr FROM rk JOIN fl USING (star_id) GROUP BY 1", "best_segment_score consistency_score", "flag_periodic", base=TRI))
simple("l5_phase_fold", lambda s, d: T.phase_fold(X.points(s, d), X.ephemeris(s, d), 10).select("star_id", "bin", "flux", "n"), sql("SELECT star_id, CAST(least(floor(ph * 10), 9) AS BIGINT) AS bin, avg(flux) AS flux, count(*) AS n FROM (SELECT star_id, flux, (time - t0_mission) / period_days - floor((time - t0_mission) / period_days) AS ph FROM pts JOIN (SELECT * EXCLUDE mission FROM eph) USING (star_id)) GROUP BY 1, 2", "flux", base=PTS))
simple("l6_vetting_extract", lambda s, d: T.vetting_extract(X.points(s, d), summary(s, d), 16, 4, 13).drop("mission"), sql("SELECT star_id, panel, idx, time, flux, flux - greatest(least(flux, med + 6 * (mad + 1e-6)), med - 6 * (mad + 1e-6)) AS residual FROM pts JOIN mm USING (star_id) JOIN (SELECT star_id, best_start, n_segments FROM summ WHERE n_segments > 0) USING (star_id), (SELECT unnest(['curve', 'best', 'before', 'after']) AS panel) WHERE panel = 'curve' OR (panel = 'best' AND idx >= best_start AND idx < best_start + 16) OR (n_segments > 13 AND panel = 'before' AND idx >= best_start - 4 AND idx < best_start + 12) OR (n_segments > 13 AND panel = 'after' AND idx >= best_start + 4 AND idx < best_start + 20)", "time flux residual", base=f"{SUMM}, {MAD}"))


#: Curves as P.score_curves prepares them, their dip scores, and how many rows each panel of the extract has.
PREPARE = """pm AS (SELECT star_id, mission, idx, time, flux / quantile_cont(flux, 0.5) OVER (PARTITION BY star_id) AS flux FROM pts WHERE star_id IN (SELECT star_id FROM wa)),
fi AS ({fit}), fa AS (SELECT star_id, mission, idx, time, CASE WHEN abs(t) > 1e-12 THEN flux / t ELSE flux END AS flux FROM fi),
fm AS (SELECT star_id, quantile_cont(flux, 0.5) AS med FROM fa GROUP BY 1), fd AS (SELECT star_id, any_value(med) AS med, quantile_cont(abs(flux - med), 0.5) AS mad FROM fa JOIN fm USING (star_id) GROUP BY 1),
fn AS (SELECT star_id, mission, idx, time, greatest(least((flux - med) / (mad + 1e-6), 10), -10) AS flux FROM fa JOIN fd USING (star_id)),
w AS (SELECT s.star_id, s.mission, s.start, idx, flux FROM seg s JOIN fn ON fn.star_id = s.star_id AND idx >= s.start AND idx < s.start + 16),
dq AS (SELECT star_id, start, x / (1 + x) AS p FROM (SELECT star_id, start, (any_value(med) - min(flux)) / (quantile_cont(abs(flux - med), 0.5) + 1e-6) AS x FROM (SELECT *, quantile_cont(flux, 0.5) OVER (PARTITION BY star_id, start) AS med FROM w) GROUP BY 1, 2)),
su AS (SELECT star_id, any_value(n_points) AS n_points, count(p) AS n_segments, max(p) AS best, stddev_pop(p) AS std FROM dq JOIN (SELECT star_id, n_points FROM curves) USING (star_id) GROUP BY 1),
bs AS (SELECT star_id, start AS best_start FROM dq QUALIFY row_number() OVER (PARTITION BY star_id ORDER BY p DESC, start) = 1)"""
EXTRACT = "n_points + 16 + CASE WHEN n_segments > 13 THEN least(best_start + 12, 16) + least(n_points - best_start - 4, 16) ELSE 0 END"
LISTS = "SELECT * FROM (SELECT 'normal' AS list, star_id, best FROM {src} WHERE n_segments BETWEEN 1 AND 13 ORDER BY best - 0.5 * std DESC, best DESC, star_id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'long', star_id, best FROM {src} WHERE n_segments > 13 ORDER BY best DESC, star_id LIMIT 8)"
FIT = "SELECT star_id, mission, idx, time, flux, (b0 * (m2 * m4 - m3 * m3) - m1 * (b1 * m4 - b2 * m3) + m2 * (b1 * m3 - b2 * m2)) / (n * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2)) AS t FROM (SELECT a.star_id, a.mission, a.idx, a.time, a.flux, CAST(count(*) AS DOUBLE) AS n, CAST(sum(b.idx - a.idx) AS DOUBLE) AS m1, CAST(sum((b.idx - a.idx) ** 2) AS DOUBLE) AS m2, CAST(sum((b.idx - a.idx) ** 3) AS DOUBLE) AS m3, CAST(sum((b.idx - a.idx) ** 4) AS DOUBLE) AS m4, sum(b.flux) AS b0, sum(b.flux * (b.idx - a.idx)) AS b1, sum(b.flux * (b.idx - a.idx) ** 2) AS b2 FROM {points} a JOIN {points} b ON a.star_id = b.star_id AND b.idx BETWEEN a.idx - 10 AND a.idx + 10 GROUP BY 1, 2, 3, 4, 5)"


@query("l7_two_stage_vetting", sql(f"SELECT star_id, best, {EXTRACT} AS n FROM su JOIN bs USING (star_id)", "best", base=f"{SUMM}, wa AS (SELECT star_id FROM ({LISTS.format(src='summ')})), {PREPARE.format(fit=FIT.format(points='pm'))}"))
def _(s, d):
    """Stars picked by one scorer, scored again by another from their points, with the rows of their extracts."""
    again, extract = P.vet(X.points(s, d), R.vetting_lists(summary(s, d), 13, 8), 16, 4, 21, 13)
    return extract.groupBy("star_id").agg(F.count("*").alias("n")).join(again.select("star_id", "best"), "star_id")


# ---- M, N: models, embeddings, streams ---------------------------------------------------------------------------------------------

DIP = f"{LAB}, dp AS (SELECT star_id, mission, start, x / (1 + x) AS p FROM (SELECT star_id, mission, start, (any_value(med) - min(flux)) / (quantile_cont(abs(flux - med), 0.5) + 1e-6) AS x FROM (SELECT *, quantile_cont(flux, 0.5) OVER (PARTITION BY star_id, start) AS med FROM wp) GROUP BY 1, 2, 3))"


def lowest():
    """A model as a factory makes it: here, the lowest point of each window."""
    return lambda x: x.min(1)


packed = lambda s, d: E.pack_windows(X.window_points(s, d))
simple("m1_score_windows_loaded", lambda s, d: E.score_windows_loaded(packed(s, d), lowest, X.WINDOW).select(*KEYS, "score"), sql("SELECT star_id, start, min(flux) AS score FROM wp GROUP BY 1, 2", "score", base=LAB))
simple("m1_score_windows", lambda s, d: E.score_windows(packed(s, d), lambda x: x.min(1)).select(*KEYS, "score"), sql("SELECT star_id, start, min(flux) AS score FROM wp GROUP BY 1, 2", "score", base=LAB))
simple("m2_score_meta", lambda s, d: E.score_windows(packed(s, d).join(W.filter_segments(X.window_points(s, d), least_abs=40.0), [*KEYS, "mission"]), lambda x: x.max(1)).select(*KEYS, "score"), sql("SELECT star_id, start, max(flux) AS score FROM wp GROUP BY 1, 2 HAVING avg(abs(flux)) >= 40 AND avg(CASE WHEN flux = 0 THEN 1e0 ELSE 0e0 END) <= 0.5", "score", base=LAB))
simple("m3_dip_score", lambda s, d: E.dip_score(X.window_points(s, d)), sql("SELECT * FROM dp", "p", base=DIP))


@query("m4_train_window_classifier")
def _(s, d):
    """Boosted trees that tell windows with injected transits, and their area under the curve on stars that were held out."""
    points = X.points(s, d)
    flat = C.robust_scale(points, ["star_id", "mission"]).drop("flux").withColumnRenamed("scaled", "flux")
    chosen = S.choose_stars(curves(s, d), 0.5, "m4")
    injected = checkpointed(C.inject_box_transits(flat.join(chosen, "star_id", "left_semi"), "m4", 1e-2).select(*flat.columns, "injected").unionByName(flat.join(chosen, "star_id", "left_anti").withColumn("injected", F.lit(0))))
    segments = W.make_segments(X.curves(points), X.WINDOW, X.STRIDE)
    labels = W.label_by_count(segments, injected.withColumnRenamed("injected", "hit"), 1)
    features = E.window_features(W.window_points(injected, segments, X.WINDOW, X.STRIDE)).join(labels.select("star_id", "mission", "start", "label"), ["star_id", "mission", "start"])
    weighted = W.confidence_weight(features, X.ephemeris(s, d))
    scored = checkpointed(E.boosted_window_classifier(weighted, S.stratified_star_split(weighted, "m4"), "weight"))
    held = R.roc_auc(scored.where("split = 'test'"), "score").withColumnRenamed("roc_auc", "test_auc")
    return scored.select(*KEYS, "label", "split", "score").crossJoin(F.broadcast(held))


NORMED = f"{LAB}, md AS (SELECT star_id, quantile_cont(flux, 0.5) AS med FROM pts GROUP BY 1), mm AS (SELECT star_id, any_value(med) AS med, quantile_cont(abs(flux - med), 0.5) AS mad FROM pts JOIN md USING (star_id) GROUP BY 1), np AS (SELECT star_id, mission, start, idx, (flux - med) / (mad + 1e-6) AS flux FROM wp JOIN mm USING (star_id)), dn AS (SELECT star_id, mission, start, x / (1 + x) AS p FROM (SELECT star_id, mission, start, (any_value(med) - min(flux)) / (quantile_cont(abs(flux - med), 0.5) + 1e-6) AS x FROM (SELECT *, quantile_cont(flux, 0.5) OVER (PARTITION BY star_id, start) AS med FROM np) GROUP BY 1, 2, 3))"
simple("m5_score_stars", lambda s, d: E.score_stars(X.points(s, d), 16, 4, 5), sql("SELECT star_id, mission, start, p, score FROM (SELECT *, avg(p) FILTER (r <= 5) OVER (PARTITION BY star_id, mission) AS score FROM (SELECT *, row_number() OVER (PARTITION BY star_id, mission ORDER BY p DESC, start) AS r FROM dn)) WHERE r <= 5", "p score", base=NORMED))


def star_vectors(s, d):
    """Embeddings as windows of the stars named by their label; of some labels every vector is broken."""
    e = load(s, d, "embeddings")
    vec = F.when(F.col("label") % 5 == 3, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return e.select(F.col("label").alias("star_id"), F.col("vec_id").alias("start"), (F.col("vec_id") * 7919 % 1000 / 1000.0).alias("p"), vec.alias("vec"))


POOL = "top AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id * 7919 % 1000 DESC, vec_id) AS r FROM embeddings WHERE label % 5 <> 3), mv AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM top WHERE r <= 5) GROUP BY 1, 2), nv AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM mv)"
simple("m6_pool_embeddings", lambda s, d: E.pool_embeddings(star_vectors(s, d)).where("vec is not null").select("star_id", F.posexplode("vec").alias("i", "x")), sql("SELECT label AS star_id, i - 1 AS i, x FROM nv", "x", "star_id i", base=POOL))
simple("m7_embedding_health", lambda s, d: E.embedding_health(load(s, d, "embeddings")), sql("SELECT max(d) AS dim, 0 AS n_nan, 0 AS n_inf, max(m) AS max_abs, 0 AS bad_rows, avg(n) AS norm_mean, stddev_pop(n) AS norm_std, min(n) AS norm_min, max(n) AS norm_max FROM (SELECT vec_id, count(*) AS d, max(abs(x)) AS m, sqrt(sum(x * x)) AS n FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1)", "max_abs norm_mean norm_std norm_min norm_max", "dim n_nan n_inf bad_rows"))
simple("m8_pca2d", lambda s, d: E.pca(load(s, d, "embeddings"), 2).select("vec_id", F.abs(F.col("pc")[0]).alias("x"), F.abs(F.col("pc")[1]).alias("y")))
simple("m9_nearest_neighbours", lambda s, d: E.nearest_to(load(s, d, "embeddings"), load(s, d, "embeddings").orderBy("vec_id"), 15, "vec_id", "embedding"), sql("SELECT vec_id, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 9) AS distance FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) JOIN (SELECT unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS y FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)) USING (i) WHERE vec_id <> (SELECT min(vec_id) FROM embeddings) GROUP BY 1 ORDER BY distance, vec_id LIMIT 15", "distance"))
label_scores = lambda s, d: load(s, d, "embeddings").withColumn("score", F.col("label").cast("double"))


@query("m10_smooth_scores")
def _(s, d):
    """Scores smoothed over the embedding by boosted trees, with R² of the fifth that was held out."""
    smooth = checkpointed(E.boosted_smooth_scores(label_scores(s, d), "score", "vec_id").select("vec_id", "score", "smooth", "split"))
    top = E.above_cut(smooth, "smooth").select("vec_id", F.lit(1).alias("above_cut"))
    held = R.r_squared(smooth.where("split = 'test'"), "score", "smooth")
    return smooth.join(top, "vec_id", "left").crossJoin(F.broadcast(held)).select("vec_id", "split", "smooth", "r2", F.coalesce("above_cut", F.lit(0)).alias("above_cut"))


simple("m11_binary_embedding_classifier", lambda s, d: E.binary_embedding_classifier(load(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label")), "vec_id").select("vec_id", "label", "split", "probability"))
simple("m12_anomaly_scores", lambda s, d: E.anomaly_scores(load(s, d, "embeddings"), "vec_id"))
simple("m13_weird_stars", lambda s, d: E.weird_stars(load(s, d, "embeddings"), "vec_id", score="label"))
simple("m14_star_anomalies", lambda s, d: E.star_anomalies(X.points(s, d), 16, 4).groupBy("star_id", "mission").agg(F.max("outlier_score").alias("outlier_score")))
simple("m14_star_anomalies_on_self", lambda s, d: E.star_anomalies(X.points(s, d), 16, 4, fit_on_self=True, trees=25, size=64).groupBy("star_id", "mission").agg(F.max("outlier_score").alias("outlier_score")))

# ---- P: pipelines ------------------------------------------------------------------------------------------------------------------

K2 = f"pe AS MATERIALIZED ({PREPARED}), ke AS MATERIALIZED (SELECT star_id, mission, period_days, t0_mission + 2454833 AS t0_mission, duration_days FROM pe WHERE mission = 'k2' UNION ALL SELECT star_id, mission, period_days, t0_mission + 2454833, duration_days FROM eph WHERE mission = 'k2'), ks AS MATERIALIZED (SELECT star_id FROM ke UNION SELECT star_id FROM named WHERE mission = 'k2'), kp AS (SELECT star_id, mission, idx, time + 2454833 AS time FROM pts WHERE mission = 'k2'), kh AS MATERIALIZED (SELECT p.star_id, p.idx, max(coalesce({X.HIT}, 0)) AS hit FROM kp p LEFT JOIN ke e ON p.star_id = e.star_id GROUP BY 1, 2)"
simple("p1_label_mission", lambda s, d: P.label_mission(X.catalog(s, d), shifted(s, d), "k2", 16, 4, 4, X.ephemeris(s, d)), sql("SELECT s.star_id, s.mission, s.start, s.start + 16 AS \"end\", CASE WHEN sum(hit) >= 4 THEN 1 ELSE 0 END AS label FROM seg s JOIN kh h ON h.star_id = s.star_id AND h.idx >= s.start AND h.idx < s.start + 16 WHERE s.mission = 'k2' AND s.star_id IN (SELECT star_id FROM ks WHERE star_id IS NOT NULL) GROUP BY 1, 2, 3", ints="label", base=f"{PTS}, {CAT}, {K2}"))
simple("p2_mission_training_set", lambda s, d: P.mission_training_set(X.scored(s, d)).select(*KEYS, "label", "weight", "n_leaks"), sql("SELECT *, 0 AS n_leaks FROM (SELECT star_id, start, label, 1e0 AS weight FROM tr WHERE label = 1 UNION ALL SELECT star_id, start, label, 1e0 FROM (SELECT *, row_number() OVER (ORDER BY " + MD5.format(seed="b") + ") AS g FROM tr WHERE label = 0) WHERE g <= (SELECT sum(label) FROM tr) UNION ALL SELECT star_id, start, label, 2e0 FROM (SELECT * FROM (SELECT * FROM (SELECT *, " + MD5.format(seed="m") + " AS k, row_number() OVER (PARTITION BY star_id ORDER BY " + MD5.format(seed="m") + ") AS n FROM tr WHERE label = 0) WHERE n <= 4 ORDER BY k LIMIT 100) ORDER BY p DESC, star_id, start LIMIT 30))", "weight", "label n_leaks", base=f"{SCO}, {STAR.format(seed='7')}, tr AS (SELECT sco.* FROM sco JOIN ({SHARES}) q USING (star_id) WHERE q.split = 'train')"))
CAPPED = f"""es AS MATERIALIZED (SELECT star_id, mission, period_days, t0_mission, duration_days FROM ({SIMPLE}) UNION ALL SELECT star_id, mission, period_days, t0_mission, duration_days FROM eph),
pq AS (SELECT *, dense_rank() OVER (PARTITION BY star_id ORDER BY floor(time / 7)) AS f FROM pts), ps AS (SELECT star_id, mission, row_number() OVER (PARTITION BY star_id ORDER BY time) - 1 AS idx, time, flux FROM pq WHERE f <= 4),
p1 AS (SELECT star_id, quantile_cont(flux, 0.5) AS med FROM ps GROUP BY 1), p2 AS (SELECT star_id, any_value(med) AS med, quantile_cont(abs(flux - med), 0.5) AS mad FROM ps JOIN p1 USING (star_id) GROUP BY 1),
sg AS (SELECT star_id, mission, unnest(range(0, n - 16 + 1, 4)) AS start FROM (SELECT star_id, mission, count(*) AS n FROM ps GROUP BY 1, 2) WHERE n >= 16),
pw AS (SELECT s.star_id, s.mission, s.start, idx, time, (flux - med) / (mad + 1e-6) AS flux FROM sg s JOIN ps p ON p.star_id = s.star_id AND idx >= s.start AND idx < s.start + 16 JOIN p2 ON p2.star_id = s.star_id),
ta AS (SELECT star_id, mission, start, min(time) AS a, max(time) AS b, min(flux) - quantile_cont(flux, 0.5) AS lo FROM pw GROUP BY 1, 2, 3),
ov AS (SELECT t.star_id, t.start, any_value(lo) AS lo, max(CASE WHEN period_days > 0 AND ceil((a - 1.5 * duration_days - t0_mission) / period_days) <= floor((b + 1.5 * duration_days - t0_mission) / period_days) THEN 1 ELSE 0 END) AS label, max(CASE WHEN e.star_id IS NOT NULL THEN 1.0 ELSE 0.3 END) AS weight FROM ta t LEFT JOIN es e ON t.star_id = e.star_id AND t.mission = e.mission GROUP BY 1, 2),
ca AS (SELECT star_id, start, label, weight, lo FROM (SELECT *, row_number() OVER (PARTITION BY star_id, label ORDER BY {MD5.format(seed="h")}) AS n, least(sum(label) OVER (PARTITION BY star_id), 3) AS pos FROM ov) WHERE CASE WHEN label = 1 THEN n <= pos ELSE n <= 6 - pos END),
cs AS (SELECT *, row_number() OVER (PARTITION BY has_pos ORDER BY md5('h|' || star_id), star_id) AS r FROM (SELECT star_id, max(label) AS has_pos FROM ca GROUP BY 1)),
cq AS (SELECT star_id, CASE WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CASE WHEN has_pos = 0 THEN floor(n0 * 0.2e0) ELSE floor(a * 0.2e0) - floor(n0 * 0.2e0) END AS k FROM cs, (SELECT count(*) AS a, sum(1 - has_pos) AS n0 FROM cs)))"""
weeks = lambda s, d: X.points(s, d).withColumn("product_id", F.floor(F.col("time") / 7)).withColumn("preferred", F.lit("tess"))
simple("p3_capped_training_set", lambda s, d: P.capped_training_set(weeks(s, d), I.simple_ephemeris(I.add_star_id(X.catalog(s, d))).unionByName(X.ephemeris(s, d)), ["tess", "kepler", "k2"], 16, 4, 6).select(*KEYS, "label", "weight", "split", F.array_min("values").alias("lo")),
       sql("SELECT star_id, start, label, weight, split, lo FROM ca JOIN cq USING (star_id)", "weight lo", "label", base=f"{PTS}, {CAT}, {CAPPED}"))
INJECTED = f"""tg AS (SELECT star_id, row_number() OVER (ORDER BY pos) - 1 AS place, count(*) OVER () AS n FROM (SELECT 'EPIC_' || o_custkey AS star_id, min(o_orderkey) AS pos FROM orders GROUP BY 1)),
sp AS (SELECT star_id, CASE WHEN place < round_even(n * 0.8e0, 0) THEN 'train' WHEN place < round_even(n * 0.8e0, 0) + round_even(n * 0.1e0, 0) THEN 'val' ELSE 'test' END AS split FROM tg),
ch AS (SELECT star_id FROM sp QUALIFY row_number() OVER (ORDER BY md5('s|' || star_id)) <= greatest(floor(count(*) OVER () * 0.5e0 + 0.5), 1)),
cu AS (SELECT star_id, mission, idx, time, flux FROM pts WHERE star_id IN (SELECT star_id FROM sp)),
pa AS (SELECT star_id, mission, per AS period_days, dur AS duration_days, ppm, a + u0 * least(b - a, per) AS t0_mission, a, b FROM (SELECT star_id, mission, min(time) AS a, max(time) AS b, 0.7e0 + {U("period")} * 19.3e0 AS per, (1 + {U("hours")} * 5) / 24 AS dur, 200 + {U("ppm")} * 3800 AS ppm, {U("t0")} AS u0 FROM cu WHERE star_id IN (SELECT star_id FROM ch) GROUP BY star_id, mission)),
ij AS (SELECT cu.star_id, cu.mission, idx, time, CASE WHEN b > a AND abs(((time - t0_mission + period_days / 2) - period_days * floor((time - t0_mission + period_days / 2) / period_days)) - period_days / 2) <= duration_days / 2 THEN flux - ppm * 0.001e0 ELSE flux END AS flux FROM cu LEFT JOIN pa USING (star_id)),
fi AS ({FIT.format(points="ij")}), fl AS (SELECT star_id, mission, idx, time, CASE WHEN abs(t) > 1e-12 THEN flux / t ELSE flux END AS flux FROM fi),
me AS (SELECT star_id, quantile_cont(flux, 0.5) AS med, stddev_pop(flux) AS sd FROM fl GROUP BY 1),
w AS (SELECT s.star_id, s.mission, s.start, idx, time, (flux - med) / (sd + 1e-8) AS flux FROM seg s JOIN fl ON fl.star_id = s.star_id AND idx >= s.start AND idx < s.start + 16 JOIN me ON me.star_id = s.star_id),
ti AS (SELECT star_id, start, min(time) AS a, max(time) AS b FROM w GROUP BY 1, 2),
lb AS (SELECT star_id, start, max(CASE WHEN abs(t - (a + b) / 2) <= 0.15 * (b - a) / 2 AND least(b, t + duration_days / 2) - greatest(a, t - duration_days / 2) >= 0.7 * duration_days THEN 1 ELSE 0 END) AS label FROM (SELECT ti.star_id, ti.start, ti.a, ti.b, duration_days, t0_mission + round_even(((ti.a + ti.b) / 2 - t0_mission) / period_days, 0) * period_days AS t FROM ti LEFT JOIN pa USING (star_id)) GROUP BY 1, 2)"""
targets = lambda s, d: A.campaign_targets(orders(s, d), "pos", "EPIC_")
simple("p4_injected_dataset", lambda s, d: P.injected_dataset(targets(s, d), X.points(s, d), 16, 4, 21, depth_unit=1e-3).select("star_id", "mission", "start", "end", "split", "label", F.array_min("values").alias("lo"), (F.element_at("ch1", 16) - F.element_at("ch1", 1)).alias("last")),
       sql('SELECT w.star_id, w.mission, w.start, w.start + 16 AS "end", split, label, min(flux) AS lo, arg_max(flux, idx) - arg_max(flux, CASE WHEN idx < w.start + 15 THEN idx ELSE -1 END) AS last FROM w JOIN lb USING (star_id, start) JOIN sp USING (star_id) GROUP BY 1, 2, 3, 4, 5, 6', "lo last", "label", base=f"{PTS}, {INJECTED}"))
PRODUCTS = INJECTED.replace("cu AS (SELECT star_id, mission, idx, time, flux FROM pts WHERE", "cu AS (SELECT star_id, mission, row_number() OVER (PARTITION BY star_id ORDER BY time) - 1 AS idx, time, flux FROM pts WHERE idx % 3 <> 0 AND").replace("pa AS (", "sg AS (SELECT star_id, mission, unnest(range(0, n - 16 + 1, 4)) AS start FROM (SELECT star_id, mission, count(*) AS n FROM cu GROUP BY 1, 2) WHERE n >= 16),\npa AS (").replace("FROM seg s JOIN fl", "FROM sg s JOIN fl")
versions = lambda s, d: X.points(s, d).withColumn("product_id", F.when(F.col("idx") % 3 == 0, 1).otherwise(2)).withColumn("provenance", F.when(F.col("idx") % 3 == 0, "QLP").otherwise("SPOC"))
simple("p4_injected_dataset_products", lambda s, d: P.injected_dataset(targets(s, d), versions(s, d), 16, 4, 21, depth_unit=1e-3, priority=("SPOC",), banned=("EVEREST",)).select("star_id", "mission", "start", "end", "split", "label", F.array_min("values").alias("lo")),
       sql('SELECT w.star_id, w.mission, w.start, w.start + 16 AS "end", split, label, min(flux) AS lo FROM w JOIN lb USING (star_id, start) JOIN sp USING (star_id) GROUP BY 1, 2, 3, 4, 5, 6', "lo", "label", base=f"{PTS}, {PRODUCTS}"))
simple("p5_survey", lambda s, d: P.survey(X.points(s, d), 16, 4), sql("SELECT star_id, avg(p) AS score FROM (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY p DESC, start) AS r FROM dn) WHERE r <= 5 GROUP BY 1", "score", base=NORMED))
WANTED = "wa AS (SELECT DISTINCT c.star_id FROM curves c JOIN orders ON c.star_id = 'EPIC_' || o_custkey WHERE c.star_id NOT IN (SELECT star_id FROM eph WHERE period_days = 3))"
simple("p6_score_and_vet", lambda s, d: P.score_and_vet(X.points(s, d), A.load_ids(orders(s, d), "epic_number", "pos").select(F.concat(F.lit("EPIC_"), "target").alias("star_id")), X.ephemeris(s, d).where("period_days = 3"), 16, 4, 21, 13, 8).select("list", "star_id", "best", "best_again", "n_extract"),
       sql(f"SELECT list, li.star_id, li.best, li.best AS best_again, {EXTRACT} AS n_extract FROM li JOIN su USING (star_id) JOIN bs USING (star_id)", "best best_again", base=f"{PTS}, {WANTED}, {PREPARE.format(fit=FIT.format(points='pm'))}, li AS ({LISTS.format(src='su')})"))
HIGHEST = TRI.replace("p >= 0.5 ", "p >= (SELECT quantile_cont(p, 0.99) FROM sco) ").replace("p >= 0.5)", "p >= (SELECT quantile_cont(p, 0.99) FROM sco))").replace("p >= 0.5,", "p >= (SELECT quantile_cont(p, 0.99) FROM sco),").replace("p >= 0.425", "p >= 0.85e0 * (SELECT quantile_cont(p, 0.99) FROM sco)")
DIPPED = SCO.replace("sco AS (SELECT lab.*, pp.p, pp.seg_mid_time FROM lab JOIN pp USING (star_id, start))", "dip AS (SELECT star_id, start, round(x / (1 + x), 9) AS p FROM (SELECT star_id, start, (any_value(med) - min(flux)) / (quantile_cont(abs(flux - med), 0.5) + 1e-6) AS x, avg(abs(flux)) AS energy FROM (SELECT *, quantile_cont(flux, 0.5) OVER (PARTITION BY star_id, start) AS med FROM wp) GROUP BY 1, 2) WHERE energy >= 40), sco AS (SELECT lab.*, dip.p, pp.seg_mid_time FROM lab JOIN pp USING (star_id, start) JOIN dip USING (star_id, start))")
rounded_dips = lambda w: E.dip_score(w).withColumn("p", X.rounded(F.col("p"), 9))
simple("p7_triage", lambda s, d: P.triage_windows(X.points(s, d), W.make_segments(curves(s, d), 16, 4), rounded_dips, 16, 4, 0.9, least_abs=40.0).select("star_id", "best_segment_score", "flag_periodic", "flag_singleton_spike", "n_segments_above_thr"), sql("SELECT star_id, max(p) AS best_segment_score, any_value(flag_periodic) AS flag_periodic, any_value(flag_singleton_spike) AS flag_singleton_spike, any_value(n_segments_above_thr) AS n_segments_above_thr FROM sco JOIN fl USING (star_id) GROUP BY 1", "best_segment_score", "flag_periodic flag_singleton_spike", base=HIGHEST.replace(SCO, DIPPED).replace("0.99", "0.9e0")))
simple("p7_triage_of_scores", lambda s, d: P.triage_run(X.scored(s, d)).select("star_id", "best_segment_score", "flag_periodic", "flag_singleton_spike", "n_segments_above_thr"), sql("SELECT star_id, max(p) AS best_segment_score, any_value(flag_periodic) AS flag_periodic, any_value(flag_singleton_spike) AS flag_singleton_spike, any_value(n_segments_above_thr) AS n_segments_above_thr FROM sco JOIN fl USING (star_id) GROUP BY 1", "best_segment_score", "flag_periodic flag_singleton_spike", base=HIGHEST))
simple("p8_evaluate", lambda s, d: P.evaluate((x := X.scored(s, d)), S.stratified_star_split(x, "7")), sql("SELECT * FROM rep UNION ALL SELECT 'all', 'fused', 'average_precision', sum(pos / ap * tp / (tp + fp)) FROM fc UNION ALL SELECT 'all', 'fused', 'roc_auc', sum(pos * (an - fp) + pos * neg * 0.5) / any_value(ap * an) FROM fc UNION ALL SELECT 'all', 'hard_negative_bank', 'mean', avg(p) FROM (SELECT p FROM (SELECT * FROM rk WHERE r <= 3 AND star_id IN (SELECT star_id FROM star WHERE y_star = 0) ORDER BY p DESC, star_id, start LIMIT 200) ORDER BY p DESC LIMIT 50) UNION ALL SELECT 'all', 'false_positives', 'mean', avg(p) FROM (SELECT p FROM sco WHERE star_id IN (SELECT star_id FROM star WHERE y_star = 0 ORDER BY score_max DESC, star_id LIMIT 5) ORDER BY p DESC, star_id, start LIMIT 40) UNION ALL SELECT 'all', 'leaks', 'n', 0e0", "value", base=EVAL + ", fb AS (SELECT round(top_median + 0.10 * share_high - 0.20 * (score_max - top_mean), 12) AS p, CAST(sum(y_star) AS DOUBLE) AS pos, CAST(sum(1 - y_star) AS DOUBLE) AS neg FROM star GROUP BY 1), fc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM fb WINDOW w AS (ORDER BY p DESC))"))
loose = lambda s, d: load(s, d, "events").select(F.concat_ws(",", F.col("user_id").cast("string"), F.col("value").cast("string")).alias("value"))
simple("p9_embedding_report", lambda s, d: P.embedding_report(label_scores(s, d), star_vectors(s, d), loose(s, d)))


@query("n1_stream_star_scores", sql("SELECT star_id, count(*) AS n_segments, max(p) AS best, avg(p) AS mean FROM sco GROUP BY 1", "best mean", base=SCO))
def _(s, d):
    """Every star of the scored windows, as the stream over files of windows gives them (see streaming.star_scores)."""
    from ..streaming.star_scores import star_scores_so_far, stream_star_scores

    folder = new_folder(s, "stream")
    rows = X.scored(s, d).select("star_id", "start", "p")
    rows.write.parquet(f"{folder}/in")
    stream_star_scores(s, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/log", 4).awaitTermination()
    return star_scores_so_far(s, f"{folder}/out")


@query("n1_stream_score_rows", sql(ROWS.format(q50="list_sort(list(p) FILTER (p IS NOT NULL))[CAST(ceil(0.5e0 * count(p)) AS BIGINT)]", q95="list_sort(list(p) FILTER (p IS NOT NULL))[CAST(ceil(0.95e0 * count(p)) AS BIGINT)]"), NUMBERS, "best_seg_idx best_start best_end", base=SCO))
def _(s, d):
    """All fields of every curve's score, from a stream over files that hold parts of many curves."""
    from ..streaming.star_scores import score_rows_so_far, stream_star_scores

    folder = new_folder(s, "stream")
    rows = timed(s, d).select("star_id", "mission", "start", "p", "t_first", "t_last")
    rows.repartition(6, "start").write.parquet(f"{folder}/in")
    stream_star_scores(s, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/log", 2).awaitTermination()
    return score_rows_so_far(s, f"{folder}/out", X.curves(X.points(s, d)), X.WINDOW, X.STRIDE)


def flagship(spark, sf_dir):
    """Labelled windows of all stars, summed up by star."""
    return X.tidy(R.star_scores(X.scored(spark, sf_dir)))
