"""Star ids, missions and ephemerides as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import coalesce_aliases

#: Days by which the missions' clocks are behind the barycentric Julian date.
BKJD, BTJD = 2454833.0, 2457000.0
PREFIX = {"KIC_": "kepler", "KOI_": "kepler", "EPIC_": "k2", "TIC_": "tess", "TOI_": "tess"}


def clean(c: Column) -> Column:
    """Trimmed text; blank, "nan" and "none" are null."""
    x = F.trim(c.cast("string"))
    return F.when(F.lower(x).isin("", "nan", "none"), None).otherwise(x)


def intish(c: Column) -> Column:
    """A whole number from text such as "12.0", or null."""
    return F.trim(c.cast("string")).try_cast("double").cast("bigint")


#: How ids are written, as a prefix, signs or blanks, and the rest; and runs of the sign that joins them.
ID_SIGNS, ID_JOINS = r"^(KIC|KOI|EPIC|TIC|TOI)[\s\-]+", "__+"


def normalize_star_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), ID_SIGNS, "$1_"), ID_JOINS, "_")


def mission_from_star_id(c: Column) -> Column:
    x, out = F.upper(c), F.lit(None).cast("string")
    for prefix, mission in PREFIX.items():
        out = F.coalesce(out, F.when(x.startswith(prefix), mission))
    return out


def repair_mission(star_id: Column, mission: Column) -> Column:
    """The mission that the id's prefix names; else the given one, in lower case."""
    return F.coalesce(mission_from_star_id(star_id), F.lower(clean(mission)))


def canon_digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\D+", "")


def target_key(c: Column) -> Column:
    return F.translate(c, " /", "__")


def add_star_id(df: DataFrame) -> DataFrame:
    """A canonical star_id and mission for each catalog row (see schemas.CATALOG for the columns it may have)."""
    given = normalize_star_id(clean(F.col("star_id")))
    mission = F.lower(clean(F.col("mission")))
    has = lambda n: clean(F.col(n)).isNotNull()
    inferred = F.coalesce(mission_from_star_id(given), F.when(has("kepid") | has("koi_name") | has("koi"), "kepler"), F.when(has("epic"), "k2"), F.when(has("tid") | has("toi"), "tess"))
    number = lambda p, n: F.when(intish(F.col(n)).isNotNull(), F.concat(F.lit(p), intish(F.col(n)).cast("string")))
    built = F.coalesce(given, number("KIC_", "kepid"), number("KOI_", "koi"), number("EPIC_", "epic"), number("TIC_", "tid"), number("TOI_", "toi"), clean(F.col("koi_name")), clean(F.col("hostname")))
    return df.withColumns({"mission": F.coalesce(mission, inferred), "star_id": built})


def target_and_mission(df: DataFrame) -> DataFrame:
    """Search text and mission of each row: Kepler, K2, TESS ids in this order, then a TOI name, then the host's name.

    Ids may have any of the names in ``schemas.ALIASES`` and are returned under one; absent ones count as null.
    """
    df = coalesce_aliases(df)
    get = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    text = lambda p, c: F.when(c.isNotNull(), F.concat(F.lit(p), c.cast("string")))
    kepid, epic, tid, toi = intish(get("kepid")), intish(get("epic")), intish(get("tid")), clean(get("toi"))
    target = F.coalesce(text("KIC ", kepid), text("EPIC ", epic), text("TIC ", tid), text("TOI ", toi), clean(get("hostname")))
    mission = F.when(kepid.isNotNull(), "Kepler").when(epic.isNotNull(), "K2").when(tid.isNotNull() | toi.isNotNull(), "TESS")
    return df.withColumns({"target": target, "target_mission": mission})


def prepare_ephemeris(df: DataFrame, longest_share: float = 0.2) -> DataFrame:
    """Period, mid-transit time on the mission's clock and duration in days of each planet; incomplete or implausible rows go."""
    tess, other = F.col("mission") == "tess", F.col("mission").isin("kepler", "k2")
    period = F.when(tess, F.col("pl_orbper")).when(other, F.coalesce("pl_orbper", "koi_period"))
    t0 = F.when(tess, F.col("pl_tranmid") - BTJD).when(other, F.coalesce(F.col("koi_time0bk"), F.col("pl_tranmid") - BKJD))
    hours = F.when(tess, F.coalesce("pl_trandurh", "pl_trandur")).when(other, F.coalesce("koi_duration", "pl_trandurh", "pl_trandur"))
    rows = df.select("star_id", "mission", period.alias("period_days"), t0.alias("t0_mission"), (hours / 24).alias("duration_days")).dropna()
    return rows.where((F.col("period_days") > 0) & (F.col("duration_days") > 0) & (F.col("duration_days") / F.col("period_days") < longest_share)).distinct()


def simple_ephemeris(df: DataFrame, default_hours: float = 6.0) -> DataFrame:
    """One triple a row: the koi columns if complete, else the pl columns with the mission's offset; duration has a default."""
    koi = F.col("koi_period").isNotNull() & F.col("koi_time0bk").isNotNull()
    offset = F.when(F.col("mission") == "tess", BTJD).otherwise(BKJD)
    hours = F.when(koi, F.col("koi_duration")).otherwise(F.coalesce("pl_trandurh", "pl_trandur"))
    return df.select(
        "star_id", "mission",
        F.when(koi, F.col("koi_period")).otherwise(F.col("pl_orbper")).alias("period_days"),
        F.when(koi, F.col("koi_time0bk")).otherwise(F.col("pl_tranmid") - offset).alias("t0_mission"),
        (F.coalesce(hours, F.lit(default_hours)) / 24).alias("duration_days"),
    ).where("period_days is not null and t0_mission is not null")


def guess_time_base(points: DataFrame) -> DataFrame:
    """BJD, REDUCED or UNKNOWN for each curve, from its median time."""
    key = [c for c in ("star_id", "mission") if c in points.columns]
    m = points.groupBy(*key).agg(F.percentile("time", F.lit(0.5)).alias("m"))
    base = F.when(F.col("m") > 2e6, "BJD").when((F.col("m") > 1e4) & (F.col("m") < 2e5), "UNKNOWN").otherwise("REDUCED")
    return m.select(*key, base.alias("time_base"))


def convert_t0(t0: Column, mission: Column, time_base: Column) -> Column:
    """A mission-clock time on the clock of the curve: the offset is added only for BJD."""
    offset = F.when(mission == "tess", BTJD).otherwise(BKJD)
    return F.when(time_base == "BJD", t0 + offset).otherwise(t0)


def priority(best: str = "best_seg_score", spread: str = "std_seg_score") -> Column:
    return F.col(best) - 0.5 * F.col(spread)


def star_label(score: str, threshold: float) -> Column:
    return F.when(F.col(score) >= threshold, "TRANSIT").otherwise("NO_TRANSIT")


def label_column(df: DataFrame, names: tuple = ("y", "label", "is_transit", "target", "y_seg")) -> Column:
    """The first label column that the frame has, as 0 or 1; null counts as 0."""
    name = next((n for n in names if n in df.columns), None)
    if name is None:
        raise ValueError(f"none of {names} is a column")
    return F.coalesce(F.col(name).cast("int"), F.lit(0)).alias("label")
