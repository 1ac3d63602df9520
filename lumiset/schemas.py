"""Column sets of the tables that operators exchange, and how a frame is brought to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct(**fields: str) -> T.StructType:
    """A schema from column names and type names; needs no session."""
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])


EPHEMERIS = struct(star_id="string", mission="string", period_days="double", t0_mission="double", duration_days="double")
SEGMENTS = struct(star_id="string", mission="string", start="bigint", end="bigint")
CATALOG = struct(
    **dict.fromkeys(["kepid", "epic", "tid", "toi", "koi", "koi_name", "hostname", "mission", "star_id"], "string"),
    **dict.fromkeys(["pl_orbper", "pl_tranmid", "pl_trandurh", "pl_trandur", "koi_period", "koi_time0bk", "koi_duration"], "double"),
)


#: The names under which archives give the ids, best first; they are told apart by case.
ALIASES = {"kepid": ["kepid", "KIC", "kic"], "epic": ["epic", "EPIC"], "tid": ["tid", "TIC ID", "tic_id", "tic"], "toi": ["toi", "TOI"]}
#: Of these ids a whole number counts before any other text.
NUMBERED = ("kepid", "epic", "tid")


def coalesce_aliases(df: DataFrame) -> DataFrame:
    """``df`` with one column for each id of ``ALIASES`` that it has under any name, and its other columns as they are.

    A row's value is the first of the columns, in the order of the names, that holds a whole number, else the first that holds
    anything but blanks, "nan" or "none". Names that differ in case only are told apart, which a frame's own look-up does not do.
    """
    from .functions.ids import clean, intish

    names = df.columns
    rows = df.toDF(*(f"_{i}" for i in range(len(names))))
    out, used = [], set()
    for name, aliases in ALIASES.items():
        places = [i for a in aliases for i, n in enumerate(names) if n == a]
        places += [i for i, n in enumerate(names) if i not in places and n.lower() == name]
        if places:
            texts = [clean(F.col(f"_{i}")) for i in places]
            numbers = [F.when(intish(t).isNotNull(), t) for t in texts] if name in NUMBERED else []
            out.append(F.coalesce(*numbers, *texts).alias(name))
            used.update(places)
    return rows.select(*out, *(F.col(f"_{i}").alias(n) for i, n in enumerate(names) if i not in used))


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of ``schema`` in its order and types; absent ones are typed nulls, NaN becomes null. Case does not matter;
    ids may have any name of ``ALIASES``."""
    if schema is CATALOG:
        df = coalesce_aliases(df)
    present = {c.lower(): c for c in df.columns}
    out = []
    for f in schema.fields:
        c = F.col(f"`{present[f.name.lower()]}`").cast(f.dataType) if f.name.lower() in present else F.lit(None).cast(f.dataType)
        out.append((F.nanvl(c, F.lit(None).cast("double")) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name))
    return df.select(*out)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself, or an error that names the missing columns before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; present: {df.columns}")
    return df
