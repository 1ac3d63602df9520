"""Points, segments and ephemerides laid out so that joining them moves no rows.

A clustered table is partitioned by mission and bucketed by star: a mission is read without the others' files, and all rows of a
star lie in one bucket of the same number in every table. Windows, labels and joins by star and anything else then need no
exchange. Spark takes a bucketing by star alone for good enough to join by star, mission and place only if
``spark.sql.requireAllClusterKeysForCoPartition`` is false; ``clustered`` sets that for the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..storage import new_folder

#: At 100 TB a bucket of a mission should have a few hundred MB; all tables that meet need the same number.
BUCKETS = 32


def clustered(df: DataFrame, name: str, sort_by: tuple = ("idx",), buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """``df`` written once as a table by mission and star, one file a bucket and mission, and read again.

    Inside a bucket rows go by star and ``sort_by``. Without ``path`` the table lives in the shared folder until the application ends.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, "star_id")  # by the hash that deals buckets
    writer = dealt.write.partitionBy("mission").bucketBy(buckets, "star_id").sortBy("star_id", *sort_by)
    writer.option("path", path or new_folder(spark, name)).saveAsTable(table)
    return spark.table(table)
