"""The folder that the driver and all executors share, for checkpoints and for tables between steps."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset and Spark runs in this process alone, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
            delete_at_end(spark, folder)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for this application only."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    delete_at_end(spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in files that outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table", partition_by: tuple = ()) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: smaller than a checkpoint, and as safe."""
    path = new_folder(df.sparkSession, name)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)


def forget_unused(spark: SparkSession) -> None:
    """Let the driver drop what earlier steps left in it: compiled plans, broadcast blocks, tracked shuffles and checkpoints.

    The JVM would keep them until its heap is full, which a driver of little memory beside Python cannot afford.
    """
    spark.sparkContext._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder of any store that Spark reads; nothing if there is none."""
    fs, at, _ = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    fs, at, jvm = _file_system(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, at):
        raise OSError(f"{path} cannot be written")


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, at, _ = _file_system(spark, path)
    fs.delete(at, True)
