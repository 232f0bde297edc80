"""Session settings, reading of tables, and cutting of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Only Spark opens the path, so any store it reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as on one machine in tests, a temporary folder
    takes its place; on a cluster executors would each write to a folder of their own.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-checkpoints-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back from there.

    Spark removes the files after their last use where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set; else they stay until the folder is cleared.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with column pruning and statistics."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``stored``, with the table's path, for ``removed``."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes the files of a table that ``stored_at`` has made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
