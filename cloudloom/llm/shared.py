"""Helpers that several training-data operators use: tables, materialisation, blocked-out folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where written tables go when the session names no shared folder (single-machine tests).
LOCAL_SHARED = "/tmp/checkpoints"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The separator sets that the contracts name, as regular expressions valid in Java and RE2.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application that driver and executors share, below spark.checkpoint.dir; it goes when the driver
    ends. Where that is unset, a single machine takes a folder of its own and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{root or LOCAL_SHARED}/{spark.sparkContext.applicationId}"
    files, folder = _file_system(spark, path)
    files.deleteOnExit(folder)
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives a lost executor.

    The shuffle files of the write are dropped once it is complete. done are written tables that only df needed; they
    are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    for old in done:
        for file in {f.rpartition("/")[0] for f in old.inputFiles()}:
            if "/" + spark.sparkContext.applicationId + "/" in file:
                files, folder = _file_system(spark, file)
                files.delete(folder, True)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c):
    """A-Z lower-cased and nothing else. lower() does it where a text has only one-byte characters."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def public_tokenizer(name: str) -> str:
    """Path of an installed public vocabulary file; the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)
