"""A stream of structure files: each micro-batch goes through the batch operators and is appended to a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..features import features_for_residues
from ..plans.config import FeatureConfig
from ..sources import pdb


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.pdb", files_per_batch: int = 1000) -> DataFrame:
    """(path, value) of whole files as they arrive."""
    reader = spark.readStream.option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("path"), "value")


def write_features(spark: SparkSession, folder: str, out: str, checkpoint: str, config: FeatureConfig, pattern: str = "*.pdb") -> StreamingQuery:
    """Runs over what there is and stops. A batch writes to a folder of its number, so a repeated batch replaces itself."""

    def batch(files: DataFrame, number: int) -> None:
        table = features_for_residues(pdb.parse_atoms(pdb.lines(files)), config)
        table.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = file_stream(spark, folder, pattern).writeStream.foreachBatch(batch)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
