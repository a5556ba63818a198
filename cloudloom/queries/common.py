"""Tables in the forms that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RADII = [0.10, 0.15, 0.20]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as point clouds: group = label, x, y, z = the first three elements."""
    xyz = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), *xyz)


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as residues: group = user_id, order = (ts, event_id)."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as residues: group = l_suppkey."""
    return table(spark, sf_dir, "lineitem")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of their sums does not show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


POINTS_SQL = """points AS (SELECT label AS grp, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
pairs AS (SELECT a.grp, a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
  FROM points a JOIN points b ON a.grp = b.grp)"""
