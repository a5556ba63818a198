"""A small run from structure files to a cross-validated summary: leave-one-structure-out ridge on spectral features."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import features_for_residues
from .functions import metrics
from .operators import models
from .plans.config import FeatureConfig
from .sources import pdb, sinks

CONFIG = FeatureConfig((4.0, 6.0, 8.0), "center_labeled", "both")


def leave_one_out(table: DataFrame, names: list[str], target: str) -> DataFrame:
    """Predictions of each structure by a ridge fitted on the others: one fit for each of the few structures."""
    ids = [r[0] for r in table.select("protein_id").distinct().orderBy("protein_id").collect()]
    parts = []
    for i in ids:
        weights = models.linear_fit(table.where(F.col("protein_id") != i), names, target, models.RIDGE_ALPHA)
        parts.append(models.linear_predict(table.where(F.col("protein_id") == i), names, weights))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run(spark: SparkSession, folder: str, out_dir: str) -> dict:
    table = features_for_residues(pdb.read_structures(spark, folder), CONFIG).cache()
    sinks.write_features(table, str(Path(out_dir, "features")), CONFIG.names(), "csv")
    sinks.write_sidecars(out_dir, CONFIG)
    out = leave_one_out(table, CONFIG.names(), "z_b_factor")
    order, keys = ["residue_index"], ["protein_id"]
    scores = metrics.pearson(out, keys, "z_b_factor", "prediction", order).join(metrics.spearman(out, keys, "z_b_factor", "prediction", order), keys)
    scores = scores.join(metrics.rmse(out, keys, "z_b_factor", "prediction"), keys).join(out.groupBy(*keys).agg(F.count("*").alias("n_residues")), keys)
    sinks.write_metrics(scores, str(Path(out_dir, "metrics")))
    total = scores.agg(F.count("*").alias("n_proteins"), F.sum("n_residues").alias("n_residues"), *[F.avg(c).alias(f"mean_{c}") for c in ("pearson", "spearman", "rmse")])
    return total.first().asDict() | {"n_features": len(CONFIG.names())}
