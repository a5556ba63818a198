"""From structures to feature tables: the package's main entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import windows
from .operators.spectral import feature_matrix, spectral_statistics
from .plans.config import FeatureConfig
from .sources.pdb import points_of


def feature_names(config: FeatureConfig) -> list[str]:
    return config.names()


def features_for_points(points: DataFrame, config: FeatureConfig) -> DataFrame:
    """(grp, id, features) of each point of (grp, id, x, y, z)."""
    return feature_matrix(spectral_statistics(points, config), config).withColumnRenamed("center", "id")


def features_for_residues(residues: DataFrame, config: FeatureConfig) -> DataFrame:
    """Residues with z_b_factor, the z-score within their structure, and their features."""
    table = features_for_points(points_of(residues), config)
    known = residues.withColumn("z_b_factor", windows.zscore("b_factor", ["protein_id"]))
    keys = table.withColumnRenamed("grp", "protein_id").withColumnRenamed("id", "residue_index")
    out = known.join(keys, ["protein_id", "residue_index"])
    lead = ["protein_id", "residue_index", "chain_id", "residue_number", "insertion_code", "residue_name", "b_factor", "z_b_factor"]
    return out.select(*lead, *[F.col(n) for n in config.names()])
