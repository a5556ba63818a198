"""Point-cloud spectral analytics and corpus processing on Spark DataFrames."""

from .features import feature_names, features_for_points, features_for_residues
from .plans.config import FeatureConfig

__all__ = ["FeatureConfig", "feature_names", "features_for_points", "features_for_residues"]
__version__ = "0.1.0"
