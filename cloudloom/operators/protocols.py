"""Evaluation protocols: what cross-validated predictions and validation tables are summed up to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, windows
from . import models, resampling, summary


def group_metrics(predictions: DataFrame, key: str, target: str, prediction: str, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """(key, keep, pearson, spearman, rmse, n) of each group."""
    keys = [key, *(keep or [])]
    out = metrics.pearson(predictions, keys, target, prediction, order)
    out = out.join(metrics.spearman(predictions, keys, target, prediction, order), keys)
    return out.join(metrics.rmse(predictions, keys, target, prediction), keys).join(predictions.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def dataset_summary(predictions: DataFrame, key: str, label: str, target: str, prediction: str, order: list[str], reps: int = resampling.CI_REPS) -> DataFrame:
    """By label, and for all: groups, rows, mean metrics of groups with a bootstrap interval, pooled correlation and error."""
    both = predictions.unionByName(predictions.withColumn(label, F.lit("all")))
    per_group = group_metrics(both, key, target, prediction, order, [label])
    means = per_group.groupBy(label).agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.avg("pearson").alias("mean_pearson"), F.median("pearson").alias("median_pearson"),
        F.avg("spearman").alias("mean_spearman"), F.avg("rmse").alias("mean_rmse"),
    )
    interval = resampling.bootstrap_mean(per_group, "pearson", [label], reps).select(label, F.col("low").alias("pearson_low"), F.col("high").alias("pearson_high"))
    pooled = metrics.pearson(both, [label], target, prediction, order, "pooled_pearson").join(metrics.rmse(both, [label], target, prediction, "pooled_rmse"), label)
    return means.join(interval, label).join(pooled, label)


def fold_metrics(predictions: DataFrame, target: str, prediction: str, order: list[str]) -> DataFrame:
    """(fold, pearson, rmse) of each fold."""
    return metrics.pearson(predictions, ["fold"], target, prediction, order).join(metrics.rmse(predictions, ["fold"], target, prediction), "fold")


def split_controls(rows: DataFrame, key: str, row_id: list[str], feature_sets: dict[str, list[str]], target: str, order: list[str], k: int, make: Callable, seed: int = 42) -> DataFrame:
    """(features, split, mean_group_pearson, pooled_pearson, mean_fold_pearson) with folds over groups and over rows."""
    out = None
    for split, folded in (("group", resampling.hashed_folds(rows, [key], k, seed)), ("row", resampling.hashed_folds(rows, row_id, k, seed))):
        for name, features in feature_sets.items():
            made = models.cross_validated(folded, features, target, list(range(k)), make).select(key, *order, "fold", target, "prediction")
            one = metrics.pearson(made, [key], target, "prediction", order).agg(F.avg("pearson").alias("mean_group_pearson"))
            one = one.crossJoin(metrics.pearson(made, [], target, "prediction", order, "pooled_pearson"))  # single rows
            one = one.crossJoin(fold_metrics(made, target, "prediction", order).agg(F.avg("pearson").alias("mean_fold_pearson")))
            one = one.select(F.lit(name).alias("features"), F.lit(split).alias("split"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def linear_audit(rows: DataFrame, key: str, features: list[str], target: str, order: list[str]) -> DataFrame:
    """Mean and median correlation of groups under pooled fits (raw, globally and within-group scaled; raw and rescaled
    predictions) and under fits of each group (raw and scaled)."""
    scaled = {"none": rows, "global_z": windows.standardised_by(rows, features)}
    own = rows
    for c in features:
        own = own.withColumn(c, windows.standardised(c, [key]))
    scaled["group_z"] = own
    made = {("pooled", s, "none"): models.linear_predict(df, features, models.linear_fit(df, features, target)) for s, df in scaled.items()}
    for s in ("none", "global_z"):
        made["pooled", s, "affine"] = models.affine_rescale(made["pooled", s, "none"], [key], target, "prediction", "prediction")
    for s in ("none", "group_z"):
        made["per_group", s, "none"] = models.fit_each_group(scaled[s], key, features, target)
    out = None
    for (fit, s, rescale), df in made.items():
        one = summary.spread(metrics.pearson(df, [key], target, "prediction", order), ["pearson"])
        one = one.select(F.lit(fit).alias("fit"), F.lit(s).alias("scaling"), F.lit(rescale).alias("rescaling"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def validation_values(df: DataFrame, key: str, order: list[str], correlated: dict[str, tuple[str, str]], flag: str, scores: list[str], exposures: list[str]) -> DataFrame:
    """(metric, key, v) of each group: rank correlations, areas under the curve, mean differences, odds ratios."""
    parts = {f"spearman_{n}": metrics.spearman(df, [key], x, y, order, "v", ranks="all") for n, (x, y) in correlated.items()}
    parts |= {f"auc_{s}": metrics.auc(df, [key], flag, s, "v") for s in scores}
    parts |= {f"smd_{s}": metrics.mean_difference(df, [key], flag, s, "v") for s in scores}
    parts |= {f"odds_{e}": metrics.odds_ratio(df, [key], flag, e, "v") for e in exposures}
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("metric"), key, F.col("v").cast("double").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def validation_metrics(df: DataFrame, key: str, order: list[str], correlated: dict[str, tuple[str, str]], flag: str, scores: list[str], exposures: list[str]) -> DataFrame:
    """(metric, estimate): means over groups of validation_values()."""
    return validation_values(df, key, order, correlated, flag, scores, exposures).groupBy("metric").agg(F.avg("v").alias("estimate"))


def validation_table(values: DataFrame, key: str, alternatives: dict[str, str] | None = None, reps: int = resampling.VALIDATION_REPS, seed: int = resampling.CI_SEED) -> DataFrame:
    """(metric, estimate, low, high, p) of validation_values(), against no effect: 0 for correlations and differences, 0.5 for
    areas, 1 for odds ratios. The alternative is "greater" where alternatives names no other."""
    kind = F.substring_index("metric", "_", 1)
    null = F.when(kind == "auc", 0.5).when(kind == "odds", 1.0).otherwise(0.0)
    side = F.lit("greater")
    for name, other in (alternatives or {}).items():
        side = F.when(F.col("metric") == name, other).otherwise(side)
    tests = values.select("metric").distinct().select("metric", side.alias("alternative"), null.alias("null_value"))
    return resampling.bootstrap_tests(values, tests, [key], reps, seed)
