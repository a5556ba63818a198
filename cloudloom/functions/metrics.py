"""Grouped metrics. Each takes a DataFrame and group keys and gives one row a group; undefined values are null.

They are partial aggregates (or, for rank metrics, one window and an aggregate), so a group of any size is summed where
its rows are first read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import close_to, finite
from .windows import average_rank


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(finite(F.col(x)) & finite(F.col(y)))


def _correlation(x: str, y: str) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, keys: list[str], x: str, y: str, order: list[str], name: str = "pearson", guard: str = "close") -> DataFrame:
    """Correlation of finite pairs. guard 'close': null under three pairs or where all values are close to the first in
    order; 'deviation': null under two rows or where a deviation is zero, without the finite mask."""
    if guard == "deviation":
        flat = (F.count("*") < 2) | (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
        return df.groupBy(*keys).agg(F.when(~flat, _correlation(x, y)).alias(name))
    first = F.struct(*order)
    flat = F.lit(False)
    for c in (x, y):
        flat = flat | close_to(F.min(c), F.max(c), F.min_by(c, first))
    value = F.when((F.count("*") >= 3) & ~flat, F.greatest(F.least(_correlation(x, y), F.lit(1.0)), F.lit(-1.0)))
    return _all_groups(df, finite_pairs(df, x, y).groupBy(*keys).agg(value.alias(name)), keys)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, order: list[str], name: str = "spearman", ranks: str = "finite") -> DataFrame:
    """Pearson correlation of average ranks, taken of finite pairs, or of all rows before the mask (ranks 'all')."""
    rows = df if ranks == "all" else finite_pairs(df, x, y)
    ranked = rows.withColumn("__x", average_rank(x, keys)).withColumn("__y", average_rank(y, keys))
    out = pearson(finite_pairs(ranked, x, y), keys, "__x", "__y", order, name)
    return _all_groups(df, out, keys)


def rmse(df: DataFrame, keys: list[str], x: str, y: str, name: str = "rmse") -> DataFrame:
    d = F.col(x) - F.col(y)
    return _all_groups(df, finite_pairs(df, x, y).groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias(name)), keys)


def _all_groups(df: DataFrame, out: DataFrame, keys: list[str]) -> DataFrame:
    """out with a row for groups that no finite pair is left of."""
    return df.select(*keys).distinct().join(out, keys, "left") if keys else out


def auc(df: DataFrame, keys: list[str], label: str, score: str, name: str = "auc") -> DataFrame:
    """Mann-Whitney area from average ranks; null where a class is empty. label is boolean."""
    ranked = df.where(F.col(label).isNotNull() & finite(F.col(score))).withColumn("__r", average_rank(score, keys))
    pos, neg = F.count_if(F.col(label)), F.count_if(~F.col(label))
    area = (F.sum(F.when(F.col(label), F.col("__r"))) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))
    return ranked.groupBy(*keys).agg(area.alias(name))


def mean_difference(df: DataFrame, keys: list[str], label: str, value: str, name: str = "smd") -> DataFrame:
    """Standardised mean difference with sample variances; null under two rows a class or without variance."""
    side = lambda f, flag: f(F.when(flag, F.col(value)))
    yes, no = F.col(label), ~F.col(label)
    spread = F.sqrt((side(F.var_samp, yes) + side(F.var_samp, no)) / 2)
    enough = (side(F.count, yes) >= 2) & (side(F.count, no) >= 2)
    return df.groupBy(*keys).agg(F.when(enough, F.try_divide(side(F.avg, yes) - side(F.avg, no), spread)).alias(name))


def odds_ratio(df: DataFrame, keys: list[str], label: str, exposed: str, name: str = "odds_ratio") -> DataFrame:
    a, b = F.col(exposed), F.col(label)
    half = lambda c: F.count_if(c) + F.lit(0.5)
    return df.groupBy(*keys).agg((half(a & b) * half(~a & ~b) / (half(a & ~b) * half(~a & b))).alias(name))


def jaccard(df: DataFrame, keys: list[str], a: str, b: str, name: str = "jaccard") -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))).alias(name))


#: Metrics by name, for callers that choose them at run time; register() adds one of the same form.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "pearson": pearson,
    "spearman": spearman,
    "rmse": rmse,
    "auc": auc,
    "mean_difference": mean_difference,
    "odds_ratio": odds_ratio,
    "jaccard": jaccard,
}


def register(name: str, metric: Callable[..., DataFrame]) -> None:
    REGISTRY[name] = metric


def mean_over_groups(per_group: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each metric over the groups where it is defined."""
    return per_group.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
