"""Within-group windows: z-scores, ranks, quantile flags, positions, standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import or_null


def zscore(value: str, keys: list[str], constant: str = "zero") -> Column:
    """(value - mean) / population deviation within keys; a constant group gives zeros or nulls."""
    if constant not in ("zero", "null"):
        raise ValueError(f"unknown rule {constant!r}")
    w, v = Window.partitionBy(*keys), or_null(F.col(value))
    sd = F.stddev_pop(v).over(w)
    flat = F.when(v.isNotNull(), F.lit(0.0)) if constant == "zero" else F.lit(None).cast("double")
    return F.when(sd > 0, (v - F.avg(v).over(w)) / sd).otherwise(flat)


def drop_flat_groups(df: DataFrame, value: str, keys: list[str], min_rows: int = 1) -> DataFrame:
    """Rows of groups with at least min_rows rows whose values are not all equal."""
    w = Window.partitionBy(*keys)
    marked = df.withColumn("__sd", F.stddev_pop(or_null(F.col(value))).over(w)).withColumn("__n", F.count("*").over(w))
    return marked.where((F.col("__sd") > 0) & (F.col("__n") >= min_rows)).drop("__sd", "__n")


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank within keys from 1, ties sharing their mean rank."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    peers = Window.partitionBy(*keys, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / 2


def quantile_flag(value: str, keys: list[str], q: float, side: str = "high") -> Column:
    """value at or beyond its group's q-quantile (linear interpolation), ties included."""
    cut = F.percentile(F.col(value), F.lit(q)).over(Window.partitionBy(*keys))
    return F.col(value) >= cut if side == "high" else F.col(value) <= cut


def position(keys: list[str], order: list[str]) -> Column:
    """Row position within keys, from 0."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def group_size(keys: list[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*keys))


def min_max(value: str, keys: list[str]) -> Column:
    """Finite values scaled to 0..1 within keys, null for the others; all zero where none is finite or all are nearly equal."""
    w, v = Window.partitionBy(*keys), or_null(F.col(value))
    low, high = F.min(v).over(w), F.max(v).over(w)
    apart = high - low > 1e-8 + 1e-5 * F.abs(high)  # fixed values: the tolerances of numpy.isclose
    return F.when(apart, (v - low) / (high - low)).otherwise(F.lit(0.0))


def standardised(value: str, keys: list[str]) -> Column:
    """Within-group z-score with scale 1 where the deviation is zero."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0))


def standardised_by(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """Columns scaled by the mean and population deviation of all rows, or of the rows where train holds.

    One aggregate row is joined back: no window over the whole table.
    """
    fit = df if train is None else df.where(train)
    stats = fit.agg(*[f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # a single row
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"__m_{c}")) / F.coalesce(F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(1.0)))
    return out.drop(*stats.columns)


def position_features(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """norm_index, terminal_distance, terminal_decile, length, inverse_length of each row; a group of one has span 1."""
    out = df.withColumn("__i", position(keys, order)).withColumn("length", group_size(keys).cast("double"))
    span = F.greatest(F.col("length") - 1, F.lit(1.0))
    out = out.withColumn("norm_index", F.col("__i") / span)
    out = out.withColumn("terminal_distance", F.least(F.col("__i"), span - F.col("__i")) / span)
    out = out.withColumn("terminal_decile", F.when(F.col("terminal_distance") <= 0.10, 1.0).otherwise(0.0))
    return out.withColumn("inverse_length", 1 / F.col("length")).drop("__i")


def terminal_flag(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """terminal: the fractional position is at most 0.10 or at least 0.90."""
    share = position(keys, order) / F.greatest(group_size(keys) - 1, F.lit(1))
    return df.withColumn("fraction", share).withColumn("terminal", (F.col("fraction") <= 0.10) | (F.col("fraction") >= 0.90))


def one_hot(value: str, levels: list, prefix: str) -> list[Column]:
    return [F.when(F.col(value) == F.lit(x), 1.0).otherwise(0.0).alias(f"{prefix}_{x}") for x in levels]
