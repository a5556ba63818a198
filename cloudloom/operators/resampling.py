"""Folds and bootstrap: shuffled K-fold of groups or rows, leave-one-out, resampled means and their p-values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Repetitions and seeds of the two bootstrap protocols, and the reported quantiles.
CI_REPS, CI_SEED = 2000, 20260504
VALIDATION_REPS = 1000
CI_QUANTILES = (0.025, 0.975)


def fold_numbers(n: int, k: int, seed: int) -> np.ndarray:
    """Folds of 0..n-1 after a seeded shuffle; the first n mod k folds are one larger."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    fold = np.empty(n, np.int64)
    fold[order] = np.repeat(np.arange(k), [n // k + (i < n % k) for i in range(k)])
    return fold


def group_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """df with fold: shuffled K-fold over its distinct keys in order. The permutation is made on the driver, one number a
    key: for groups, such as structures, of which there are far fewer than rows. hashed_folds() has no such limit."""
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).collect()]
    if len(keys) < k:
        raise ValueError(f"{len(keys)} groups are too few for {k} folds")
    folds = pd.DataFrame({key: keys, "fold": fold_numbers(len(keys), k, seed)})
    schema = f"{key} {dict(df.dtypes)[key]}, fold long"
    return df.join(df.sparkSession.createDataFrame(folds, schema), key)


def hashed_folds(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """df with fold from a hash of the columns: groups or rows, at any size, without a shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(k)))


def modulo_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.col(key), F.lit(k)))


def bootstrap_mean(values: DataFrame, value: str, keys: list[str], reps: int = CI_REPS, seed: int = CI_SEED) -> DataFrame:
    """(keys, mean, low, high, n) of group metrics: percentile interval of resampled means, by NumPy's generator.

    values are metrics of groups, one row each and ordered by value, so a key's rows fit a task. No row: nulls.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].dropna().to_numpy(float))
        row = {k: pdf[k].iloc[0] for k in keys}
        if len(x):
            rng = np.random.default_rng(seed)
            means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(reps)])
            row |= {"mean": x.mean(), "low": np.quantile(means, CI_QUANTILES[0]), "high": np.quantile(means, CI_QUANTILES[1]), "n": len(x)}
        else:
            row |= {"mean": None, "low": None, "high": None, "n": 0}
        return pd.DataFrame([row])

    kinds = dict(values.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "mean double, low double, high double, n long"])
    return values.groupBy(*keys).applyInPandas(run, schema)


def bootstrap_samples(values: DataFrame, value: str, position: str, reps: int, n: int) -> DataFrame:
    """(rep, mean) of resamples drawn by a fixed integer recurrence on (rep, position): the same in any SQL engine. The
    draws are a test device, not a random sample."""
    spark, block = values.sparkSession, 4096  # positions of a sequence, so that none holds all of them
    steps = lambda a, b, by=1: F.explode(F.sequence(a, b, F.lit(by).cast("long")))
    last = F.lit(max(n, 1) - 1).cast("long")
    draws = spark.range(reps if n else 0).select(F.col("id").alias("rep"), steps(F.lit(0).cast("long"), last, block).alias("b"))
    draws = draws.select("rep", steps(F.col("b"), F.least(F.col("b") + block - 1, last)).alias("k"))
    index = ((F.col("rep") * 1103515245 + F.col("k") * 12345 + 12345) % 2147483648) % max(n, 1)
    # the draws, reps times as many as the values, look small to the optimizer, which would send them to the driver to broadcast
    return draws.select("rep", index.alias(position)).join(values.hint("shuffle_hash"), position).groupBy("rep").agg(F.avg(value).alias("mean"))


def bootstrap_p_value(samples: DataFrame, null_value: float, alternative: str, observed: float | None = None) -> DataFrame:
    """One row (p): the share of resampled means at or beyond the null value, counted with one more.

    two-sided counts the means no further from the observed value than the null value is from zero.
    """
    m, null = F.col("mean"), F.lit(null_value)
    if alternative == "two-sided":
        if observed is None:
            raise ValueError("two-sided needs the observed value")
        beyond = F.count_if(F.abs(m - observed) <= F.abs(null))
    elif alternative in ("greater", "less"):
        beyond = F.count_if(m <= null if alternative == "greater" else m >= null)
    else:
        raise ValueError(f"unknown alternative {alternative!r}")
    return samples.agg(((1 + beyond) / (F.count("mean") + 1)).alias("p"))


def bootstrap_tests(values: DataFrame, tests: DataFrame, order: list[str], reps: int = VALIDATION_REPS, seed: int = CI_SEED) -> DataFrame:
    """(metric, estimate, low, high, p) of group metrics (metric, v, order ...) and tests (metric, alternative, null_value).

    The mean over the groups where v is finite, its percentile interval, and the p-value of bootstrap_p_value(); every
    metric starts the generator again. A metric's rows, one a group, fit a task. No finite value: nulls.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)["v"].to_numpy(float)
        x, first = x[np.isfinite(x)], pdf.iloc[0]
        row = {"metric": first["metric"], "estimate": None, "low": None, "high": None, "p": None}
        if len(x):
            rng, seen = np.random.default_rng(seed), x.mean()
            means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(reps)])
            null = first["null_value"]
            beyond = {"greater": means <= null, "less": means >= null, "two-sided": np.abs(means - seen) <= abs(null)}[first["alternative"]]
            low, high = np.quantile(means, CI_QUANTILES)
            row |= {"estimate": seen, "low": low, "high": high, "p": (1 + beyond.sum()) / (reps + 1)}
        return pd.DataFrame([row])

    return values.join(F.broadcast(tests), "metric").groupBy("metric").applyInPandas(run, "metric string, estimate double, low double, high double, p double")  # a row a metric
