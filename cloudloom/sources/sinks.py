"""Writers: feature tables, sidecars, per-group caches, manifests, metrics and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import short_number
from ..operators.alignment import not_yet
from ..plans.config import FeatureConfig


def write_features(df: DataFrame, path: str, names: list[str], form: str = "parquet") -> int:
    """Writes the table and returns its rows, counted as they are written."""
    if missing := set(names) - set(df.columns):
        raise ValueError(f"missing features {sorted(missing)}")
    seen = Observation("rows")
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)
    return int(seen.get["n"])


def write_sidecars(folder: str, config: FeatureConfig) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "config.json").write_text(config.to_json() + "\n")
    Path(folder, "feature_names.json").write_text(json.dumps(config.names(), indent=2) + "\n")


def write_missing(df: DataFrame, path: str, key: str, force: bool = False) -> DataFrame:
    """Adds the groups that the partitioned table lacks (all with force, replacing theirs). Returns (key, n, status), which
    is written beside the table first, as of before the write."""
    spark = df.sparkSession
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = df.select(key).limit(0)
    fresh = df if force else not_yet(df, [key], done)
    manifest = counts.join(done.withColumn("__d", F.lit(True)), key, "left")
    manifest = manifest.select(key, "n", F.when(F.col("__d").isNull() | F.lit(force), "generated").otherwise("cached").alias("status"))
    manifest.write.mode("overwrite").parquet(f"{path.rstrip('/')}_manifest")
    fresh.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(key).parquet(path)
    return spark.read.parquet(f"{path.rstrip('/')}_manifest")


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_evaluation(per_group: DataFrame, summary: DataFrame, folder: str, name: str) -> dict:
    """cv_metrics_<name>, a CSV table of the groups, and cv_summary_<name>.json, the one row of summary, which is returned."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    write_metrics(per_group, f"{folder}/cv_metrics_{name}.csv")
    row = summary.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a summary has one row")
    Path(folder, f"cv_summary_{name}.json").write_text(json.dumps(row[0].asDict(), indent=2) + "\n")
    return row[0].asDict()


def report(title: str, rows: DataFrame, path: str | None = None, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than limit rows are refused, not cut."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report takes up to {limit} rows")
    head = "| " + " | ".join(rows.columns) + " |\n" + "|" + "---|" * len(rows.columns) + "\n"
    cell = lambda v: short_number(v) if isinstance(v, float) or v is None else str(v)
    body = "".join("| " + " | ".join(cell(v) for v in r) + " |\n" for r in found)
    text = f"# {title}\n\n{head}{body}"
    if path:
        Path(path).write_text(text)
    return text
