"""Id lists, annotation tables, one-hot tables and feature tables."""

from __future__ import annotations

import io
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import or_null
from ..operators.alignment import clean_id

# Columns of an annotation table, codes of its classes.
ANNOTATION = {"sec_type": "int", "area": "double", "packing_density1": "double", "packing_density2": "double", "packing_density3": "double", "B-factor": "double"}
CLASS_CODES = list(range(7))


def id_list(spark: SparkSession, path: str, name: str = "", priority: int = 0, drop_variant: bool = False) -> DataFrame:
    """(id, name, priority) of a text file with one id a line; blank lines are skipped."""
    ids = spark.read.text(path).select(clean_id(F.col("value"), drop_variant).alias("id")).where(F.col("id") != "").distinct()
    return ids.select("id", F.lit(name).alias("name"), F.lit(priority).alias("priority"))


def annotations(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Rows of per-structure CSV files with pdbid, position and n_residues; one-hot files are left out.

    position and n_residues count all rows of a file; infinite and NaN values become null.
    """
    raw = spark.read.text(folder, pathGlobFilter=pattern)
    file = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.csv$", "")
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = raw.select(file.alias("pdbid"), F.monotonically_increasing_id().alias("__row"), cells.alias("__v")).where(~F.col("pdbid").endswith("-onehot"))
    w = Window.partitionBy("pdbid")
    rows = rows.withColumn("position", F.row_number().over(w.orderBy("__row")) - 2).withColumn("__h", F.first("__v").over(w.orderBy("__row")))
    rows = rows.withColumn("n_residues", F.count("*").over(w) - 1)
    bad = rows.where((F.col("position") == -1) & (F.size(F.array_except(F.array(*[F.lit(c) for c in ANNOTATION]), "__h")) > 0))
    if first := bad.select("pdbid", "__h").limit(1).collect():
        raise ValueError(f"missing columns in {first[0]['pdbid']}: {sorted(set(ANNOTATION) - set(first[0]['__h']))}")
    cell = lambda c: F.get("__v", F.array_position("__h", c).cast("int") - 1).try_cast(ANNOTATION[c])
    rows = rows.where("position >= 0")
    return rows.select("pdbid", "position", "n_residues", cell("sec_type").alias("sec_type"), *[or_null(cell(c)).alias(c) for c in ANNOTATION if c != "sec_type"])


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def one_hot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(pdbid, position, features): header-less numeric CSV files named <id>-onehot.csv."""
    raw = spark.read.text(folder, pathGlobFilter="*-onehot.csv")
    file = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"-onehot\.csv$", "")
    rows = raw.select(file.alias("pdbid"), F.monotonically_increasing_id().alias("__row"), F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double")).alias("features"))
    return rows.select("pdbid", (F.row_number().over(Window.partitionBy("pdbid").orderBy("__row")) - 1).alias("position"), "features")


def paired(features: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """(pdbid, position, features, raw, target) of structures that both sides have with equal counts of rows, and whose target
    varies: rows (pdbid, position, features) and (pdbid, position, target column), the target as a z-score within the
    structure. Null targets take no part in it and stay null."""
    left = features.select("pdbid", "position", "features", F.lit(True).alias("a"))
    right = targets.select("pdbid", "position", or_null(F.col(target).cast("double")).alias("raw"), F.lit(True).alias("b"))
    w = Window.partitionBy("pdbid")
    own = left.join(right, ["pdbid", "position"], "full").withColumn("missing", F.count_if(F.col("a").isNull() | F.col("b").isNull()).over(w)).where("missing = 0")
    own = own.withColumn("deviation", F.stddev_pop("raw").over(w)).withColumn("mean", F.avg("raw").over(w)).where("deviation > 0")
    return own.select("pdbid", "position", "features", "raw", ((F.col("raw") - F.col("mean")) / F.col("deviation")).alias("target"))


def one_hot_targets(spark: SparkSession, folder: str, target: str = "B-factor") -> DataFrame:
    """paired() one-hot files and annotation tables of a folder."""
    return paired(one_hot_rows(spark, folder), annotations(spark, folder), target)


def _matrix(suffix: str):
    """Rows (id, position, values) of the NumPy files of binaryFile rows (path, content)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                values = np.load(io.BytesIO(content), allow_pickle=False)
                values = values.reshape(len(values), -1).astype(float)
                name = path.rsplit("/", 1)[-1].removesuffix(suffix)
                for k in range(0, len(values), 4096):
                    part = values[k : k + 4096]
                    yield pd.DataFrame({"pdbid": name, "position": np.arange(k, k + len(part)), "values": part.tolist()})

    return run


def matrices(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(pdbid, position, values) of the NumPy matrices <id><suffix> of a folder; a matrix, such as a structure's, fits a task."""
    files = spark.read.format("binaryFile").load(folder, pathGlobFilter=f"*{suffix}").select("path", "content")
    return files.mapInPandas(_matrix(suffix), "pdbid string, position long, values array<double>")


def cached_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """paired() cached feature matrices and targets, <id>_psl_features.npy and <id>_bfactors.npy (fixed names)."""
    x = matrices(spark, folder, "_psl_features.npy").withColumnRenamed("values", "features")
    y = matrices(spark, folder, "_bfactors.npy").select("pdbid", "position", F.col("values")[0].alias("y"))
    return paired(x, y, "y")


def first_existing(*paths: str) -> str:
    """The first path that exists, on the driver's file system."""
    for path in paths:
        if Path(path).exists():
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def feature_names(text: str | None, width: int, default: list[str]) -> list[str]:
    """Names from a JSON list of the right length, else the default ones of that length, else numbered."""
    import json

    names = json.loads(text) if text else []
    if len(names) == width:
        return names
    return default if len(default) == width else [f"psl_feature_{i}" for i in range(width)]


def matched(records: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """(id, status) of records (id, n): ok, missing_<name> or <name>_mismatch for the first source (id, n) that differs."""
    out = records
    status = F.lit(None).cast("string")
    for name, s in sources:
        out = out.join(s.select(F.col("id"), F.col("n").alias(f"__{name}")), "id", "left")
        this = F.when(F.col(f"__{name}").isNull(), F.lit(f"missing_{name}")).when(F.col(f"__{name}") != F.col("n"), F.lit(f"{name}_mismatch"))
        status = F.coalesce(status, this)
    return out.select("id", F.coalesce(status, F.lit("ok")).alias("status"))
