"""Regression: exact linear fits from aggregated moments, MLlib trees in grouped folds, Shapley values of trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE_ALPHA = 1e-3
#: The penalties that ridge_cv_each_group() chooses from.
CV_ALPHAS = tuple(np.logspace(-6, 6, 25).tolist())


def moments(df: DataFrame, features: list[str], target: str, keys: list[str] | None = None) -> DataFrame:
    """One row (a key): n, sums and products of the features and the target; partial sums leave each task."""
    cols = [F.col(c).cast("double") for c in [*features, target]]
    k = len(cols)
    products = [F.sum(cols[i] * cols[j]).alias(f"p_{i}_{j}") for i in range(k) for j in range(i, k)]
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)], *products)


def _solve(row, k: int, alpha: float) -> np.ndarray:
    """Intercept and weights; the intercept is not penalised; least norm where the fit is not unique."""
    gram = np.zeros((k + 1, k + 1))
    gram[0, 0] = row["n"]
    for i in range(k):
        gram[0, i + 1] = gram[i + 1, 0] = row[f"s_{i}"]
        for j in range(i, k):
            gram[i + 1, j + 1] = gram[j + 1, i + 1] = row[f"p_{i}_{j}"]
    right = np.array([row[f"s_{k}"], *[row[f"p_{i}_{k}"] for i in range(k)]])
    penalty = np.diag([0.0] + [alpha] * k)
    return np.linalg.lstsq(gram + penalty, right, rcond=None)[0]


def linear_fit(df: DataFrame, features: list[str], target: str, alpha: float = 0.0) -> np.ndarray:
    """(intercept, weights ...) of least squares, or of ridge with alpha > 0: one row of moments reaches the driver."""
    return _solve(moments(df, features, target).first().asDict(), len(features), alpha)


def linear_predict(df: DataFrame, features: list[str], weights: np.ndarray, name: str = "prediction"):
    out = F.lit(float(weights[0]))
    for c, w in zip(features, weights[1:], strict=True):
        out = out + F.col(c) * float(w)
    return df.withColumn(name, out)


def leave_one_group_out(df: DataFrame, key: str, feature: str, target: str, alpha: float = RIDGE_ALPHA, name: str = "prediction") -> DataFrame:
    """Ridge on one feature, fitted without the row's group: total moments less the group's own, in closed form."""
    x, y = F.col(feature).cast("double"), F.col(target).cast("double")
    sums = {"n": F.count("*").cast("double"), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(x * x), "xy": F.sum(x * y)}
    own = df.groupBy(key).agg(*[e.alias(f"own_{k}") for k, e in sums.items()])
    total = own.agg(*[F.sum(f"own_{k}").alias(f"all_{k}") for k in sums])
    rest = own.crossJoin(F.broadcast(total)).select(key, *[(F.col(f"all_{k}") - F.col(f"own_{k}")).alias(k) for k in sums])  # one row
    slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("xx") - F.col("x") * F.col("x") / F.col("n") + alpha)
    fits = rest.withColumn("slope", slope).withColumn("intercept", (F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).select(key, "slope", "intercept")
    return df.join(fits, key).withColumn(name, F.col("intercept") + F.col("slope") * F.col(feature)).drop("slope", "intercept")


def fit_each_group(df: DataFrame, key: str, features: list[str], target: str, name: str = "prediction") -> DataFrame:
    """In-sample least squares of every group: groups' moments are aggregated, solved in batches, and joined back."""
    k = len(features)
    kind = dict(df.dtypes)[key]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fits = [_solve(r, k, 0.0).tolist() for r in pdf.to_dict("records")]
            yield pd.DataFrame({key: pdf[key], "__w": fits})

    weights = moments(df, features, target, [key]).mapInPandas(solve, f"{key} {kind}, __w array<double>")
    out = F.col("__w")[0]
    for i, c in enumerate(features):
        out = out + F.col("__w")[i + 1] * F.col(c)
    return df.join(weights, key).withColumn(name, out).drop("__w")


def ridge_cv_each_group(df: DataFrame, key: str, order: list[str], features: list[str], target: str, alphas: tuple[float, ...] = CV_ALPHAS, scaled: bool = True, name: str = "prediction") -> DataFrame:
    """(key, order ..., target, prediction, alpha): in-sample ridge of every group, its alpha that of the least squared error
    of leaving single rows out, the first of equals. A group, such as a structure, fits a task.

    The errors come in closed form from one decomposition a group. scaled: features as z-scores within the group. Rows
    with a null take no part and have no row in the result.
    """
    rows = df.select(key, *order, *features, target).dropna(subset=[*features, target])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[features].to_numpy(float), pdf[target].to_numpy(float)
        x, n = x - x.mean(axis=0), len(y)
        if scaled:
            deviation = x.std(axis=0)
            x = x / np.where(deviation > 0, deviation, 1.0)
        left, s, _ = np.linalg.svd(x, full_matrices=False)
        centred, best = y - y.mean(), None
        for alpha in alphas:
            shrink = s * s / (s * s + alpha)
            fit = left @ (shrink * (left.T @ centred))
            rest = 1.0 - 1.0 / n - (left * left) @ shrink
            error = float(np.mean(((centred - fit) / np.where(np.abs(rest) > 1e-12, rest, 1.0)) ** 2))
            if best is None or error < best[0]:
                best = error, alpha, fit
        out = pdf[[key, *order, target]].copy()
        out[name], out["alpha"] = best[2] + y.mean(), best[1]
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (key, *order, target)], f"{name} double", "alpha double"])
    return rows.groupBy(key).applyInPandas(run, schema)


def affine_rescale(df: DataFrame, keys: list[str], target: str, prediction: str, name: str = "rescaled") -> DataFrame:
    """The prediction mapped within keys by the least-squares line to the target; its mean where it is flat."""
    x, y = F.col(prediction), F.col(target)
    lines = df.groupBy(*keys).agg(F.covar_pop(x, y).alias("__c"), F.var_pop(x).alias("__v"), F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    slope = F.when(F.col("__v") > 0, F.col("__c") / F.nullif(F.col("__v"), F.lit(0.0))).otherwise(0.0)
    return df.join(lines, keys).withColumn(name, F.col("__y") + slope * (x - F.col("__x"))).drop("__c", "__v", "__x", "__y")


def max_features(text: str | None) -> str:
    """The name of MLlib's subset rule for none, all, 1.0, sqrt, log2, a fraction or a count."""
    if text is None or str(text).lower() in ("none", "all", "1.0"):
        return "all"
    if str(text).lower() in ("sqrt", "log2"):
        return str(text).lower()
    value = float(text)
    if value <= 0:
        raise ValueError(f"bad number of features {text!r}")
    return str(value) if value < 1 else str(int(value))


def tree_model(kind: str, features: str = "features", target: str = "target", trees: int = 100, depth: int = 12, leaf: int = 2, subset: str | None = "sqrt", seed: int = 42, rate: float = 0.05):
    """An MLlib regressor: rf, extra_trees (a forest without bootstrap, the nearest there is), gbt or hgbt."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    common = {"featuresCol": features, "labelCol": target, "maxDepth": min(depth, 30), "minInstancesPerNode": leaf, "seed": seed}
    if kind in ("rf", "extra_trees"):
        return RandomForestRegressor(numTrees=trees, featureSubsetStrategy=max_features(subset), bootstrap=kind == "rf", **common)
    if kind in ("gbt", "hgbt"):
        return GBTRegressor(maxIter=trees, stepSize=rate, subsamplingRate=0.8 if kind == "gbt" else 1.0, **common)
    if kind == "xgb":
        raise ValueError("xgboost is not installed")
    raise ValueError(f"unknown model {kind!r}")


def cross_validated(df: DataFrame, features: list[str], target: str, folds: list[int], make, name: str = "prediction") -> DataFrame:
    """df (with the column fold) and out-of-fold predictions: one distributed fit a fold. make(fold) gives a regressor."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("target", F.col(target).cast("double")))
    parts = [make(f).fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f)).withColumnRenamed("prediction", name) for f in folds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("features", "target")


# --- Shapley values of trees ------------------------------------------------------------------------------------------


def tree_tables(model) -> tuple[list[dict], list[float]]:
    """The model's trees as arrays (left, right, feature, threshold, value, cover) and their weights."""
    tables = []
    for tree in model.trees:
        nodes: list[tuple] = []

        def walk(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append(None)
            cover = float(node.impurityStats().count())
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, -1, -1, 0.0, node.prediction(), cover)
            else:
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[at] = (left, right, split.featureIndex(), split.threshold(), node.prediction(), cover)
            return at

        walk(tree._call_java("rootNode"))
        columns = np.array(nodes, float).T
        tables.append({k: (c.astype(int) if i < 3 else c) for i, (k, c) in enumerate(zip(("left", "right", "feature", "threshold", "value", "cover"), columns, strict=True))})
    weights = list(model.treeWeights)
    return tables, weights if "GBT" in type(model).__name__ else [w / sum(weights) for w in weights]


def tree_shap(tree: dict, x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values of one tree for one row, or for each of many.

    Each leaf is a product over the features on its path: one minus or plus the share of rows that follow. The value of
    a feature is the sum over leaves of its marginal in that product, with the Shapley weight of each subset size, which
    comes from the coefficients of the polynomial of the other features. All rows go through a leaf at once.
    """
    rows = np.atleast_2d(x)
    phi = np.zeros(rows.shape)
    leaves: list[tuple[int, dict]] = []
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        if tree["left"][node] < 0:
            leaves.append((node, path))
            continue
        f = tree["feature"][node]
        below = rows[:, f] <= tree["threshold"][node]
        for child, follows in ((tree["left"][node], below), (tree["right"][node], ~below)):
            zero, one = path.get(f, (1.0, 1.0))
            stack.append((child, path | {f: (zero * tree["cover"][child] / tree["cover"][node], one * follows)}))
    for node, path in leaves:
        fs = list(path)
        m = len(fs)
        weight = np.array([1.0 / (m * _choose(m - 1, s)) for s in range(m)])
        for f in fs:
            poly = np.zeros((len(rows), m))
            poly[:, 0] = 1.0
            for g in fs:
                if g != f:
                    longer = poly * path[g][0]
                    longer[:, 1:] += poly[:, :-1] * np.reshape(path[g][1], (-1, 1))
                    poly = longer
            phi[:, f] += tree["value"][node] * (path[f][1] - path[f][0]) * (poly @ weight)
    return phi if np.ndim(x) > 1 else phi[0]


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def shapley(df: DataFrame, model, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, shap array, shap_abs, shap_sum) of each row, by batches; the trees travel with the function."""
    trees, weights = tree_tables(model)
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = pdf[features].to_numpy(float)
            values = sum((w * tree_shap(t, x) for t, w in zip(trees, weights, strict=True)), np.zeros(x.shape))
            yield pdf[keep].assign(shap=list(values), shap_abs=np.abs(values).sum(axis=1), shap_sum=values.sum(axis=1))

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], "shap array<double>, shap_abs double, shap_sum double"])
    return df.select(*dict.fromkeys([*keep, *features])).mapInPandas(run, schema)


def importance(shap: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): mean absolute Shapley value."""
    means = shap.agg(*[F.avg(F.abs(F.col("shap")[i])).alias(c) for i, c in enumerate(features)])
    return means.unpivot([], features, "feature", "importance")
