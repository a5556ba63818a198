"""Queries on models, folds and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, windows
from ..operators import models, protocols, resampling, spectral
from ..plans.config import FeatureConfig
from .common import items, points, residues, rounded, table

SUPP = ["l_suppkey"]


def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled least squares of price on quantity: the fit's predictions by quantity."""
    li = items(spark, sf_dir)
    weights = models.linear_fit(li, ["l_quantity"], "l_extendedprice")
    return rounded(models.linear_predict(li.select("l_quantity").distinct(), ["l_quantity"], weights), 4)


def ridge_lopo_1feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.leave_one_group_out(items(spark, sf_dir), "l_suppkey", "l_quantity", "l_extendedprice")
    return rounded(out.select("l_suppkey", "l_quantity", "prediction").distinct().groupBy("l_suppkey").agg(F.sum("prediction").alias("sum_prediction")), 2)


def per_group_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = models.fit_each_group(items(spark, sf_dir), "l_suppkey", ["l_quantity"], "l_extendedprice")
    return rounded(fitted.groupBy("l_suppkey").agg(F.avg("prediction").alias("mean_prediction"), F.stddev_pop("prediction").alias("sd_prediction")), 3)


def affine_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.affine_rescale(items(spark, sf_dir), SUPP, "l_extendedprice", "l_quantity")
    return rounded(out.groupBy("l_suppkey").agg(F.avg("rescaled").alias("mean_rescaled"), F.max("rescaled").alias("max_rescaled")), 3)


def _group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = residues(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("m"))
    return means.select(windows.position([], ["user_id"]).cast("long").alias("pos"), "m")


def bootstrap_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _group_means(spark, sf_dir)
    return rounded(resampling.bootstrap_samples(means, "m", "pos", resampling.VALIDATION_REPS, means.count()))


def bootstrap_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _group_means(spark, sf_dir)
    samples = resampling.bootstrap_samples(means, "m", "pos", resampling.VALIDATION_REPS, means.count())
    return rounded(resampling.bootstrap_p_value(samples, 50.0, "greater"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir)
    per_group = metrics.pearson(li, SUPP, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"]).withColumn("part", F.col("l_suppkey") % 3)
    return rounded(resampling.bootstrap_mean(per_group, "pearson", ["part"]))


def kfold_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.modulo_folds(table(spark, sf_dir, "customer"), "c_custkey", 5).select("c_custkey", F.col("fold").cast("long").alias("fold"))


def kfold_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.group_folds(residues(spark, sf_dir), "user_id", 5, 42).select("event_id", "user_id", "fold")


def kfold_shuffled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each fold, and the most folds that one group is in."""
    folded = resampling.group_folds(residues(spark, sf_dir), "user_id", 5, 42).groupBy("user_id").agg(F.min("fold").alias("fold"), F.countDistinct("fold").alias("n"))
    return folded.groupBy("fold").agg(F.count("*").alias("n_groups"), F.max("n").alias("folds_of_a_group"))


def kfold_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.hashed_folds(residues(spark, sf_dir), ["event_id"], 10).select("event_id", "fold")


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    li = items(spark, sf_dir).withColumn("fold", F.col("l_suppkey") % 2)
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "fold"), ["l_quantity", "l_discount", "l_tax"]


def rf_grouped_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _training(spark, sf_dir)
    out = models.cross_validated(rows, names, "l_extendedprice", [0, 1], lambda f: models.tree_model("rf", trees=10, depth=6, seed=42))
    return rounded(metrics.rmse(out, ["fold"], "l_extendedprice", "prediction"), 3)


def gbt_grouped_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _training(spark, sf_dir)
    out = models.cross_validated(rows, names, "l_extendedprice", [0, 1], lambda f: models.tree_model("gbt", trees=5, depth=3, seed=42 + f))
    return rounded(metrics.rmse(out, ["fold"], "l_extendedprice", "prediction"), 3)


def shap_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    pts = points(spark, sf_dir)
    table0 = spectral.degree0(pts, [0.15, 0.20], "center_labeled").groupBy("grp", "center").agg(
        *[F.max(F.when(F.col("radius") == r, F.col(c))).alias(f"{c}_{i}") for i, r in enumerate((0.15, 0.20)) for c in ("max", "mean", "std")]
    )
    names = [c for c in table0.columns if c not in ("grp", "center")]
    rows = table0.join(pts.select("grp", F.col("id").alias("center"), F.col("z").alias("target")), ["grp", "center"])
    model = models.tree_model("rf", trees=5, depth=4).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    shap = models.shapley(rows, model, names, ["grp", "center"])
    return rounded(models.importance(shap, names))


def linear_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of pooled and per-group least squares, scaled and rescaled in seven ways."""
    return rounded(protocols.linear_audit(items(spark, sf_dir), "l_suppkey", ["l_quantity", "l_discount"], "l_extendedprice", ["l_orderkey", "l_linenumber"]))


def dataset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir).withColumn("prediction", F.col("l_quantity") * 1500)
    return rounded(protocols.dataset_summary(li, "l_suppkey", "l_linestatus", "l_extendedprice", "prediction", ["l_orderkey", "l_linenumber"]), 5)


def split_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _training(spark, sf_dir)
    make = lambda f: models.tree_model("rf", trees=3, depth=4, seed=42 + f)
    sets = {"one": names[:1], "all": names}
    return rounded(protocols.split_controls(rows.drop("fold"), "l_suppkey", ["l_orderkey", "l_linenumber"], sets, "l_extendedprice", ["l_orderkey", "l_linenumber"], 2, make), 4)


def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir).withColumn("top", F.col("l_quantity") >= 40).withColumn("cheap", F.col("l_discount") >= 0.05)
    order = ["l_orderkey", "l_linenumber"]
    return rounded(protocols.validation_metrics(li, "l_suppkey", order, {"discount": ("l_quantity", "l_discount")}, "top", ["l_extendedprice"], ["cheap"]))


def validation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir).withColumn("top", F.col("l_quantity") >= 40).withColumn("cheap", F.col("l_discount") >= 0.05)
    values = protocols.validation_values(li, "l_suppkey", ["l_orderkey", "l_linenumber"], {"discount": ("l_quantity", "l_discount")}, "top", ["l_extendedprice"], ["cheap"])
    return rounded(protocols.validation_table(values, "l_suppkey", {"spearman_discount": "less", "odds_cheap": "two-sided"}))


def per_group_ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = models.ridge_cv_each_group(items(spark, sf_dir), "l_suppkey", ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rounded(made)


def named_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = FeatureConfig((6.0, 6.5), "constant", "std", (0, 1), (0.0, 0.5))
    return spark.createDataFrame([(i, n) for i, n in enumerate(config.names())], "position long, name string")


QUERIES = {
    f.__name__: f
    for f in (
        ols_simple, ridge_lopo_1feature, per_group_ols, affine_rescale, bootstrap_lcg, bootstrap_pvalue, bootstrap_ci, kfold_mod, kfold_shuffled, kfold_shuffled_sizes,
        kfold_hashed, rf_grouped_cv, gbt_grouped_cv, shap_abs, linear_audit, dataset_metrics, split_controls, validation_metrics, validation_table, per_group_ridge_cv,
        named_config,
    )
}

_FIT = "regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i"
_MEANS = "WITH g AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS pos, avg(value) AS m FROM events GROUP BY user_id), n AS (SELECT count(*) AS n FROM g)"
_DRAWS = """, d AS (SELECT b AS rep, ((b * 1103515245 + k * 12345 + 12345) % 2147483648) % n AS pos FROM range(1000) t(b), n, LATERAL (SELECT unnest(range(n)) AS k)),
samples AS (SELECT rep, avg(m) AS mean FROM d JOIN g USING (pos) GROUP BY rep)"""

ORACLE = {
    "ols_simple": f"WITH f AS (SELECT {_FIT} FROM lineitem) SELECT DISTINCT l_quantity, round(i + s * l_quantity, 4) AS prediction FROM lineitem, f",
    "ridge_lopo_1feature": """WITH o AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem GROUP BY l_suppkey),
t AS (SELECT sum(n) AS tn, sum(x) AS tx, sum(y) AS ty, sum(xx) AS txx, sum(xy) AS txy FROM o),
r AS (SELECT l_suppkey, CAST(tn - n AS DOUBLE) AS n, tx - x AS x, ty - y AS y, txx - xx AS xx, txy - xy AS xy FROM o, t),
f AS (SELECT l_suppkey, (xy - x * y / n) / (xx - x * x / n + CAST(0.001 AS DOUBLE)) AS s, x, y, n FROM r)
SELECT l_suppkey, round(sum((y - s * x) / n + s * l_quantity), 2) AS sum_prediction FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem) JOIN f USING (l_suppkey) GROUP BY l_suppkey""",
    "per_group_ols": f"WITH f AS (SELECT l_suppkey, {_FIT} FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(avg(i + s * l_quantity), 3) AS mean_prediction, round(stddev_pop(i + s * l_quantity), 3) AS sd_prediction FROM lineitem JOIN f USING (l_suppkey) GROUP BY l_suppkey",
    "affine_rescale": f"WITH f AS (SELECT l_suppkey, {_FIT} FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(avg(i + s * l_quantity), 3) AS mean_rescaled, round(max(i + s * l_quantity), 3) AS max_rescaled FROM lineitem JOIN f USING (l_suppkey) GROUP BY l_suppkey",
    "bootstrap_lcg": _MEANS + _DRAWS + " SELECT rep, round(mean, 6) AS mean FROM samples",
    "bootstrap_pvalue": _MEANS + _DRAWS + " SELECT round(least(1, CAST(1 + count(*) FILTER (WHERE mean <= 50) AS DOUBLE) / (count(*) + 1)), 6) AS p FROM samples",
    "validation_metrics": """WITH f AS (SELECT *, l_quantity >= 40 AS top, l_discount >= CAST(0.05 AS DOUBLE) AS cheap FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + CAST(count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1 AS DOUBLE) / 2 AS rq,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + CAST(count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1 AS DOUBLE) / 2 AS rd,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + CAST(count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1 AS DOUBLE) / 2 AS rp FROM f),
g AS (SELECT l_suppkey, covar_pop(rq, rd) / nullif(stddev_pop(rq) * stddev_pop(rd), 0) AS s,
  (sum(rp) FILTER (WHERE top) - CAST(count(*) FILTER (WHERE top) AS DOUBLE) * (count(*) FILTER (WHERE top) + 1) / 2) / nullif(count(*) FILTER (WHERE top) * count(*) FILTER (WHERE NOT top), 0) AS a,
  CASE WHEN count(*) FILTER (WHERE top) >= 2 AND count(*) FILTER (WHERE NOT top) >= 2 THEN (avg(l_extendedprice) FILTER (WHERE top) - avg(l_extendedprice) FILTER (WHERE NOT top)) / nullif(sqrt((var_samp(l_extendedprice) FILTER (WHERE top) + var_samp(l_extendedprice) FILTER (WHERE NOT top)) / 2), 0) END AS m,
  (count(*) FILTER (WHERE top AND cheap) + CAST(0.5 AS DOUBLE)) * (count(*) FILTER (WHERE NOT top AND NOT cheap) + CAST(0.5 AS DOUBLE)) / ((count(*) FILTER (WHERE cheap AND NOT top) + CAST(0.5 AS DOUBLE)) * (count(*) FILTER (WHERE top AND NOT cheap) + CAST(0.5 AS DOUBLE))) AS o FROM r GROUP BY l_suppkey)
SELECT 'spearman_discount' AS metric, round(avg(s), 6) AS estimate FROM g UNION ALL SELECT 'auc_l_extendedprice', round(avg(a), 6) FROM g
UNION ALL SELECT 'smd_l_extendedprice', round(avg(m), 6) FROM g UNION ALL SELECT 'odds_cheap', round(avg(o), 6) FROM g""",
    "kfold_mod": "SELECT c_custkey, c_custkey % 5 AS fold FROM customer",
    "kfold_shuffled_sizes": """WITH g AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT f AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS n_groups, CAST(1 AS BIGINT) AS folds_of_a_group FROM g, range(5) t(f)""",
    "named_config": """SELECT row_number() OVER (ORDER BY r, p, d, s) - 1 AS position, 'r' || ['6', '6p5'][r] || '_p' || ['0', '0p5'][p] || '_d' || (d - 1) || '_' || ['max', 'min', 'mean', 'std', 'zeros'][s] AS name
FROM range(1, 3) a(r), range(1, 3) b(p), range(1, 3) c(d), range(1, 6) e(s)""",
}
