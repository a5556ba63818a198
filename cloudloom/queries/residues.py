"""Queries on residue tables: windows, metrics, features, summaries, set operations, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, windows
from ..functions.columns import parse_numbers
from ..operators import alignment, summary
from .common import items, residues, rounded, table

USER, ORDER = ["user_id"], ["ts", "event_id"]
SUPP = ["l_suppkey"]
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]

# --- windows ----------------------------------------------------------------------------------------------------------


def zscore_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(residues(spark, sf_dir).select("event_id", windows.zscore("value", USER).alias("z")))


def _flat_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues with a constant value in every seventh group."""
    return residues(spark, sf_dir).withColumn("value", F.when(F.col("user_id") % 7 == 0, 5.0).otherwise(F.col("value")))


def zscore_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_flat_some(spark, sf_dir).select("event_id", windows.zscore("value", USER, "null").alias("z")))


def zscore_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drop_flat_groups(_flat_some(spark, sf_dir), "value", USER, 3).select("event_id", "user_id", "value")


def minmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_flat_some(spark, sf_dir).select("event_id", windows.min_max("value", USER).alias("label")))


def global_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.standardised_by(residues(spark, sf_dir), ["value"], F.col("user_id") % 5 != 0)
    return rounded(out.select("event_id", "value"))


def group_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_flat_some(spark, sf_dir).select("event_id", windows.standardised("value", USER).alias("scaled")))


def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = items(spark, sf_dir).select("l_suppkey", "l_quantity", windows.average_rank("l_quantity", SUPP).alias("rank"))
    return ranked.distinct()


def flexible_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residues(spark, sf_dir).select("event_id", windows.quantile_flag("value", USER, 0.8).alias("flexible"))


def quartile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = windows.quantile_flag("value", USER, 0.75).alias("top")
    return residues(spark, sf_dir).select("event_id", high, windows.quantile_flag("value", USER, 0.25, "low").alias("bottom"))


def row_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residues(spark, sf_dir).select("event_id", windows.position(USER, ORDER).cast("long").alias("position"), windows.group_size(USER).alias("n_residues"))


def position_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.position_features(residues(spark, sf_dir), USER, ORDER)
    return rounded(out.select("event_id", "norm_index", "terminal_distance", "terminal_decile", "length", "inverse_length"), 9)


def terminal_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.terminal_flag(residues(spark, sf_dir), USER, ORDER).select("event_id", "terminal")


EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


def classical_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir)
    cols = windows.one_hot("l_returnflag", ["A", "N", "R"], "sec")
    out = li.select("l_suppkey", *cols, F.col("l_extendedprice").alias("area"))
    return rounded(out.groupBy("l_suppkey").agg(*[F.sum(f"sec_{k}").alias(f"sec_{k}") for k in "ANR"], F.avg("area").alias("area")), 4)


# --- metrics ----------------------------------------------------------------------------------------------------------


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir)
    return li.withColumn("top", F.col("l_quantity") >= 40).withColumn("cheap", F.col("l_discount") >= 0.05)


def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pearson(items(spark, sf_dir), SUPP, "l_quantity", "l_extendedprice", TIE))


def pearson_guard_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pearson(items(spark, sf_dir), ["l_orderkey"], "l_quantity", "l_extendedprice", TIE, guard="deviation"))


def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.spearman(items(spark, sf_dir), SUPP, "l_quantity", "l_discount", TIE))


def rmse_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rmse(items(spark, sf_dir), SUPP, "l_tax", "l_discount"))


def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(_flagged(spark, sf_dir), SUPP, "top", "l_extendedprice"))


def smd_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mean_difference(_flagged(spark, sf_dir), SUPP, "cheap", "l_quantity"))


def odds_ratio_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.odds_ratio(_flagged(spark, sf_dir), SUPP, "top", "cheap"))


def jaccard_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.jaccard(_flagged(spark, sf_dir), SUPP, "top", "cheap"))


# --- summaries --------------------------------------------------------------------------------------------------------


def sec_structure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = residues(spark, sf_dir).withColumn("z", windows.zscore("value", USER)).withColumn("top", windows.quantile_flag("value", USER, 0.8).cast("int"))
    return rounded(summary.class_table(df, "event_type", {"mean_z": "z", "top_share": "top", "mean_value": "value"}).orderBy("event_type"))


def dataset_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.with_total(residues(spark, sf_dir), "event_type", ["value"]))


def _per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir)
    return metrics.pearson(li, SUPP, "l_quantity", "l_extendedprice", TIE).join(metrics.rmse(li, SUPP, "l_tax", "l_discount"), SUPP)


def median_of_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.spread(_per_group(spark, sf_dir), ["pearson", "rmse"]))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


def distinct_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.distinct_groups(residues(spark, sf_dir), "user_id")


def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.first_seen(residues(spark, sf_dir), "user_id", "event_id")


# --- sets, membership, alignment --------------------------------------------------------------------------------------


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda t, k: table(spark, sf_dir, t).select(F.col(k).cast("long").alias("id"), F.lit(t).alias("source"))
    return side("customer", "c_custkey").unionByName(side("supplier", "s_suppkey"))


def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(large.select(F.col("o_custkey").alias("id")))


def membership_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    part = lambda seg, name, k: c.where(F.col("c_mktsegment") == seg).select(F.col("c_custkey").cast("string").alias("id"), F.lit(name).alias("name"), F.lit(k).alias("priority"))
    lists = part("BUILDING", "small", 0).unionByName(part("MACHINERY", "large", 2)).unionByName(c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit("medium").alias("name"), F.lit(1).alias("priority")))
    return alignment.membership(c, lists, "c_custkey").select("c_custkey", "membership")


def semi_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return alignment.having_all(table(spark, sf_dir, "customer"), ["c_custkey"], o, big).select("c_custkey", "c_name")


def anti_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return alignment.not_yet(table(spark, sf_dir, "customer"), ["c_custkey"], done).select("c_custkey", "c_name")


def exclusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.excluding(table(spark, sf_dir, "nation"), "n_name", ["France", "germany", "JAPAN", "nation_3", "nation_7"]).select("n_nationkey", "n_name")


def limit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.first_ids(residues(spark, sf_dir), "user_id", 10).select("event_id", "user_id")


def _numbered(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    df = residues(spark, sf_dir).where(where)
    return df.select("user_id", windows.position(USER, ORDER).cast("long").alias("pos"), "event_id", "value")


def prefix_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _numbered(spark, sf_dir, "event_type <> 'view'")
    return alignment.aligned(short, _numbered(spark, sf_dir, "true"), "user_id", "pos", "prefix").select("user_id", "pos", "event_id")


def positional_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _numbered(spark, sf_dir, "user_id % 2 = 0 OR event_type <> 'view'").select("user_id", "pos", F.col("value").alias("a"))
    right = _numbered(spark, sf_dir, "true").select("user_id", "pos", F.col("value").alias("b"))
    return alignment.positional(left, right, "user_id", "pos").select("user_id", "pos", "a", "b")


def greedy_subsequence_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _numbered(spark, sf_dir, "true")
    short = _numbered(spark, sf_dir, "event_id % 3 = 0 OR (user_id % 4 = 0 AND event_id % 5 = 0)")
    short = short.withColumn("value", F.when((F.col("user_id") % 6 == 0) & (F.col("pos") == 3), -1e9).otherwise(F.col("value")))
    found = alignment.subsequence_by_group(short, long, "user_id", "pos", "value", 1e-9)
    return found.select("user_id", F.size("positions").cast("long").alias("n_found"), F.get("positions", F.size("positions") - 1).cast("long").alias("last_position"))


def list_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(", ,", F.col("n_nationkey").cast("string"), F.lit(" 2.5"), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.aggregate(parse_numbers(text), F.lit(0.0), lambda a, x: a + x).alias("total"))


def cleaned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "_CA_A2").otherwise(""), F.lit(".pdb "))
    return table(spark, sf_dir, "customer").select("c_custkey", alignment.clean_id(raw, drop_variant=True).alias("id"))


QUERIES = {
    f.__name__: f
    for f in (
        zscore_zero, zscore_null, zscore_drop, minmax_labels, global_standardize, group_standardize, avg_rank, flexible_top20, quartile_flags,
        row_position, position_features, terminal_decile, classical_onehot, pearson_by_group, pearson_guard_deviation, spearman_by_group,
        rmse_by_group, auc_by_group, smd_by_group, odds_ratio_by_group, jaccard_by_group, sec_structure_table, dataset_summary_rollup,
        median_of_group_metrics, status_counts, distinct_groups, first_seen_order, union_sources, intersect_ids, except_ids, membership_lookup,
        semi_sources, anti_cached, exclusion_filter, limit_ids, prefix_align, positional_align, greedy_subsequence_align, list_parsing, cleaned_ids,
    )
}

# --- DuckDB -----------------------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY user_id)"
_FLAT = "WITH r AS (SELECT event_id, user_id, CASE WHEN user_id % 7 = 0 THEN CAST(5 AS DOUBLE) ELSE value END AS value FROM events)"
_POS = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
_PEARSON = "CASE WHEN count(*) >= 3 AND stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN greatest(least(covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)), 1), -1) END"
_FLAGGED = "WITH f AS (SELECT *, l_quantity >= 40 AS top, l_discount >= CAST(0.05 AS DOUBLE) AS cheap FROM lineitem)"
_RANK = "rank() OVER (PARTITION BY l_suppkey ORDER BY {c}) + CAST(count(*) OVER (PARTITION BY l_suppkey, {c}) - 1 AS DOUBLE) / 2"
_HALF = "CAST(0.5 AS DOUBLE)"

ORACLE = {
    "zscore_zero": f"SELECT event_id, round(CASE WHEN stddev_pop(value) {_W} > 0 THEN (value - avg(value) {_W}) / stddev_pop(value) {_W} ELSE 0 END, 6) AS z FROM events",
    "zscore_null": f"{_FLAT} SELECT event_id, round(CASE WHEN stddev_pop(value) {_W} > 0 THEN (value - avg(value) {_W}) / stddev_pop(value) {_W} END, 6) AS z FROM r",
    "zscore_drop": f"{_FLAT} SELECT event_id, user_id, value FROM r QUALIFY stddev_pop(value) {_W} > 0 AND count(*) {_W} >= 3",
    "minmax_labels": f"{_FLAT} SELECT event_id, round(CASE WHEN max(value) {_W} > min(value) {_W} THEN (value - min(value) {_W}) / (max(value) {_W} - min(value) {_W}) ELSE 0 END, 6) AS label FROM r",
    "global_standardize": "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE user_id % 5 <> 0) SELECT event_id, round((value - m) / s, 6) AS value FROM events, s",
    "group_standardize": f"{_FLAT} SELECT event_id, round((value - avg(value) {_W}) / coalesce(nullif(stddev_pop(value) {_W}, 0), 1), 6) AS scaled FROM r",
    "avg_rank": f"SELECT DISTINCT l_suppkey, l_quantity, {_RANK.format(c='l_quantity')} AS rank FROM lineitem",
    "flexible_top20": f"SELECT event_id, value >= quantile_cont(value, 0.8) {_W} AS flexible FROM events",
    "quartile_flags": f"SELECT event_id, value >= quantile_cont(value, 0.75) {_W} AS top, value <= quantile_cont(value, 0.25) {_W} AS bottom FROM events",
    "row_position": f"SELECT event_id, {_POS} AS position, count(*) {_W} AS n_residues FROM events",
    "position_features": f"""WITH p AS (SELECT event_id, CAST({_POS} AS DOUBLE) AS i, CAST(count(*) {_W} AS DOUBLE) AS n FROM events), q AS (SELECT *, greatest(n - 1, 1) AS s FROM p)
SELECT event_id, round(i / s, 9) AS norm_index, round(least(i, s - i) / s, 9) AS terminal_distance, CAST(CASE WHEN least(i, s - i) / s <= CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS DOUBLE) AS terminal_decile, n AS length, round(1 / n, 9) AS inverse_length FROM q""",
    "terminal_decile": f"WITH p AS (SELECT event_id, CAST({_POS} AS DOUBLE) / greatest(count(*) {_W} - 1, 1) AS f FROM events) SELECT event_id, f <= CAST(0.1 AS DOUBLE) OR f >= CAST(0.9 AS DOUBLE) AS terminal FROM p",
    "classical_onehot": "SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS sec_A, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS sec_N, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS sec_R, round(avg(l_extendedprice), 4) AS area FROM lineitem GROUP BY l_suppkey",
    "pearson_by_group": f"SELECT l_suppkey, round({_PEARSON}, 6) AS pearson FROM lineitem GROUP BY l_suppkey",
    "pearson_guard_deviation": "SELECT l_orderkey, round(CASE WHEN count(*) >= 2 AND stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)) END, 6) AS pearson FROM lineitem GROUP BY l_orderkey",
    "spearman_by_group": f"WITH r AS (SELECT l_suppkey, {_RANK.format(c='l_quantity')} AS x, {_RANK.format(c='l_discount')} AS y FROM lineitem) SELECT l_suppkey, round(CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END, 6) AS spearman FROM r GROUP BY l_suppkey",
    "rmse_by_group": "SELECT l_suppkey, round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 6) AS rmse FROM lineitem GROUP BY l_suppkey",
    "auc_by_group": f"""{_FLAGGED}, r AS (SELECT l_suppkey, top, {_RANK.format(c='l_extendedprice')} AS r FROM f), s AS (SELECT l_suppkey, CAST(count(*) FILTER (WHERE top) AS DOUBLE) AS p, count(*) FILTER (WHERE NOT top) AS n, sum(r) FILTER (WHERE top) AS t FROM r GROUP BY l_suppkey)
SELECT l_suppkey, round((t - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auc FROM s""",
    "smd_by_group": f"{_FLAGGED} SELECT l_suppkey, round(CASE WHEN count(*) FILTER (WHERE cheap) >= 2 AND count(*) FILTER (WHERE NOT cheap) >= 2 THEN (avg(l_quantity) FILTER (WHERE cheap) - avg(l_quantity) FILTER (WHERE NOT cheap)) / nullif(sqrt((var_samp(l_quantity) FILTER (WHERE cheap) + var_samp(l_quantity) FILTER (WHERE NOT cheap)) / 2), 0) END, 6) AS smd FROM f GROUP BY l_suppkey",
    "odds_ratio_by_group": f"{_FLAGGED} SELECT l_suppkey, round((count(*) FILTER (WHERE top AND cheap) + {_HALF}) * (count(*) FILTER (WHERE NOT top AND NOT cheap) + {_HALF}) / ((count(*) FILTER (WHERE cheap AND NOT top) + {_HALF}) * (count(*) FILTER (WHERE top AND NOT cheap) + {_HALF})), 6) AS odds_ratio FROM f GROUP BY l_suppkey",
    "jaccard_by_group": f"{_FLAGGED} SELECT l_suppkey, round(CAST(count(*) FILTER (WHERE top AND cheap) AS DOUBLE) / nullif(count(*) FILTER (WHERE top OR cheap), 0), 6) AS jaccard FROM f GROUP BY l_suppkey",
    "sec_structure_table": f"""WITH r AS (SELECT event_type, value, CASE WHEN stddev_pop(value) {_W} > 0 THEN (value - avg(value) {_W}) / stddev_pop(value) {_W} ELSE 0 END AS z, value >= quantile_cont(value, 0.8) {_W} AS top FROM events)
SELECT event_type, count(*) AS n, round(avg(z), 6) AS mean_z, round(avg(CAST(top AS INTEGER)), 6) AS top_share, round(avg(value), 6) AS mean_value FROM r GROUP BY event_type""",
    "dataset_summary_rollup": "SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY GROUPING SETS ((event_type), ())",
    "median_of_group_metrics": f"WITH g AS (SELECT l_suppkey, {_PEARSON} AS p, sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))) AS r FROM lineitem GROUP BY l_suppkey) SELECT round(avg(p), 6) AS mean_pearson, round(median(p), 6) AS median_pearson, round(avg(r), 6) AS mean_rmse, round(median(r), 6) AS median_rmse FROM g",
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "distinct_groups": "SELECT count(DISTINCT user_id) AS n_groups FROM events",
    "first_seen_order": "SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY user_id",
    "union_sources": "SELECT c_custkey AS id, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier",
    "intersect_ids": "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders",
    "except_ids": "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "membership_lookup": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'small' WHEN c_custkey % 3 = 0 THEN 'medium' WHEN c_mktsegment = 'MACHINERY' THEN 'large' ELSE '365_only' END AS membership FROM customer",
    "semi_sources": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "anti_cached": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "exclusion_filter": "SELECT n_nationkey, n_name FROM nation WHERE upper(n_name) NOT IN ('FRANCE', 'GERMANY', 'JAPAN', 'NATION_3', 'NATION_7')",
    "limit_ids": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 10)",
    "prefix_align": f"""WITH l AS (SELECT user_id, {_POS} AS pos, event_id FROM events), s AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT user_id, pos, event_id FROM l JOIN s USING (user_id) WHERE pos < n""",
    "positional_align": f"""WITH a AS (SELECT user_id, {_POS} AS pos, value FROM events WHERE user_id % 2 = 0 OR event_type <> 'view'), b AS (SELECT user_id, {_POS} AS pos, value FROM events),
same AS (SELECT user_id FROM (SELECT user_id, count(*) AS n FROM a GROUP BY user_id) x JOIN (SELECT user_id, count(*) AS m FROM b GROUP BY user_id) y USING (user_id) WHERE n = m)
SELECT a.user_id, a.pos, a.value AS a, b.value AS b FROM a JOIN b USING (user_id, pos) WHERE user_id IN (SELECT user_id FROM same)""",
    "greedy_subsequence_align": f"""WITH RECURSIVE l AS (SELECT user_id, {_POS} AS pos, event_id, value FROM events),
s0 AS (SELECT user_id, {_POS} AS k, value FROM events WHERE event_id % 3 = 0 OR (user_id % 4 = 0 AND event_id % 5 = 0)),
s AS (SELECT user_id, k, CASE WHEN user_id % 6 = 0 AND k = 3 THEN CAST(-1e9 AS DOUBLE) ELSE value END AS value FROM s0),
walk AS (SELECT user_id, CAST(-1 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS spot FROM (SELECT DISTINCT user_id FROM s)
  UNION ALL SELECT w.user_id, w.k + 1, (SELECT min(l.pos) FROM l JOIN s ON s.user_id = l.user_id AND s.k = w.k + 1 WHERE l.user_id = w.user_id AND l.pos > w.spot AND abs(l.value - s.value) <= CAST(1e-9 AS DOUBLE))
  FROM walk w WHERE w.spot IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.user_id = w.user_id AND s.k = w.k + 1)),
ends AS (SELECT user_id, bool_and(spot IS NOT NULL) AS ok, max(k) + 1 AS n, max(spot) AS last FROM walk GROUP BY user_id)
SELECT user_id, CASE WHEN ok THEN n END AS n_found, CASE WHEN ok THEN last END AS last_position FROM ends""",
    "list_parsing": "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) + CAST(2.5 AS DOUBLE) + n_regionkey AS total FROM nation",
    "cleaned_ids": "SELECT c_custkey, c_name AS id FROM customer",
}
