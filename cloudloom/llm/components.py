"""Connected components of a link table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def near_labels(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node within two links. Equal labels are connected; unequal ones may be."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    through = both.join(least.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("label"))
    return through.select("node", F.least("node", "label").alias("label"))


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for nodes of links (a, b); label is the smallest node of the component.

    Links within equal near_labels() are contracted first, which leaves nothing of groups around one node. The rest is
    joined by alternating stars.
    """
    labels = written(near_labels(links), "labels") if labels is None else labels
    end = lambda k, name: labels.select(F.col("node").alias(k), F.col("label").alias(name))
    rest = links.join(end("a", "x"), "a").join(end("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = _stars(rest)
    if roots is None:
        return labels
    roots = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    return labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def _stars(links: DataFrame) -> DataFrame | None:
    """(node, label) for nodes of links, or None without links.

    Each round is a few aggregates by node with partial sums, so a node with very many links has one row from each map
    task; every round's links are written to the shared folder. The rounds grow with the logarithm of the nodes.
    """
    e = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "links")
    before = _state(e)
    if not before[0]:
        return None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "links")
        if (now := _state(e)) == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
