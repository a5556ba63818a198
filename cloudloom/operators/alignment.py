"""Joins of residue sources: membership, semi and anti filters, positional and ordered alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The membership of an id that no list has; the file suffixes that ids may carry.
DEFAULT_MEMBERSHIP = "365_only"
ID_SUFFIX = "_CA_A2"


def clean_id(c: Column, drop_variant: bool = False) -> Column:
    """An id without blanks and without .pdb, and without the variant suffix if asked."""
    out = F.regexp_replace(F.trim(c), r"\.pdb$", "")
    return F.regexp_replace(out, ID_SUFFIX + "$", "") if drop_variant else out


def membership(df: DataFrame, lists: DataFrame, key: str, conflict: str = "first", default: str = DEFAULT_MEMBERSHIP) -> DataFrame:
    """df with the column membership, from lists (id, name, priority); an id in several lists takes the first or last."""
    pick = F.min_by if conflict == "first" else F.max_by
    one = lists.groupBy(F.col("id").alias("__id")).agg(pick("name", "priority").alias("membership"))
    out = df.join(one, F.regexp_replace(F.col(key).cast("string"), ID_SUFFIX + "$", "") == F.col("__id"), "left").drop("__id")
    return out.withColumn("membership", F.coalesce("membership", F.lit(default)))


def having_all(df: DataFrame, keys: list[str], *sources: DataFrame) -> DataFrame:
    """Rows whose key is in every source."""
    for s in sources:
        df = df.join(s.select(*keys).distinct(), keys, "left_semi")
    return df


def not_yet(df: DataFrame, keys: list[str], done: DataFrame) -> DataFrame:
    """Rows whose key is not done."""
    return df.join(done.select(*keys), keys, "left_anti")


def excluding(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Rows whose upper-cased key is not listed."""
    return df.where(~F.upper(F.col(key)).isin([x.upper() for x in ids])) if ids else df


def first_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n smallest keys."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def positional(left: DataFrame, right: DataFrame, group: str, position: str) -> DataFrame:
    """Rows joined on (group, position), of groups with equally many rows on both sides."""
    a = left.groupBy(group).agg(F.count("*").alias("__a"))
    b = right.groupBy(group).agg(F.count("*").alias("__b"))
    same = a.join(b, group).where("__a = __b").select(group)
    return left.join(right, [group, position]).join(same, group, "left_semi")


def aligned(short: DataFrame, long: DataFrame, group: str, position: str, mode: str = "skip") -> DataFrame:
    """Rows of long that go with short's positions. skip: groups of equal size only; prefix: the first rows, where long
    has at least as many."""
    if mode not in ("skip", "prefix"):
        raise ValueError(f"unknown alignment {mode!r}; see subsequence() for the ordered one")
    a = short.groupBy(group).agg(F.count("*").alias("__a"))
    b = long.groupBy(group).agg(F.count("*").alias("__b"))
    sized = a.join(b, group).where("__a = __b" if mode == "skip" else "__a <= __b").select(group, "__a")
    return long.join(sized, group).where(F.col(position) < F.col("__a")).drop("__a")


def subsequence(short: Column, long: Column, tolerance: float) -> Column:
    """Positions in long, from 0, of a greedy ordered match: each value of short takes the first later value of long
    within tolerance. Null if one finds none. One fold over long, on the JVM."""
    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), empty.alias("o"))

    def step(s, x):
        wanted = F.get(short, F.least(s["n"], F.size(short) - 1))
        hit = (s["n"] < F.size(short)) & (F.abs(x - wanted) <= F.lit(tolerance))
        return F.struct(
            (s["p"] + 1).alias("p"),
            F.when(hit, s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when(hit, F.concat(s["o"], F.array(s["p"]))).otherwise(s["o"]).alias("o"),
        )

    return F.aggregate(long, start, step, lambda s: F.when(s["n"] == F.size(short), s["o"]))


def subsequence_by_group(short: DataFrame, long: DataFrame, group: str, order: str, value: str, tolerance: float) -> DataFrame:
    """(group, positions): subsequence() of each group's values in order; a group is one ordered sequence, so one row."""
    listed = lambda df, name: df.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
    both = listed(short, "__s").join(listed(long, "__l"), group)
    return both.select(group, subsequence(F.col("__s"), F.col("__l"), tolerance).alias("positions"))
