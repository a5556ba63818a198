"""Benchmark decontamination: containment MinHash by item size, verified by exact shingle containment.

An item of n distinct five-word shingles is contained in a document when at least ``threshold`` of them occur there; an
item of fewer words is one shingle of all its words. Items are partitioned by size, over l and up to u shingles:

* a document of fewer than ``threshold`` * l windows is not compared with the partition;
* the partition keeps k = floor((1 - threshold) * u) + 1 hashes of each item: a document that holds ``threshold`` of an
  item lacks at most k - 1 of its shingles, so it holds one of the k. Which k does not matter for that; they are the ones
  that the fewest items have, and of those the least, so that a phrase of many items finds no candidates.

A document's side is not sketched: every shingle of a whole text is looked up in the sketches, so a short item in a very
long document is found as surely as in a short one. Candidates are then verified on the words themselves.

Words are lower-cased runs of ASCII digits, letters and all non-ASCII characters.

Edge cases. Null texts have no words. Items without words match nothing. Rows that
share doc_id and text count once, as do items that share item_id and text. Empty tables give an empty result. Null ids
are kept as ids of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NOT_WORD, written

#: Sketch rows (24 bytes each) up to which the sketches are broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 200_000
#: Upper bounds of the item size partitions, in shingles; larger items get a bound of their own size.
SIZE_CLASSES = (8, 16, 32, 64, 128, 256)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda x: x != "")


def _starts(size: int) -> str:
    return f"CASE WHEN size(w) >= {size} THEN sequence(0, size(w) - {size}) ELSE array() END"


def hashed(size: int) -> Column:
    return F.expr(f"transform({_starts(size)}, i -> xxhash64({', '.join(f'w[i + {k}]' for k in range(size))}))")


def spelled(size: int) -> Column:
    return F.expr(f"transform({_starts(size)}, i -> concat_ws(' ', slice(w, i + 1, {size})))")


def sketches(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(item, need, h): hashes of each item, as many as its size partition needs; need is the partition's least overlap."""
    rows = items.select("item", F.explode(F.array_distinct(hashed(size))).alias("h"))
    held = rows.groupBy("h").agg(F.count("*").alias("held"))
    rare = rows.join(held, "h").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("held", "h"))).alias("hs"))
    n = F.size("hs")
    over = F.coalesce(*[F.when(n <= u, F.lit(x + 1)) for x, u in zip((0, *SIZE_CLASSES), SIZE_CLASSES, strict=False)], n)
    upto = F.coalesce(*[F.when(n <= u, F.lit(u)) for u in SIZE_CLASSES], n)
    k = F.floor((F.lit(1.0) - F.lit(threshold)) * upto + F.lit(1e-9)).cast("int") + 1
    need = F.ceil(F.lit(threshold) * over - F.lit(1e-9)).cast("int")
    return rare.select("item", need.alias("need"), F.explode(F.slice("hs", F.lit(1), k)).alias("x")).select("item", "need", "x.h")


def _contained(rows: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    sketch = sketches(items, size, threshold)
    few = sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    worded = rows.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("doc"), words(F.col("text")).alias("w"))
    seen = worded.select("doc", (F.size("w") - (size - 1)).alias("m"), F.explode(hashed(size)).alias("h"))
    pairs = seen.join(F.broadcast(sketch) if few else sketch, "h").where("m >= need").select("doc", "item").distinct()
    pairs = written(pairs, "candidates")  # used twice below; every text is hashed for it
    # exact check on the words of candidate documents and items only
    of_item = items.select("item", F.explode(F.array_distinct(spelled(size))).alias("s"))
    wanted = pairs.join(of_item, "item").select("doc", "item", "s")
    texts = rows.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("doc"), "text")
    texts = texts.join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", words(F.col("text")).alias("w"))
    there = texts.select("doc", F.explode(F.array_distinct(spelled(size))).alias("s")).distinct()
    shared = wanted.join(there, ["doc", "s"]).groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    sizes = items.select("item", F.size(F.array_distinct(spelled(size))).cast("long").alias("n_item"))
    return shared.join(F.broadcast(sizes) if few else sizes, "item").select("doc", "item", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def contained(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each item and each document that contains it."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = items.select(F.struct("item_id", F.xxhash64("text").alias("th")).alias("item"), words(F.col("text")).alias("w"))
    length = F.least(F.size("w"), F.lit(size))
    lengths = [r[0] for r in items.select(length.alias("n")).where("n > 0").distinct().collect()]  # 1..size
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    out = None
    for n in sorted(lengths) or [size]:
        one = _contained(rows, items.where(length == n), n, threshold).where(F.col("containment") >= threshold - 1e-9)
        out = one if out is None else out.unionByName(one)
    best = F.max(F.struct("containment", "n_item", "n_shared")).alias("b")
    out = out.groupBy(F.col("doc.doc_id").alias("doc_id"), F.col("item.item_id").alias("item_id")).agg(best)
    return out.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item."""
    bad = contained(docs, items, size, threshold).select(F.struct("doc_id").alias("bad")).distinct()
    own = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("own"))  # so that no name clashes
    left = own.join(bad, F.col("own.doc_id").eqNullSafe(F.col("bad.doc_id")), "left_anti")
    return left.select(*(F.col("own")[c].alias(c) for c in docs.columns))
