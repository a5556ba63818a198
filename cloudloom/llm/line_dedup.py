"""Line deduplication: explode normalised lines, hash, count documents by hash, drop, reassemble by position.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. A key of at least
``min_chars`` code points that at least ``min_docs`` documents hold loses all its lines but those of the smallest
doc_id that holds it. Other lines stay in their order.

Edge cases. Null or empty text: one empty line, which is too short to be dropped. Rows that share a doc_id count as
one document. Null doc_ids count as one document that comes after all others. An empty table gives an empty table.
Columns beyond doc_id and text pass through untouched, whatever their names, but for n_lines and
n_dropped, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, written

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hash(key: Column) -> Column:
    """128 bits, so that distinct keys of any corpus stay apart."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7919), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text: equal rows lose the same lines."""
    own = [doc_id, doc_id.isNull(), text]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(7919), *own).alias("b"))


def exploded_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h) of each line whose key is long enough; no text leaves the scan stage."""
    lines = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("k"))
    return keys.where(F.length("k") >= min_chars).select("doc_id", "row", "pos", _hash(F.col("k")).alias("h"))


def shared_keys(keys: DataFrame, min_docs: int) -> DataFrame:
    """(h, keep) of keys in at least min_docs distinct documents; keep is the doc_id whose lines stay."""
    nil = F.max(F.col("doc_id").isNull().cast("int"))
    if min_docs <= 2:  # a distinct count of two or more: the smallest and the largest id differ; partial sums are enough
        found = keys.groupBy("h").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), nil.alias("nil"))
        several = (F.col("keep") != F.col("last")) | (F.col("nil").eqNullSafe(1) & F.col("keep").isNotNull())
        return found.where(several if min_docs == 2 else F.lit(True)).select("h", "keep")
    found = keys.select("doc_id", "h").distinct().groupBy("h").agg(F.min("doc_id").alias("keep"), F.count("doc_id").alias("n"), nil.alias("nil"))
    return found.where(F.col("n") + F.col("nil") >= min_docs).select("h", "keep")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with ``text`` made of the lines that stay, and two more columns: n_lines (before) and n_dropped.

    Lines travel as (row, position, 16-byte hash) and are written once; the text moves once, to meet the positions that its
    row loses, and its other lines are reassembled by position. A line in very many documents has one partial row in each
    map task before the shuffle, and Spark may split its rows in the join.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keys = written(exploded_keys(docs, min_chars), "lines")
    held = written(shared_keys(keys, min_docs), "held")
    gone = keys.join(held, "h").where(~F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy("row").agg(F.collect_set("pos").alias("gone"))
    own = F.struct(*(F.col(c) for c in kept)).alias("own")  # so that no name clashes
    met = docs.select(own, row_key(F.col("doc_id"), F.col("text")).alias("row"), lines_of(F.col("text")).alias("lines")).join(gone, "row", "left")
    places = F.expr("CASE WHEN gone IS NOT NULL THEN array_except(sequence(0, size(lines) - 1), gone) END")
    met = met.select("own", "lines", places.alias("stay"))
    text = F.when(F.col("stay").isNull(), F.coalesce("own.text", F.lit(""))).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    met = met.select("own", text.alias("made"), F.size("lines").cast("long").alias("before"), F.coalesce(F.size("lines") - F.size("stay"), F.lit(0)).cast("long").alias("lost"))
    same = [F.col("made").alias("text") if c == "text" else F.col("own")[c].alias(c) for c in kept]
    return met.select(*same, F.col("before").alias("n_lines"), F.col("lost").alias("n_dropped"))
