"""Chat formatting: logged conversations that are prefixes of longer ones collapse into these, which are then rendered.

A turn's hash is that of its position, role and text, 2 x 64 bits; a prefix's rolling hash is the exclusive or of its
turns' hashes, so prefixes of any length come from running sums over blocks of BLOCK turns. A conversation whose full
hash is the prefix hash of a longer one leaves by an anti-join; of equal ones the smallest conv_id stays.

Turns are ordered by (turn, role, text), nulls first; repeated rows count once. Null role or text is a value of its own
and is rendered as empty. Rows with null conv_id are one conversation. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that one window group takes; a longer conversation is spread over several.
BLOCK = 256
#: The block of null turns, before all others.
NULLS = -(1 << 62)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, p, q): p and q are the rolling hash of the conversation up to the turn."""
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("blk", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(NULLS)))
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text")]
    inside = Window.partitionBy("conv_id", "blk").orderBy(*order)
    blocks = rows.groupBy("conv_id", "blk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("blk")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("blk").alias("b"), (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    rows = rows.withColumn("own", F.row_number().over(inside))
    rows = rows.join(blocks, rows["conv_id"].eqNullSafe(F.col("c")) & (F.col("blk") == F.col("b"))).withColumn("pos", F.col("before") + F.col("own")).drop("c", "b", "before", "own")
    said = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    rows = rows.withColumn("h1", F.xxhash64("pos", *said)).withColumn("h2", F.xxhash64(F.lit(104729), "pos", *said))
    upto = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x1", F.bit_xor("h1").over(upto)).withColumn("x2", F.bit_xor("h2").over(upto))
    sums = rows.groupBy("conv_id", "blk").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    through = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.bit_xor(c).over(through), F.lit(0).cast("long"))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("blk").alias("b"), zero("s1").alias("s1"), zero("s2").alias("s2"))
    rows = rows.join(sums, rows["conv_id"].eqNullSafe(F.col("c")) & (F.col("blk") == F.col("b")))
    return rows.select("conv_id", "turn", "role", "text", "pos", F.col("x1").bitwiseXOR(F.col("s1")).alias("p"), F.col("x2").bitwiseXOR(F.col("s2")).alias("q"))


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that stay; n_copies counts equal ones, itself included."""
    whole = rows.groupBy("conv_id").agg(F.max(F.struct("pos", "p", "q")).alias("w")).select("conv_id", "w.*")
    one = whole.groupBy("pos", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    lengths = whole.select(F.col("conv_id").alias("c"), F.col("pos").alias("n"))
    inner = rows.join(lengths, rows["conv_id"].eqNullSafe(F.col("c"))).where(F.col("pos") < F.col("n")).select("pos", "p", "q").distinct()
    return one.join(inner, ["pos", "p", "q"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, open_turn: str = "<|im_start|>", close_turn: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of the conversations that stay."""
    rows = turns(conversations)
    stay = maximal(rows).withColumnRenamed("conv_id", "c")
    line = F.concat(F.lit(open_turn), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(close_turn + "\n"))
    kept = rows.join(stay, rows["conv_id"].eqNullSafe(F.col("c")))
    said = kept.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return said.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat"))
