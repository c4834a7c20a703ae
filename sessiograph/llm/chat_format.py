"""Chat formatting with cumulative-snapshot collapse, in DataFrame expressions only.

Logs often hold every state of a conversation: each snapshot is a prefix of the next. Every turn gets the hash of the turns up
to it; a conversation whose whole hash is some longer conversation's prefix hash goes by an anti-join, and of equal
conversations the least id stays. Only what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that one group covers; longer conversations are hashed and rendered in parts of this many turn numbers, then joined.
PART = 1024
#: Part of turns without a number, before all others.
NO_TURN = -(1 << 62)
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = rows.where(rows[conv].isNotNull()).select(
        rows[conv].cast("long").alias("conv_id"), rows[turn].cast("long").alias("turn"),
        F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    return said.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART).cast("long"), F.lit(NO_TURN))).withColumn("h", F.xxhash64("role", "text")).withColumn(
        "g", F.xxhash64(F.lit(7), "text", F.lit(11), "role"))


def _before(what: Column, of: str = "conv_id", by: str = "part") -> Column:
    return what.over(Window.partitionBy(of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, j (turns up to here), n (of the conversation), a, b: the 128-bit hash of turns 1 to j.

    Running values are taken inside parts and carried from part to part, so no conversation is one group.
    """
    each = turns.distinct()
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    sizes = each.groupBy("conv_id", "part").agg(F.count("*").alias("c"))
    sizes = sizes.select("conv_id", "part", F.coalesce(_before(F.sum("c")), F.lit(0)).alias("skip"), F.sum("c").over(Window.partitionBy("conv_id")).alias("n"))
    placed = each.withColumn("k", F.row_number().over(inside)).join(sizes, ["conv_id", "part"]).withColumn("j", F.col("k") + F.col("skip"))
    signed = placed.select("conv_id", "part", "j", "n", F.xxhash64("j", "h", "g").alias("x"), F.xxhash64(F.lit(3), "g", "j", "h").alias("y"))
    totals = signed.groupBy("conv_id", "part").agg(F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"))
    carried = totals.select("conv_id", "part", *(F.coalesce(_before(F.expr(f"bit_xor({c})")), F.lit(0)).alias(f"c{c}") for c in "xy"))
    running = signed.select("conv_id", "part", "j", "n", *(F.expr(f"bit_xor({c})").over(Window.partitionBy("conv_id", "part").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in "xy"))
    return running.join(carried, ["conv_id", "part"]).select("conv_id", "j", "n", F.col("x").bitwiseXOR(F.col("cx")).alias("a"), F.col("y").bitwiseXOR(F.col("cy")).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and copies of the conversations that stay."""
    hashes = prefix_hashes(turns)
    whole = hashes.where(F.col("j") == F.col("n")).groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = hashes.where(F.col("j") < F.col("n")).select(F.col("j").alias("n"), "a", "b").distinct()
    return whole.join(shorter, ["n", "a", "b"], "left_anti").select("conv_id", "copies")


def chat_format(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation that stays: conv_id, n_turns, copies, rendered.

    Turns are ordered by number (null first), equal numbers by role and text; exactly repeated rows count once; a null role
    or text counts as empty; rows without a conversation are left out. Long conversations are rendered in parts of PART
    turn numbers, which are joined last; a rendered conversation is one value, which Spark limits to 2 GB. An empty table
    gives an empty result; other columns are ignored.
    """
    turns = _turns(rows, conv, turn, role, text)
    stays = maximal(turns).withColumnRenamed("conv_id", "of")
    said = turns.join(stays, F.col("conv_id") == F.col("of"))
    parts = said.groupBy("conv_id", "part", "copies").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE)))
    rendered = parts.select("conv_id", "part", "copies", F.size("turns").cast("long").alias("n"), F.array_join(shown, "").alias("shown"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("part", "shown"))), lambda p: p["shown"])
    return rendered.groupBy("conv_id", "copies").agg(F.sum("n").alias("n_turns"), F.array_join(whole, "").alias("rendered")).select("conv_id", "n_turns", "copies", "rendered")
