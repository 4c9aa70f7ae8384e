"""Chat formatting: cumulative snapshots collapse to the longest conversation, which is then rendered.

Logs often keep a conversation again after each turn. Every prefix of a conversation
gets a rolling hash (sums of hashes of position, role and text, kept up by running
windows); a conversation whose whole hash is a longer one's prefix hash is dropped by an
anti-join. Long conversations are summed and rendered in blocks of turns, so that none
has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.llm.storage import save

#: Turns that are hashed and rendered together.
BLOCK = 64
_SUMS = ("s0", "s1", "s2", "s3", "rows")


def _turn_sums(position: Column, role: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes of a turn as four non-negative halves: their sums don't overflow, whatever the order and repeats."""
    one, two = F.xxhash64(position, role, text), F.xxhash64(F.lit(1), position, role, text)
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    return [low(one), F.shiftrightunsigned(one, 32), low(two), F.shiftrightunsigned(two, 32)]


def _states(turns: DataFrame) -> DataFrame:
    """Each position of each conversation with the sums over all turns up to it."""
    points = turns.groupBy("conv_id", "turn").agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(_turn_sums(F.col("turn"), F.col("role"), F.col("text")))], F.count(F.lit(1)).alias("rows"))
    points = points.withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = points.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in _SUMS])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in _SUMS])
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = points.select("conv_id", "block", "turn", *[F.sum(c).over(inside).alias(c) for c in _SUMS])
    return running.join(bases.hint("merge"), ["conv_id", "block"]).select("conv_id", "turn", *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in _SUMS])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id) of the conversations that no longer one starts with; of equal ones the smallest conv_id.

    A conversation is the set of (turn, role, text) rows of a conv_id; its prefixes end at
    each turn number. turns: distinct rows with a conv_id and a turn; a null role or text
    is a value of its own.
    """
    states = save(_states(turns), "states")
    last = states.groupBy("conv_id").agg(F.max("turn").alias("end"))
    ends = states.join(last.withColumnRenamed("conv_id", "c").withColumnRenamed("end", "turn_end").hint("merge"), F.col("conv_id") == F.col("c"))
    whole = ends.where(F.col("turn") == F.col("turn_end")).groupBy(*_SUMS).agg(F.min("conv_id").alias("conv_id"))
    open_states = ends.where(F.col("turn") < F.col("turn_end")).select(*_SUMS).distinct()
    return save(whole.join(open_states.hint("merge"), list(_SUMS), "left_anti").select("conv_id"), "maximal")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, block, first_turn, n_turns, text) of the maximal conversations.

    Rows without conv_id or turn are left out. Each turn is rendered as <|role|>, a line end, its text and <|end|>; a null role is
    written as unknown, a null text as empty. Turns are in order of their number, those of
    one number in order of their rendering, and a block holds turn numbers block * BLOCK
    and on, so concatenating a conversation's blocks gives its whole rendering. Repeated
    rows count once. An empty table gives no rows; other columns are not looked at.
    """
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = save(turns.where("conv_id is not null and turn is not null").distinct(), "turns")
    kept = turns.join(maximal_conversations(turns).hint("merge"), "conv_id", "left_semi")
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = kept.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", said.alias("said"))
    grouped = rows.groupBy("conv_id", "block").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "said"))).alias("all"))
    return grouped.select("conv_id", "block", "first_turn", "n_turns", F.array_join(F.transform("all", lambda x: x["said"]), "").alias("text"))
