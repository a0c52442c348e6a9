"""Chat formatting after a collapse of cumulative snapshots.

A chat log often holds a conversation again each time it has grown. Every conversation's turns get rolling prefix hashes: the
hash of a prefix is that of the one before combined with the next turn's, so all of them are one running aggregate. The hash at
its last turn names the conversation, the ones before name its prefixes. An anti-join drops conversations that are a proper
prefix of another one, equal ones stay once (smallest id), and what stays is rendered. Hashes are worked with before texts are
moved; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

TURN = "<|{role}|>\n{text}\n<|end|>\n"
# The order of roles in turns of one number; others follow by name.
ROLES = ("system", "user", "assistant", "tool")
SEED = 23


def _turn_hash(role: Column, text: Column) -> Column:
    # a null is told apart from an empty string, and the length from the text, so that no two turns are written alike
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.length(c).cast("string"), F.lit(":"), c), F.lit("n"))
    return F.md5(F.concat(part(role), F.lit("|"), part(text)))


def _keyed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """turns as (key, conv, turn, rank, role, h, text); a turn without a conversation is a conversation of its own."""
    role, text = F.col(role_col).cast("string"), F.col(text_col).cast("string")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), role), F.lit(0)).cast("int")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(rank > 0, rank).otherwise(len(ROLES) + 1).alias("rank"), role.alias("role"), _turn_hash(role, text).alias("h"), text.alias("text"))
    return rows.withColumn("key", F.when(F.col("conv").isNotNull(), F.concat(F.lit("c"), F.col("conv").cast("string"))).otherwise(F.concat(F.lit("t"), F.col("h"))))


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, conv, n, p, q, last): per turn its number n in its conversation, the two hashes (p, q) of the prefix that it ends, and whether it is the last."""
    each = _keyed(turns, conv_col, turn_col, role_col, text_col).drop("text").distinct()
    order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "rank", F.col("role").asc_nulls_first(), "h")
    each = each.withColumn("n", F.row_number().over(order)).withColumn("last", F.lead("h").over(order).isNull())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return each.select("key", "conv", "n", F.bit_xor(F.xxhash64("n", "h")).over(upto).alias("p"), F.bit_xor(F.xxhash64(F.lit(SEED), "h", "n")).over(upto).alias("q"), "last")


def maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, conv, n_turns, n_snapshots): the conversations that are no proper prefix of another, of equal ones the smallest id.

    n_snapshots: how many logged conversations are equal to it.
    """
    hashed = cut(prefix_hashes(turns, conv_col, turn_col, role_col, text_col))
    first = F.struct(F.col("conv").isNull().alias("none"), "conv", "key")
    whole = hashed.where("last").groupBy("p", "q", "n").agg(F.min(first).alias("first"), F.count("*").alias("n_snapshots"))
    prefixes = hashed.where("not last").select("p", "q", "n").distinct()
    return whole.join(prefixes, ["p", "q", "n"], "left_anti").select("first.key", "first.conv", F.col("n").cast("long").alias("n_turns"), "n_snapshots")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TURN) -> DataFrame:
    """(conv_id, n_turns, n_snapshots, rendered), one row per maximal conversation.

    Turns are in the order of turn (null first), of role (system, user, assistant, tool, then others by name, null first) and of
    the hash of role and text; repeated rows of a turn count once. A null role or text is rendered as an empty string but hashed
    apart from one. A row without a conversation id is a conversation of its own, of one turn; equal ones are one, and of
    equal conversations one with an id is kept. Empty table: no rows. Other columns are ignored.
    """
    kept = cut(maximal(turns, conv_col, turn_col, role_col, text_col))
    before, middle, after = template.partition("{role}")[0], template.partition("{role}")[2].partition("{text}")[0], template.partition("{text}")[2]
    piece = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(after))
    rows = _keyed(turns, conv_col, turn_col, role_col, text_col).select("key", F.struct("turn", "rank", "role", "h", piece.alias("piece")).alias("t"))
    # repeats go within each task before the shuffle, so that a turn that many rows have is one row a task
    listed = rows.groupBy("key").agg(F.array_sort(F.collect_set("t")).alias("list")).join(kept, "key")
    return listed.select(F.col("conv").alias("conv_id"), "n_turns", "n_snapshots", F.array_join(F.transform("list", lambda t: t.piece), "").alias("rendered"))
