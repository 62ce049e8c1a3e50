"""Preference pairs for chat models: one prompt, two masked completions.

The turns that the chosen and the rejected conversation have in common from the start are rendered once as the
prompt; what follows in either is its completion, with the spans of characters that carry loss: the
text and end mark of assistant turns. A conversation is rendered and measured once, whatever the number
of its pairs.

Defined results
    turns are taken in the order of (turn, role, text), nulls first; null role or text counts as empty; rows of null
    ``conv_id`` belong to no conversation; equal conversations have empty completions; a pair with a conversation that
    has no rows is not returned; an empty table gives no rows; further columns do not matter.
    A conversation is one value in the end, so its length, not the table's, bounds a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def _header(role):
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (pos, role, text, start); ``start`` counts the characters rendered before."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = F.length(F.concat(_header(F.col("role")), F.col("text"), F.lit(END)))
    placed = rows.select(
        "conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text",
        F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    return placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text", "start"))).alias("turns"))


def pairs_by_opening(threads: DataFrame) -> DataFrame:
    """chosen_id, rejected_id: conversations with the same first turn, against the one of smallest id; and every even
    conversation against the odd one after it. A common opening costs one row per conversation."""
    first = threads.select("conv_id", F.struct(F.col("turns")[0]["role"], F.col("turns")[0]["text"]).alias("opening"))
    leader = first.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"))
    opened = first.join(leader, "opening").where("conv_id <> chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))
    ids = threads.select(F.col("conv_id").alias("chosen_id")).where("chosen_id % 2 = 0")
    odd = threads.select((F.col("conv_id") - 1).alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    return opened.unionByName(ids.join(odd, "chosen_id")).distinct()


def _rendered(turns):
    parts = F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(END)))
    return F.array_join(parts, "")


def _spans(turns, base, learned: str):
    mine = F.filter(turns, lambda t: t["role"] == learned)
    begin = lambda t: t["start"] - base + F.length(_header(t["role"]))
    return F.transform(mine, lambda t: F.struct(begin(t).alias("start"), (begin(t) + F.length(t["text"]) + len(END)).alias("end")))


def format_pairs(threads: DataFrame, pairs: DataFrame, learned: str = "assistant") -> DataFrame:
    """chosen_id, rejected_id, prefix_turns, prompt, chosen, chosen_spans, rejected, rejected_spans."""
    left = threads.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    right = threads.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    rows = pairs.join(right, "rejected_id").join(left, "chosen_id")
    both = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", F.lit(1), both), F.slice("b", F.lit(1), both), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    at = F.array_position(same, False)
    rows = rows.withColumn("prefix", F.when(at > 0, at - 1).otherwise(both).cast("int"))
    after = lambda c: F.slice(c, F.col("prefix") + 1, F.greatest(F.size(c) - F.col("prefix"), F.lit(0)))
    rows = rows.select("chosen_id", "rejected_id", "prefix", F.slice("a", F.lit(1), F.col("prefix")).alias("common"), after("a").alias("a"), after("b").alias("b"))
    rows = rows.withColumn("prompt", _rendered(F.col("common")))
    base = F.length("prompt")
    return rows.select(
        "chosen_id", "rejected_id", F.col("prefix").cast("long").alias("prefix_turns"), "prompt",
        _rendered(F.col("a")).alias("chosen"), _spans(F.col("a"), base, learned).alias("chosen_spans"),
        _rendered(F.col("b")).alias("rejected"), _spans(F.col("b"), base, learned).alias("rejected_spans"),
    )
