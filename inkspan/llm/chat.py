"""Chat formatting by perspective rotation, in DataFrame expressions alone.

A dialogue is rendered once for every participant: that speaker's turns become the assistant's, all others
are named users', system turns stay. Each turn of each rendering is a row with its place, so a long
dialogue is never gathered; the rows' ``rendered`` in the order of ``seq`` are the rendering, and
``mask`` marks the characters from ``loss_start`` to ``loss_end`` that are learned: the assistant's words and
the mark that ends its turn.

Rendered turn: <|role|> or <|user name=N|>, a line feed, the text, <|end|>, a line feed. In texts and names
the strings <| and |> are escaped with a backslash, so no turn can end or begin inside a text.

Turns are dealt by ranges of (conversation, turn, role, text), so a conversation of any size spreads over
many tasks; totals of the ranges give each range its first place.

Defined cases: null texts and roles are empty; a null turn comes first and ties follow role and text; null
conversations are one; rows that repeat are turns of their own; a conversation with only system turns has no
participants and so no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch

#: Turns in a range, about.
RANGE_ROWS = 2_000
SYSTEM = "system"
END = "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, seq, turn, role, name, rendered, start, end, loss_start, loss_end, mask)."""
    scratch = Scratch(turns.sparkSession)
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    line = ["conv_id", "turn", "speaker", "text"]
    parts = max(1, -(-turns.count() // RANGE_ROWS))
    rows = rows.repartitionByRange(parts, *line).sortWithinPartitions(*line)
    rows = scratch.save(rows.withColumn("part", F.spark_partition_id()), "turns")

    # lengths of a turn when its speaker is the assistant and when it is somebody else
    body, name = escaped(F.col("text")), escaped(F.col("speaker"))
    system = F.col("speaker") == SYSTEM
    head_mine = F.lit("<|assistant|>\n")
    head_other = F.when(system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    tail = F.lit(END + "\n")
    length = lambda head: (F.length(head) + F.length(body) + F.length(tail)).cast("long")
    rows = rows.withColumn("other_len", length(head_other)).withColumn("gain", F.when(system, 0).otherwise(length(head_mine) - length(head_other)).cast("long"))

    # places within a range, and what the ranges before hold of the same conversation and perspective
    inside = Window.partitionBy("part", "conv_key").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("conv_key", F.struct("conv_id"))
    rows = rows.withColumn("seq_in", F.count("*").over(inside)).withColumn("len_in", F.coalesce(F.sum("other_len").over(inside), F.lit(0)))
    rows = scratch.save(rows.drop("conv_key"), "placed")
    conv = F.struct("conv_id").alias("key")
    ranges = rows.groupBy(conv, "part").agg(F.count("*").alias("n"), F.sum("other_len").alias("size"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq_0"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("len_0"))
    ranges = scratch.save(ranges, "ranges")
    people = rows.where(~system).groupBy(conv, F.col("speaker").alias("perspective"), "part").agg(F.sum("gain").alias("gained"))
    people = scratch.save(people, "people")
    # a perspective's gains up to each range of its conversation, also those in which it is silent
    cast = people.select("key", "perspective").distinct()
    grid = ranges.join(cast, "key").join(people, ["key", "perspective", "part"], "left")
    gains = Window.partitionBy("key", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("key", "perspective", "part", "seq_0", "len_0", F.coalesce(F.sum("gained").over(gains), F.lit(0)).alias("gain_0"))
    grid = scratch.save(grid, "grid")

    # every turn for every participant
    out = rows.withColumn("key", F.struct("conv_id")).join(grid, ["key", "part"])
    mine = ~system & (F.col("speaker") == F.col("perspective"))
    own = Window.partitionBy("key", "perspective", "part").orderBy("turn", "speaker", "text", "seq_in").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("gain_in", F.coalesce(F.sum(F.when(mine, F.col("gain")).otherwise(0)).over(own), F.lit(0)))
    head = F.when(mine, head_mine).otherwise(head_other)
    out = out.withColumn("start", F.col("len_0") + F.col("len_in") + F.col("gain_0") + F.col("gain_in")).withColumn("rendered", F.concat(head, body, tail))
    out = out.withColumn("end", F.col("start") + F.length("rendered"))
    role = F.when(system, F.lit(SYSTEM)).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    return out.select(
        "conv_id", "perspective", (F.col("seq_0") + F.col("seq_in")).cast("long").alias("seq"), "turn", role.alias("role"), F.when(~system & ~mine, F.col("speaker")).alias("name"), "rendered",
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.when(mine, F.col("start") + F.length(head_mine)).cast("long").alias("loss_start"),
        F.when(mine, F.col("end") - 1).cast("long").alias("loss_end"), F.when(mine, 1).otherwise(0).alias("mask"),
    )
