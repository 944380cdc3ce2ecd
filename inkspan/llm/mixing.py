"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts.

A row's hash-random key comes from its id, text and source, and rows fall into key ranges of their source; sums
of the ranges give each range's first position, and a running sum inside the range the row's. A source whose
target is q times its size and r words more takes every document q times, and in key order the first r words
once more; the document at the cut gives the words that are missing. The order is that of the keys, whatever
the ranges are, so their number decides how work is dealt out and nothing else.

Rows that agree in id, text and source are put together with their number before anything is dealt out, and count
that many times their size; so no id, however often it occurs, and no copies fill a range.

Targets: weights share the whole size, no target is above ``max_epochs`` times its source's size, and what
is above goes to the others by weight. That is min(cap, weight * level) with one level for all, found from
the sources sorted by cap / weight.

Defined cases: a null source is a source of its own, sorted last; a null text has size 0; documents of size
0 are taken 0 words; rows that repeat are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import WORD, Scratch, fresh, once, row_key, small_enough, without

#: Documents in a key range, about.
RANGE_ROWS = 2_000
#: Documents whose counts may be broadcast to the join with their texts (16 bytes each).
BROADCAST_ROWS = 2_000_000
#: Bits of the hash-random key.
BITS = 48


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0) -> DataFrame:
    """(src, source_size, target) from (src, source_size); ``src`` sorts by code point, null last.

    A table with one row a source: the windows here hold a source list, not documents.
    """
    rank = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    every = Window.partitionBy()
    line = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if exactly the sources before this one are at their caps; it holds if this one isn't
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(line), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return s.select("src", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _placed(docs: DataFrame, weights: tuple[float, ...], max_epochs: float, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(_id, k0, k1, n, size, source_size, target, epochs, left): a row for each kind of row, of which there are ``n``.

    left: the words that the cut leaves to these rows together.
    """
    scratch = Scratch(docs.sparkSession)
    source = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    text = F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.lit("-"))
    name = F.concat_ws("/", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text, source)
    key = F.conv(F.substring(F.md5(name.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    k0, k1 = row_key(*(F.col(c) for c in (id_col, text_col, source_col)))
    sized = docs.select(F.col(id_col).alias("_id"), source.alias("src"), key.alias("key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), k0.alias("k0"), k1.alias("k1"))
    sized = scratch.save(sized.groupBy(*sized.columns).agg(F.count("*").alias("n")), "sized")
    ranges = max(64, math.ceil(sized.count() / RANGE_ROWS))
    sized = sized.withColumn("range", F.floor(F.col("key").cast("double") * float(ranges) / float(2**BITS)).cast("int")).withColumn("words", F.col("n") * F.col("size"))

    sums = scratch.save(sized.groupBy("src", "range").agg(F.sum("words").alias("words")), "sums")
    goal = targets(sums.groupBy("src").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    goal = scratch.save(goal.withColumn("more", F.col("budget") - F.col("epochs") * F.col("source_size")), "goal")
    first = F.sum("words").over(Window.partitionBy("src").orderBy("range")) - F.col("words")
    starts = scratch.save(sums.select("src", "range", first.alias("first")).join(goal, "src"), "starts")

    line = Window.partitionBy("src", "range").orderBy("key", "_id", "k0", "k1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("inside", F.sum("words").over(line) - F.col("words")).join(starts, ["src", "range"])
    left = F.greatest(F.lit(0), F.least("words", F.col("more") - F.col("first") - F.col("inside"))).cast("long")
    return placed.select("_id", "k0", "k1", "n", "size", "source_size", "target", "epochs", left.alias("left"))


def takes(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken, epochs and cut.

    epochs: how often the whole document is taken; cut: the words taken once more from its start.
    """
    rows = _placed(docs, weights, max_epochs, id_col, text_col, source_col, seed)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    cut = F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("copy") * F.col("size"))).cast("long")
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).alias("taken"), "epochs", cut.alias("cut"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken, with the columns of ``docs``.

    A document that the cut divides is taken whole, so texts stay whole and a source's words stay within
    one document of its target. Rows with one id, text and source come together as often as all of them are
    taken, with the other columns of one of them.
    """
    scratch = Scratch(docs.sparkSession)
    once_more = F.when(F.col("left") > 0, F.ceil(F.col("left") / F.col("size"))).otherwise(0)
    often = _placed(docs, weights, max_epochs, id_col, text_col, source_col, seed).select("k0", "k1", (F.col("n") * F.col("epochs") + once_more).cast("long").alias("n"), F.col("n").alias("rows"))
    often = scratch.save(often.where("n > 0"), "often")
    key = row_key(*(docs[c] for c in (id_col, text_col, source_col)))
    copies = scratch.save(often.where("rows > 1").select("k0", "k1"), "copies")
    if copies.limit(1).count():
        one = once(without(docs, key, copies, how="left_semi"), row_key(*(F.col(c) for c in (id_col, text_col, source_col))))
        docs = without(docs, key, copies).unionByName(one)
        key = row_key(*(docs[c] for c in (id_col, text_col, source_col)))
    names = {c: fresh(docs, c) for c in ("k0", "k1", "n")}
    often = often.select(*[F.col(c).alias(name) for c, name in names.items()])
    often = F.broadcast(often) if small_enough(often, BROADCAST_ROWS) else often
    mixed = docs.join(often, (key[0] == often[names["k0"]]) & (key[1] == often[names["k1"]]))
    return mixed.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(names["n"]).cast("int"))).alias(fresh(docs, "i"))).select([F.col(f"`{c}`") for c in docs.columns])
