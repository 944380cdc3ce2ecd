"""Hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws.

At a node, child c with weight w draws -ln(u) / w, where u is a hash of the key and the child's path; the
smallest draw wins, so a child gets w / sum(w) of the node's rows. When one weight changes, a row can only
move into or out of the subtrees whose weights changed: all other draws stay as they were. Capacity that
is added as a region of its own takes rows into itself alone.

Defined cases: a null key is a key like any other; rows with equal keys share a shard; an empty table gives
an empty result; ties between draws go to the first path.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, fresh

#: Rows in a range that is numbered at once, about.
RANGE_ROWS = 2_000
#: Bits of a hash draw.
BITS = 48


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, racks: int = 2, shards: int = 2, full: int | None = None) -> list[Leaf]:
    """``n_shards`` equal shards, ``shards`` to a rack and ``racks`` to a region.

    Shards from ``full`` on are capacity added later: each is a region of its own.
    """
    base = n_shards if full is None else min(full, n_shards)
    leaves = [Leaf(s // (racks * shards), s // shards % racks, s) for s in range(base)]
    first = 1 + max((x.region for x in leaves), default=-1)
    return leaves + [Leaf(first + i, 0, s) for i, s in enumerate(range(base, n_shards))]


def _draw(key: Column, path: str) -> Column:
    """A uniform draw in (0, 1) for the key at the node ``path``."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + path))), 1, BITS // 4), 16, 10).cast("double")
    return (bits + 0.5) / float(2**BITS)


def _winner(key: Column, children: list[tuple[str, float, object]]) -> Column:
    """The value of the child with the smallest draw; ties go to the first."""
    if len(children) == 1:
        return F.lit(children[0][2])
    draws = [F.struct((-F.log(_draw(key, path)) / weight).alias("draw"), F.lit(i).alias("i"), F.lit(value).alias("value")) for i, (path, weight, value) in enumerate(children)]
    return F.array_min(F.array(*draws))["value"]


def with_shard(df: DataFrame, key: Column, leaves: list[Leaf], name: str) -> DataFrame:
    """``df`` with a column of shard numbers, whose name must be free; one narrow expression a level, no shuffle."""
    if fresh(df, name) != name:
        raise ValueError(f"there is a column {name} already")
    if not leaves or any(not math.isfinite(x.weight) or x.weight <= 0 for x in leaves):
        raise ValueError("every shard needs a weight above 0")
    key = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    regions: dict[int, dict[int, list[Leaf]]] = {}
    for x in leaves:
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    heavy = lambda part: sum(x.weight for x in part)
    r, k = fresh(df, f"_{name}_region"), fresh(df, f"_{name}_rack")
    df = df.withColumn(r, _winner(key, [(f"{a}", heavy(x for p in racks.values() for x in p), a) for a, racks in sorted(regions.items())]))
    by_rack = F.coalesce(*[F.when(F.col(r) == a, _winner(key, [(f"{a}/{b}", heavy(part), b) for b, part in sorted(racks.items())])) for a, racks in sorted(regions.items())])
    df = df.withColumn(k, by_rack)
    leaf = F.coalesce(*[F.when((F.col(r) == a) & (F.col(k) == b), _winner(key, [(f"{a}/{b}/{x.shard}", x.weight, x.shard) for x in part])) for a, racks in sorted(regions.items()) for b, part in sorted(racks.items())])
    return df.withColumn(name, leaf.cast("int")).drop(r, k)


def with_slot(rows: DataFrame, shard: str, tie: list[str]) -> DataFrame:
    """Stored rows that stand for ``n`` equal rows each, as so many rows with a gapless number from 0 within each shard, in
    the order of a hash of ``tie``, which must tell all rows apart.

    Rows are numbered within ranges of the hash, whose sizes give each range's first number; no task holds a shard.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in tie]
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit("slot"), *known).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    ranges = max(64, math.ceil(rows.count() / RANGE_ROWS))
    rows = rows.withColumn("_bits", bits).withColumn("_range", F.floor(F.col("_bits").cast("double") * float(ranges) / float(2**BITS)).cast("int"))
    sizes = rows.groupBy(shard, "_range").agg(F.sum("n").alias("_size"))
    first = sizes.select(shard, "_range", (F.sum("_size").over(Window.partitionBy(shard).orderBy("_range")) - F.col("_size")).alias("_first"))
    line = Window.partitionBy(shard, "_range").orderBy("_bits", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_number", F.sum("n").over(line) - F.col("n")).join(first, [shard, "_range"])
    start = F.col("_first") + F.col("_number")
    return rows.withColumn("slot", F.explode(F.sequence(start, start + F.col("n") - 1))).drop("_bits", "_range", "_number", "_first", "n")


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot and grown_shard.

    The id and the number of shards decide (law ``key``); one more shard takes rows only into itself. Rows that agree
    in id, size and checksum are put together with their number before any is numbered.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = with_shard(rows, F.col("_id"), topology(n_shards), "shard")
    rows = with_shard(rows, F.col("_id"), topology(n_shards + 1, full=n_shards), "grown_shard")
    rows = with_slot(Scratch(docs.sparkSession).save(rows, "rows"), "shard", ["_id", "text_crc32", "size"])
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
