"""Sets of points and boxes: membership, region search, joins of points with boxes and of rectangles.

What a tree of points does in memory is done here by keys: space is divided into cells (``cells``), which are
split where points and boxes crowd. Joins are equi-joins on cells with the exact test behind it, and need no distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.geometry import box_contains, l1_distance
from inkspan.functions.tables import parts, stored
from inkspan.operators.cells import CELL, LEAF, MOST, Cells, shifted


def insert(points: DataFrame, new: DataFrame) -> DataFrame:
    """The set with the new points."""
    return points.union(new).distinct()


def search(points: DataFrame, asked: DataFrame, dims: tuple[str, ...] = ("d0", "d1")) -> DataFrame:
    """The asked points that are in the set."""
    return asked.join(points, list(dims), "left_semi")


def delete(points: DataFrame, gone: DataFrame, dims: tuple[str, ...] = ("d0", "d1")) -> DataFrame:
    """The set without some points; all others stay found."""
    return points.join(gone, list(dims), "left_anti")


#: Bits of a coordinate in a key, and what is added to it: keys cover -2**30 to 2**30 - 1, beyond which they stay the same.
Z_BITS, Z_SHIFT = 31, 1 << 30


def _inside(x: int) -> int:
    return min(max(x + Z_SHIFT, 0), 2**Z_BITS - 1)


def z_key(d0: Column, d1: Column) -> Column:
    """The coordinates' bits in turn, so that places with near keys are near in both dimensions."""
    def spread(x: Column) -> Column:
        x = F.greatest(F.least(x.cast("long") + Z_SHIFT, F.lit(2**Z_BITS - 1).cast("long")), F.lit(0).cast("long"))
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
        return x

    return spread(d0).bitwiseOR(F.shiftleft(spread(d1), 1))


def key_ranges(lo: tuple[int, int], hi: tuple[int, int], most: int = 64) -> list[tuple[int, int]]:
    """Ranges of keys, both ends included, that cover a closed box: ``most`` at most, the largest cells divided first."""
    lo, hi = tuple(map(_inside, lo)), tuple(map(_inside, hi))
    if lo[0] > hi[0] or lo[1] > hi[1]:
        return []
    first = lambda k, i, j: sum(((i << k >> b & 1) << 2 * b) | ((j << k >> b & 1) << 2 * b + 1) for b in range(Z_BITS))
    meets = lambda k, c, d: c << k <= hi[d] and ((c + 1) << k) - 1 >= lo[d]
    within = lambda k, c, d: c << k >= lo[d] and ((c + 1) << k) - 1 <= hi[d]
    done, level = [], [(0, 0)]
    for k in range(Z_BITS, -1, -1):
        whole = [c for c in level if within(k, c[0], 0) and within(k, c[1], 1)]
        done += [(k, *c) for c in whole]
        part = [c for c in level if c not in whole]
        below = [(2 * i + a, 2 * j + b) for i, j in part for a in (0, 1) for b in (0, 1)]
        below = [c for c in below if k and meets(k - 1, c[0], 0) and meets(k - 1, c[1], 1)]
        if not k or len(done) + len(below) > most:
            done += [(k, *c) for c in part]
            break
        level = below
    out: list[tuple[int, int]] = []
    for a, z in sorted((first(*c), first(*c) + 4 ** c[0] - 1) for c in done):
        if out and a == out[-1][1] + 1:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def region_search(points: DataFrame, lo: tuple[int, int], hi: tuple[int, int], key: str | None = None) -> DataFrame:
    """Points in a closed box. Of files that ``optimised`` has laid out, with their column ``key``, the row groups
    whose keys or coordinates can't be in the box aren't read, whichever dimension it is narrow in."""
    inside = box_contains(F.col("d0"), F.col("d1"), *[F.lit(x) for x in (*lo, *hi)])
    if key:
        near = F.lit(False)
        for a, z in key_ranges(lo, hi):
            near = near | F.col(key).between(a, z)
        inside = near & inside
    return points.where(inside)


def optimised(points: DataFrame, files: int, key: str = "z") -> DataFrame:
    """Points with their ``key``, dealt into ranges of it and sorted by it, to be written so that statistics prune region searches."""
    return points.withColumn(key, z_key(F.col("d0"), F.col("d1"))).repartitionByRange(files, key).sortWithinPartitions(key, "d0", "d1")


def extremes(points: DataFrame) -> DataFrame:
    """The first and last point along each dimension; ties go by the other dimension."""
    one = lambda f, a, b: f(F.struct(a, b), F.struct(a, b))
    return points.agg(one(F.min_by, "d0", "d1").alias("min0"), one(F.max_by, "d0", "d1").alias("max0"), one(F.min_by, "d1", "d0").alias("min1"), one(F.max_by, "d1", "d0").alias("max1"))


def region_join(points: DataFrame, boxes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Each pair of a point (d0, d1) and a closed box (lo0, lo1, hi0, hi1) that holds it, with both sides' columns.

    Boxes whose corners are exchanged hold nothing.
    """
    corner = lambda df, x, y: df.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).where("x is not null and y is not null")
    good = boxes.where("lo0 <= hi0 and lo1 <= hi1")
    cells = Cells(corner(points, "d0", "d1").union(corner(good, "lo0", "lo1")), corner(good, "hi0", "hi1"), leaf)
    pairs = cells.dealt(cells.of_points(points, "d0", "d1")).join(cells.of_boxes(good, "lo0", "lo1", "hi0", "hi1"), CELL)
    inside = box_contains(F.col("d0"), F.col("d1"), F.col("lo0"), F.col("lo1"), F.col("hi0"), F.col("hi1"))
    return pairs.where(inside).drop(*CELL)


def overlap_join(a: DataFrame, b: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Each pair of rectangles (x, y, w, h) of two tables that share a point, columns as a_... and b_....

    A pair counts in the leaf of the shared area's first corner and in no other.
    """
    def sided(df: DataFrame, side: str) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
        x, y, w, h = (F.col(f"{side}_{c}") for c in "xywh")
        return df.where((w >= 0) & (h >= 0)).withColumns({f"_{side}_x1": x + w, f"_{side}_y1": y + h})

    left, right = sided(a, "a"), sided(b, "b")
    corner = lambda df, x, y: df.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).where("x is not null and y is not null")
    cells = Cells(corner(left, "a_x", "a_y").union(corner(right, "b_x", "b_y")), corner(left, "_a_x1", "_a_y1").union(corner(right, "_b_x1", "_b_y1")), leaf)
    pairs = cells.dealt(cells.of_boxes(left, "a_x", "a_y", "_a_x1", "_a_y1")).join(cells.of_boxes(right, "b_x", "b_y", "_b_x1", "_b_y1"), CELL)
    shift = cells.shift(F.col("_depth"))
    first = (F.col("_i") == shifted(F.greatest("a_x", "b_x"), shift)) & (F.col("_j") == shifted(F.greatest("a_y", "b_y"), shift))
    meets = F.expr("a_x <= _b_x1 and b_x <= _a_x1 and a_y <= _b_y1 and b_y <= _a_y1")
    return pairs.where(first & meets).select([c for c in pairs.columns if not c.startswith("_")])


#: Cells that an asked point is compared with at one depth, about.
FAN = 64


def _beside(df: DataFrame, rows: int) -> DataFrame:
    """One side of an equi-join: it goes to every task while it is small, and is sorted, which spills, where it isn't."""
    return F.broadcast(df) if rows <= MOST else df.hint("merge")


def nearest(points: DataFrame, asked: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(d0, d1, near0, near1, distance): of each distinct asked point the nearest one of the set by the sum of absolute
    differences; of equally near ones the one with the least coordinates.

    Goes down the tree of cells: of an asked point's cells those stay that may be nearer than the farthest that some
    other one's nearest point can be. Sides of a cell's bounds touch a point each, which gives that limit. What is left
    are a few leaves, whose points are compared. These pairs are many: they pass through and only least numbers are kept,
    first the distance's, then the coordinates' at that distance.
    """
    corners = points.select(F.col("d0").cast("long").alias("x"), F.col("d1").cast("long").alias("y")).where("x is not null and y is not null")
    cells = Cells(corners, leaf=leaf)
    placed = stored(cells.dealt(cells.of_points(cells.corners.withColumnsRenamed({"x": "near0", "y": "near1"}), "near0", "near1")))
    bounds = F.min("near0").alias("x0"), F.max("near0").alias("x1"), F.min("near1").alias("y0"), F.max("near1").alias("y1")
    leaves = placed.groupBy(*CELL).agg(*bounds)
    up = F.inline(F.transform(F.sequence(F.lit(0), F.col("_depth")), lambda k: F.struct(k.alias("k"), *[shifted(F.col(c), cells.shift(k) - cells.shift(F.col("_depth"))).alias(n) for c, n in (("_i", "i"), ("_j", "j"))])))
    tree = leaves.select(up, "x0", "x1", "y0", "y1").groupBy("k", "i", "j").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    finer = cells.shift(F.col("k") - 1) - cells.shift(F.col("k"))
    # four at most have no parent: theirs is (-1, 0, 0)
    parent = [(F.col("k") - 1).alias("pk"), *[F.when(F.col("k") > 0, shifted(F.col(c), finer)).otherwise(F.lit(0).cast("long")).alias(f"p{c}") for c in "ij"]]
    tree = stored(tree.select(*parent, *[F.col(c).alias(f"_{c}") for c in ("k", "i", "j")], "x0", "x1", "y0", "y1"))
    kids = {r.pk: r["count"] for r in tree.groupBy("pk").count().collect()}  # a row for each depth

    q = {"x": F.col("d0").cast("long"), "y": F.col("d1").cast("long")}
    outside = {a: F.greatest(F.col(f"{a}0") - q[a], q[a] - F.col(f"{a}1"), F.lit(0).cast("long")) for a in "xy"}
    ends = {a: (F.abs(q[a] - F.col(f"{a}0")), F.abs(q[a] - F.col(f"{a}1"))) for a in "xy"}
    # the least distance that a cell's points can have, and one that some point of it doesn't exceed
    near, limit = outside["x"] + outside["y"], F.least(F.least(*ends["x"]) + F.greatest(*ends["y"]), F.greatest(*ends["x"]) + F.least(*ends["y"]))

    asked = stored(asked.select("d0", "d1").where("d0 is not null and d1 is not null").distinct())
    tasks = parts(asked.sparkSession, FAN * asked.count())
    none = F.lit(0).cast("long")
    rows = asked.withColumns({"k": F.lit(-1), "i": none, "j": none, "near": none, "least": F.lit(2**63 - 1)})
    for k in range(-1, len(cells.shifts) - 1):
        rows = rows.join(_beside(tree.where(F.col("pk") == k), kids.get(k, 0)), F.expr("k = pk and i = pi and j = pj"), "left")
        split = F.col("_k").isNotNull()
        rows = rows.select("d0", "d1", *[F.coalesce(f"_{c}", c).alias(c) for c in ("k", "i", "j")], F.when(split, near).otherwise(F.col("near")).alias("near"), F.when(split, F.least(limit, "least")).otherwise(F.col("least")).alias("limit"), "least")
        rows = rows.where("near <= least").repartition(tasks, "d0", "d1").withColumn("least", F.min("limit").over(Window.partitionBy("d0", "d1")))
        # put down at each depth, so that a task holds what one takes and not that of all
        rows = stored(rows.where("near <= least").drop("limit"))
    rows = rows.select("d0", "d1", F.col("k").alias("_depth"), F.col("i").alias("_i"), F.col("j").alias("_j"), "near")
    n = rows.count()
    far = l1_distance(F.col("d0"), F.col("d1"), F.col("near0"), F.col("near1"))
    best = _beside(rows, n).join(placed, CELL).groupBy("d0", "d1").agg(F.min(far).alias("distance"))
    rows = rows.join(best, ["d0", "d1"]).where("near <= distance")
    found = _beside(rows, n).join(placed, CELL).where(far == F.col("distance"))
    # at one distance and near0 there are two places at most, one on each side of d1
    sides = {s: F.min(F.when(F.expr(f"near1 {s} d1"), F.col("near0"))) for s in ("<=", ">")}
    found = found.groupBy("d0", "d1", "distance").agg(sides["<="].alias("low"), sides[">"].alias("high"))
    rest = F.col("distance") - F.abs(q["x"] - F.col("near0"))
    found = found.select("d0", "d1", "distance", F.least("low", "high").alias("near0"), F.expr("low <= high or high is null").alias("is_low"))
    return found.select("d0", "d1", "near0", F.when(F.col("is_low"), q["y"] - rest).otherwise(q["y"] + rest).alias("near1"), "distance")
