"""Space in cells that are split where it is crowded: a tree of squares, kept as a table.

A cell of depth k is a pair of coordinates without their last ``shifts[k]`` bits. A cell that holds more than
``leaf`` things is split into the cells of the next depth, ``STEP`` bits finer each way; each depth has a table of the cells
that are split, which are at most ``MOST``, however much there is. Things are counted only in cells whose parent is split, so
counting takes the memory of these cells and ends with the last depth that splits any. A point lies in one leaf, a box in every
leaf that it meets, so joins on leaves are equi-joins whose groups stay small where points crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.tables import parts, stored

#: Things in a leaf, about; bits by which a cell's sides are divided; and split cells at each depth: 1 MB of rows.
LEAF, STEP, MOST = 1_000, 3, 1 << 16
#: The columns that name a cell.
CELL = ["_depth", "_i", "_j"]


def shifted(x: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", x.cast("long"), F.lit(bits) if isinstance(bits, int) else bits)


class Cells:
    """The split cells (depth, i, j) of things with first corners (x, y); ``ends`` are corners that lie in the space too."""

    def __init__(self, corners: DataFrame, ends: DataFrame | None = None, leaf: int = LEAF):
        edge = lambda df: df.agg(F.count("*").alias("n"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far")).first()
        self.corners = corners = stored(corners.select("x", "y"))
        n, far = edge(corners)
        far = max(far or 0, (edge(ends)["far"] or 0) if ends is not None else 0)
        self.shifts = [*range(far.bit_length(), 0, -STEP), 0]
        self.most = max(leaf, n // MOST)
        self.parts = parts(corners.sparkSession, n)
        self.splits: list[DataFrame] = []
        for s in self.shifts[:-1]:
            at = corners.withColumns({"i": shifted(F.col("x"), s), "j": shifted(F.col("y"), s)})
            if self.splits:
                above = self.splits[-1].withColumnsRenamed({"i": "_si", "j": "_sj"})
                at = at.join(F.broadcast(above), (shifted(F.col("x"), last) == F.col("_si")) & (shifted(F.col("y"), last) == F.col("_sj")), "left_semi")
            split = stored(at.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") > self.most).select("i", "j"))
            if split.isEmpty():
                break
            self.splits.append(split)
            last = s
        self.shifts = self.shifts[: len(self.splits) + 1]

    def _descend(self, df: DataFrame, step) -> DataFrame:
        """Depth by depth, ``step`` moves the rows whose cell is split on to the next depth."""
        for k, split in enumerate(self.splits):
            split = split.select(F.col("i").alias("_si"), F.col("j").alias("_sj"))
            # MOST rows at most
            df = df.join(F.broadcast(split), (F.col("_depth") == k) & (F.col("_i") == F.col("_si")) & (F.col("_j") == F.col("_sj")), "left")
            df = step(df, F.col("_si").isNotNull(), k).drop("_si", "_sj")
        return df

    def of_points(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """``points`` with the leaf that each lies in; points without coordinates drop out."""
        def step(df: DataFrame, split: Column, k: int) -> DataFrame:
            s = self.shifts[k + 1]
            new = F.lit(k + 1), shifted(F.col(x), s), shifted(F.col(y), s)
            return df.withColumns({c: F.when(split, v).otherwise(F.col(c)) for c, v in zip(CELL, new, strict=True)})

        s = self.shifts[0]
        points = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        return self._descend(points.withColumns({"_depth": F.lit(0), "_i": shifted(F.col(x), s), "_j": shifted(F.col(y), s)}), step)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with cells, dealt out by these to as many tasks as there are things for."""
        return rows.repartition(self.parts, *CELL)

    def of_boxes(self, boxes: DataFrame, lo0: str, lo1: str, hi0: str, hi1: str) -> DataFrame:
        """A row for each leaf that a closed box meets; boxes whose corners are exchanged or null meet none."""
        def cells(k: int, i0: Column, i1: Column, j0: Column, j1: Column) -> Column:
            every = F.transform(F.sequence(i0, i1), lambda i: F.transform(F.sequence(j0, j1), lambda j: F.struct(F.lit(k).alias("_depth"), i.alias("_i"), j.alias("_j"))))
            return F.flatten(every)

        def step(df: DataFrame, split: Column, k: int) -> DataFrame:
            s, finer = self.shifts[k + 1], self.shifts[k] - self.shifts[k + 1]
            first = lambda c, lo: F.greatest(F.shiftleft(F.col(c), finer), shifted(F.col(lo), s))
            last = lambda c, hi: F.least(F.shiftleft(F.col(c) + 1, finer) - 1, shifted(F.col(hi), s))
            below = cells(k + 1, first("_i", lo0), last("_i", hi0), first("_j", lo1), last("_j", hi1))
            rest = [c for c in df.columns if c not in (*CELL, "_si", "_sj")]
            return df.select(*rest, "_si", "_sj", F.inline(F.when(split, below).otherwise(F.array(F.struct(*CELL)))))

        boxes = boxes.where((F.col(lo0) <= F.col(hi0)) & (F.col(lo1) <= F.col(hi1)))
        s = self.shifts[0]
        top = cells(0, *[shifted(F.col(c), s) for c in (lo0, hi0, lo1, hi1)])
        return self._descend(boxes.repartition(self.parts).select("*", F.inline(top)), step)

    def shift(self, depth: Column) -> Column:
        """The bits that cells of a depth leave out."""
        return F.element_at(F.array(*[F.lit(s) for s in self.shifts]), depth + 1)
