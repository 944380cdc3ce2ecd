"""Joins and searches in space against brute force, crowded and empty places included."""

import random

import pytest
from pyspark.sql import functions as F

from inkspan.functions import tables
from inkspan.operators import spatial
from inkspan.operators.cells import CELL, Cells

PLACES = "d0 long, d1 long"


def crowd(pick, n):
    """Points of which most lie in a small square and some far out, negative too."""
    near = [(5000 + pick.randrange(40), -3000 + pick.randrange(40)) for _ in range(n)]
    return near + [(pick.randrange(-100_000, 100_000), pick.randrange(-100_000, 100_000)) for _ in range(n // 4)]


@pytest.fixture(scope="module")
def points():
    return sorted(set(crowd(random.Random(1), 1200)))


@pytest.mark.parametrize("leaf", [5, 100, 100_000])
def test_region_join(spark, points, leaf):
    pick = random.Random(2)
    boxes = [(i, x, y, x + pick.choice([0, 3, 30, 90_000]), y + pick.choice([0, 3, 30, 90_000])) for i, (x, y) in enumerate(crowd(pick, 60))]
    boxes += [(-1, 5, 5, 4, 9), (-2, None, 1, 2, 3), (-3, -200_000, -200_000, 200_000, 200_000)]
    p = spark.createDataFrame([*points, (None, 1)], PLACES)
    b = spark.createDataFrame(boxes, "box long, lo0 long, lo1 long, hi0 long, hi1 long")
    got = sorted((r.box, r.d0, r.d1) for r in spatial.region_join(p, b, leaf).collect())
    assert got == sorted((i, x, y) for i, a, c, e, f in boxes if a is not None for x, y in points if a <= x <= e and c <= y <= f)


@pytest.mark.parametrize("leaf", [5, 100_000])
def test_overlap_join(spark, leaf):
    pick = random.Random(3)
    make = lambda n: [(i, x, y, pick.choice([0, 2, 9, 70_000]), pick.choice([0, 2, 9, 50_000])) for i, (x, y) in enumerate(crowd(pick, n))]
    a, b = make(150), make(120) + [(999, 1, 1, -1, 5)]
    kind = "id long, x long, y long, w long, h long"
    got = sorted((r.a_id, r.b_id) for r in spatial.overlap_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), leaf).collect())
    meets = lambda p, q: p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3] and p[2] <= q[2] + q[4] and q[2] <= p[2] + p[4]
    assert got == sorted((p[0], q[0]) for p in a for q in b if q[3] >= 0 and meets(p, q))


def test_crowded_cells_are_split(spark, points):
    """No leaf holds more than it may, and a crowd's candidates are few: not the product of its points and boxes."""
    p = spark.createDataFrame(points, PLACES)
    cells = Cells(p.select(F.col("d0").alias("x"), F.col("d1").alias("y")), leaf=50)
    rows = cells.of_points(p, "d0", "d1")
    assert rows.count() == len(points)
    assert rows.groupBy(*CELL).count().agg(F.max("count")).first()[0] <= 64  # 64: a cell of single places can't exceed what it has
    boxes = p.where("d0 between 5000 and 5040").selectExpr("d0 AS lo0", "d1 AS lo1", "d0 + 1 AS hi0", "d1 + 1 AS hi1")
    candidates = rows.join(cells.of_boxes(boxes, "lo0", "lo1", "hi0", "hi1"), CELL).count()
    n = boxes.count()
    assert n * n / candidates > 20


@pytest.mark.parametrize("leaf", [4, 100_000])
def test_nearest(spark, points, leaf):
    pick = random.Random(4)
    asked = crowd(pick, 60) + [(0, 0), (10**6, -(10**6)), points[0], points[0]]
    got = sorted(tuple(r) for r in spatial.nearest(spark.createDataFrame(points, PLACES), spark.createDataFrame([*asked, (None, 3)], PLACES), leaf).collect())
    assert got == sorted((a, b, x, y, d) for a, b in set(asked) for d, x, y in [min((abs(a - x) + abs(b - y), x, y) for x, y in points)])


def test_nearest_pairs_nothing_with_everything(spark, points):
    out = spatial.nearest(spark.createDataFrame(points, PLACES), spark.createDataFrame(points[:5], PLACES), 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def task_peaks(spark):
    """Bytes of execution memory that each task so far has had at most."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    for i in range(stages.size()):
        s = stages.apply(i)
        tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
        for t in (tasks.apply(k) for k in range(tasks.size())):
            if t.taskMetrics().isDefined():
                yield (s.stageId(), t.taskId()), t.taskMetrics().get().peakExecutionMemory()


def test_pairs_of_nearest_are_not_kept(spark):
    """A task's memory doesn't grow with the pairs of asked points and a leaf's points that it compares."""
    p = spark.range(3000).selectExpr("id * 37 % 3001 AS d0", "id * 101 % 2003 AS d1")
    asked = spark.range(1500).selectExpr("id * 61 % 3011 AS d0", "id * 17 % 2011 AS d1")
    before = {k for k, _ in task_peaks(spark)}
    assert len(spatial.nearest(p, asked, 100_000).collect()) == 1500
    assert max(b for k, b in task_peaks(spark) if k not in before) < 150e6


def test_nearest_without_broadcasts(spark, points, monkeypatch):
    """Trees and candidates that are too large for every task are sorted instead, with the same result."""
    monkeypatch.setattr(spatial, "MOST", 3, raising=False)
    pick = random.Random(6)
    asked = crowd(pick, 60) + [(0, 0), (10**6, -(10**6)), points[0]]
    out = spatial.nearest(spark.createDataFrame(points, PLACES), spark.createDataFrame(asked, PLACES), 20)
    assert "SortMergeJoin" in out._jdf.queryExecution().sparkPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == sorted((a, b, x, y, d) for a, b in set(asked) for d, x, y in [min((abs(a - x) + abs(b - y), x, y) for x, y in points)])


def test_ties_of_nearest(spark):
    """Of many equally near points the one with the least coordinates, on either side."""
    ring = [(x, y) for x in range(-40, 41) for y in {40 - abs(x), abs(x) - 40}]
    for some in (ring, [(x, y) for x, y in ring if y > 0], [(x, y) for x, y in ring if x > 0], [(3, 37), (4, -36)], [(3, -37), (3, 37)]):
        got = spatial.nearest(spark.createDataFrame(some, PLACES), spark.createDataFrame([(0, 0)], PLACES), 8).collect()
        assert [tuple(r) for r in got] == [(0, 0, *min(some), 40)]


def test_tasks_grow_with_the_things(spark, points, monkeypatch):
    """More things are dealt out to more tasks, and only depths at which something is split are counted."""
    p = spark.createDataFrame(points, PLACES)
    corners = p.select(F.col("d0").alias("x"), F.col("d1").alias("y"))
    assert Cells(corners, leaf=100_000).shifts == [17]
    monkeypatch.setattr(tables, "ROWS", 50)
    cells = Cells(corners, leaf=100)
    dealt = cells.dealt(cells.of_points(p, "d0", "d1"))
    assert cells.parts == -(-len(points) // 50) == dealt.rdd.getNumPartitions() > 8
    assert len(cells.splits) == len(cells.shifts) - 1 > 1
    boxes = p.selectExpr("d0 AS lo0", "d1 AS lo1", "d0 AS hi0", "d1 AS hi1")
    joined = spatial.region_join(p, boxes, 100)
    assert joined.count() == len(points)
    assert "REPARTITION_BY_NUM" in joined._jdf.queryExecution().executedPlan().toString()


def test_empty(spark, points):
    p, none = spark.createDataFrame(points[:9], PLACES), spark.createDataFrame([], PLACES)
    boxes = spark.createDataFrame([(0, 0, 1, 1)], "lo0 long, lo1 long, hi0 long, hi1 long")
    assert spatial.region_join(none, boxes).collect() == [] and spatial.region_join(p, boxes.limit(0)).collect() == []
    assert spatial.nearest(none, p).collect() == [] and spatial.nearest(p, none).collect() == []
    rects = spark.createDataFrame([], "x long, y long, w long, h long")
    assert spatial.overlap_join(rects, rects).collect() == []
    one = spark.createDataFrame([(0, 0)], PLACES)
    assert [tuple(r) for r in spatial.nearest(one, p.limit(1)).select("near0", "near1").collect()] == [(0, 0)]


def interleaved(x, y):
    x, y = ((min(max(v + 2**30, 0), 2**31 - 1)) for v in (x, y))
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(31))


def test_keys_and_ranges(spark, points):
    some = [*points[:200], (2**30 - 1, -(2**30)), (2**40, -(2**40)), (0, 0), (-1, -1)]
    rows = spark.createDataFrame(some, PLACES).select("d0", "d1", spatial.z_key(F.col("d0"), F.col("d1")).alias("z")).collect()
    assert all(r.z == interleaved(r.d0, r.d1) for r in rows)
    pick = random.Random(5)
    for most in (1, 4, 64, 1000):
        for _ in range(40):
            lo = pick.randrange(-50, 50), pick.randrange(-50, 50)
            hi = lo[0] + pick.choice([0, 1, 7, 60]), lo[1] + pick.choice([0, 3, 40])
            ranges = spatial.key_ranges(lo, hi, most)
            assert 0 < len(ranges) <= most and all(a <= z for a, z in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
            covered = lambda p: any(a <= interleaved(*p) <= z for a, z in ranges)  # noqa: B023, E731
            assert all(covered((x, y)) for x in range(lo[0], hi[0] + 1) for y in range(lo[1], hi[1] + 1))
            if most == 1000:  # then nothing else is covered
                assert sum(z - a + 1 for a, z in ranges) == (hi[0] - lo[0] + 1) * (hi[1] - lo[1] + 1)
    assert spatial.key_ranges((1, 1), (0, 5)) == []


def rows_read(df):
    """Rows that the scan hands on, which are those of the row groups and pages that statistics don't rule out."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    node = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    todo = [node]
    while todo:
        n = todo.pop()
        if n.nodeName().startswith("Scan parquet"):
            return n.metrics().apply("numOutputRows").value()
        todo += [n.children().apply(i) for i in range(n.children().size())]
    raise AssertionError("no scan")


def test_both_dimensions_prune(spark, tmp_path):
    """A box that is narrow in one dimension, whichever, reads a small part of the rows; sorted by d0 it reads all for d1."""
    grid = spark.range(0, 400 * 400, numPartitions=4).selectExpr("id div 400 AS d0", "id % 400 AS d1")
    small = {"parquet.block.size": 4096, "parquet.block.row.count.limit": 500, "parquet.page.row.count.limit": 500}
    spatial.optimised(grid, 4).write.options(**small).parquet(f"{tmp_path}/z")
    grid.repartitionByRange(4, "d0", "d1").sortWithinPartitions("d0", "d1").write.options(**small).parquet(f"{tmp_path}/sorted")
    laid, plain = spark.read.parquet(f"{tmp_path}/z"), spark.read.parquet(f"{tmp_path}/sorted")
    for lo, hi in (((0, 200), (399, 202)), ((200, 0), (202, 399)), ((100, 100), (120, 120))):
        found = spatial.region_search(laid, lo, hi, "z")
        n = (hi[0] - lo[0] + 1) * (hi[1] - lo[1] + 1)
        assert found.count() == n
        assert rows_read(found) < 0.2 * 160_000, (lo, hi)
    assert rows_read(spatial.region_search(plain, (0, 200), (399, 202))) > 0.9 * 160_000
