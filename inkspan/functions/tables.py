"""Tables that are used more than once, and joins on columns that may be null."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of its own if driver and tasks are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, so that it is worked out once and survives lost executors; it goes when
    the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkspan-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that one task sorts or groups, about.
ROWS = 1 << 19


def parts(spark: SparkSession, rows: int) -> int:
    """How many tasks share so many rows: what one holds doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended; its folder goes with it
        pass


def join_same(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``other`` where the named columns agree, null with null."""
    names = {c: f"_same{i}" for i, c in enumerate(on)}
    other = other.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(other, reduce(lambda a, b: a & b, same), how).drop(*names.values())


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 in the order of columns that tell them apart.

    Rows are dealt into ranges and numbered within them; the ranges' sizes give each one's first number.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(4 * n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", inside).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")
