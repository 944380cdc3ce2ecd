"""What the operators share: scratch tables in the cluster's shared folder, blocks of
documents, and connected components."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One regular expression for a word, the same in Java and in DuckDB.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that Spark hands to Python at once while a scratch table is written: texts and lists of hashes are
#: long, and both sides hold a batch in memory.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
#: Shuffle files go when the action that made them has ended: what it wrote is all that is read later.
CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Equal rows that may be dealt to one task, and that one row stands for where there are more.
COPIES, PIECE = 16, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one if driver and tasks are one process
    (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive lost executors.

    ``drop`` frees a table as soon as nothing reads it any more; the rest goes when the
    application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/inkspan-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with self.tidy():
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def tidy(self):
        """Actions inside hand Python small batches and leave no shuffle files."""
        before = {c: self.spark.conf.get(c) for c in (BATCH_CONF, CLEAN_CONF)}
        self.spark.conf.set(BATCH_CONF, str(min(BATCH_ROWS, int(before[BATCH_CONF]))))
        self.spark.conf.set(CLEAN_CONF, "true")
        try:
            yield
        finally:
            for c, value in before.items():
                self.spark.conf.set(c, value)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended; its folder goes with it
            pass


def text_bytes(docs: DataFrame, text: str) -> int:
    """The bytes of a column of texts (one pass over it)."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def n_blocks(docs: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` of text the table has."""
    return max(1, math.ceil(text_bytes(docs, text) / block_bytes))


def block_of(key: Column, n: int, seed: int = 11) -> Column:
    """The block of a row: a hash of its key, so that no source or group of copies fills one block."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """The checked bound before a broadcast; callers shuffle instead when it is exceeded."""
    return df.limit(max_rows + 1).count() <= max_rows


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(*columns: Column) -> tuple[Column, Column]:
    """128 bits that tell apart rows that differ in a column, also in which of them are null."""
    null = [c.isNull() for c in columns]
    return F.xxhash64(*columns, *null), F.xxhash64(F.lit(1), *columns, *null)


def without(docs: DataFrame, key: tuple[Column, Column], gone: DataFrame, max_rows: int = 2_000_000, how: str = "left_anti") -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (a stored table of k0 and k1); left_semi: only these.

    Up to ``max_rows`` keys (16 bytes each) are broadcast; more are joined by a shuffle.
    """
    gone = gone.select(F.col("k0").alias(fresh(docs, "k0")), F.col("k1").alias(fresh(docs, "k1")))
    gone = F.broadcast(gone) if small_enough(gone, max_rows) else gone
    return docs.join(gone, (key[0] == gone[gone.columns[0]]) & (key[1] == gone[gone.columns[1]]), how)


def once(docs: DataFrame, key: tuple[Column, Column]) -> DataFrame:
    """One row of each key; copies are put together before the shuffle."""
    k0, k1 = fresh(docs, "once0"), fresh(docs, "once1")
    return docs.withColumns({k0: key[0], k1: key[1]}).dropDuplicates([k0, k1]).drop(k0, k1)


def dealt(rows: DataFrame, key: list[str], scratch: Scratch, most: int = COPIES, piece: int = PIECE) -> DataFrame:
    """``rows`` with columns piece and copies: rows of which more than ``most`` agree in ``key``, which all their columns follow
    from, are put together as rows that stand for up to ``piece`` of them each and differ in ``piece``; others stand for
    themselves. So no deal by key and piece brings a group of equal rows into one task; ``undealt`` is the way back.
    """
    k0, k1 = row_key(*[F.col(c) for c in key])
    many = rows.groupBy(k0.alias("k0"), k1.alias("k1")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    many = scratch.save(many, "many")
    if not many.limit(1).count():
        return rows.withColumns({"piece": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    alone = without(rows, (k0, k1), many.select("k0", "k1")).withColumns({"piece": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    heads = once(without(rows, (k0, k1), many.select("k0", "k1"), how="left_semi"), (k0, k1))
    heads = heads.withColumns({"k0": k0, "k1": k1}).join(many, ["k0", "k1"]).drop("k0", "k1")
    heads = heads.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {piece})")))
    return alone.unionByName(heads.withColumn("copies", F.least(F.lit(piece), F.col("n") - F.col("piece") * piece).cast("long")).drop("n"))


def undealt(rows: DataFrame) -> DataFrame:
    """Each row as often as its column copies says, without that column."""
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def components(edges: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex that has an edge.

    Each round takes the smallest label among a vertex and its neighbours and then follows the
    label's own label, so that chains shorten by half; rounds end when no label changes.
    """
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("w")).union(edges.select(F.col(b), F.col(a)))
    both = scratch.save(both.distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")), f"{name}-0")
    for i in range(1, 1000):
        near = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("root").alias("near"))
        step = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("far"))
        step = step.join(jump, "root", "left").select("v", "old", F.least("root", "far").alias("root"))
        step = scratch.save(step, f"{name}-{i}")
        changed = step.where("old <> root").limit(1).count()
        labels = step.select("v", "root")
        scratch.drop(f"{name}-{i - 1}")
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")
