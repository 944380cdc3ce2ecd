"""Set operations on lists of pages and words, patches, and first and last of equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.tables import join_same, stored


def common_with_copies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, as often as the side that has them less often."""
    return a.intersectAll(b)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_left(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, copies taken off one by one."""
    return a.exceptAll(b)


def without_words(words: DataFrame, stop: DataFrame, word: str = "word") -> DataFrame:
    return words.join(stop, word, "left_anti")


def patch_pointers(rows: DataFrame, patches: DataFrame, doc: str, place: str, ptr: str) -> DataFrame:
    """``rows`` with erroneous pointers corrected: of equal ones only the first, by doc and place.

    patches: (error, correction); of several corrections of one error the smallest counts. The first place
    of each patched pointer comes from an aggregation, so a pointer that all rows have is no group.
    """
    fixes = patches.groupBy(F.col("error").alias(ptr)).agg(F.min("correction").alias("_fix"))
    first = rows.join(fixes, ptr).groupBy(ptr).agg(F.min(F.struct(doc, place)).alias("_first"), F.first("_fix").alias("_fix"))
    out = rows.join(first, ptr, "left")
    hit = F.struct(doc, place) == F.col("_first")
    return out.withColumn(ptr, F.when(hit, F.col("_fix")).otherwise(F.col(ptr))).drop("_first", "_fix").select(rows.columns)


def missing_patches(rows: DataFrame, patches: DataFrame, ptr: str) -> DataFrame:
    """The patches whose error no row has."""
    return patches.join(rows.select(F.col(ptr).alias("error")).distinct(), "error", "left_anti")


def patch_texts(pages: DataFrame, patches: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Pages under their corrected names; a page that moves onto another's name replaces it."""
    out = pages.join(patches.select(F.col("error").alias(doc), "correction"), doc, "left")
    out = out.select(F.coalesce("correction", doc).alias(doc), F.struct(F.col("correction").isNotNull().alias("moved"), F.col(text)).alias("t"))
    return out.groupBy(doc).agg(F.max("t")[text].alias(text))


def last_of_each(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value) of the row that comes last."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def in_first_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, seen): the distinct keys with the place at which each first occurs."""
    return rows.groupBy(key).agg(F.min(order).alias("seen"))


def first_and_last(rows: DataFrame, key: str, order: str, first: str, last: str) -> DataFrame:
    """(key, last, first): where each key comes last and first, in one shuffle."""
    return rows.groupBy(key).agg(F.max(order).alias(last), F.min(order).alias(first))


def middle(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row at the middle of each group, the later one of two.

    Rows are dealt into ranges of keys and order; the ranges' sizes tell which one has a group's middle, and only
    that one's rows of the group are counted off. So a group may be all rows there are.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(4 * n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    line = Window.partitionBy(*keys)
    sizes = sizes.withColumns({"_first": F.sum("_n").over(line.orderBy("_part")) - F.col("_n"), "_rank": F.call_function("div", F.sum("_n").over(line), F.lit(2))})
    hit = sizes.where("_rank >= _first and _rank < _first + _n").select(*keys, "_part", (F.col("_rank") - F.col("_first") + 1).alias("_nth"))
    near = join_same(dealt, hit, [*keys, "_part"])
    near = near.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return near.where("_at = _nth").select(*rows.columns)


def download_report(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(total, downloaded, errors)."""
    rows = wanted.select(key).distinct().join(got.select(key).distinct().withColumn("_got", F.lit(1)), key, "left")
    return rows.agg(F.count("*").alias("total"), F.count("_got").alias("downloaded"), (F.count("*") - F.count("_got")).alias("errors"))
