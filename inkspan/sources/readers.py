"""Readers of the files that an OCR comparison works on. All read whole folders or globs as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions.text import base_name
from inkspan.sources import schemas


def _named(df: DataFrame) -> DataFrame:
    """ptr and provider from names like ptr.provider.json, or from the folders partitionBy has made."""
    name = base_name(F.input_file_name())
    if "provider" in df.columns and "ptr" in df.columns:
        return df
    return df.withColumns({"ptr": F.split_part(name, F.lit("."), F.lit(1)), "provider": F.split_part(name, F.lit("."), F.lit(2))})


def results(spark: SparkSession, path: str) -> DataFrame:
    """Answers kept as JSON, one a file: ptr, provider and the envelope's columns."""
    return _named(spark.read.schema(schemas.RESULT).option("multiLine", True).json(path))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Answers that ``sinks.results`` has written: a folder for each provider, many answers a file."""
    return spark.read.schema("ptr string, " + schemas.RESULT + ", provider string").json(path)


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Trees of blocks, lines and words, one JSON a file (.blw)."""
    return _named(spark.read.schema(schemas.DETECTION).option("multiLine", True).option("pathGlobFilter", "*.blw").json(path))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: name, text and the bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(base_name(F.col("path")).alias("name"), F.decode("content", "UTF-8").alias("text"), "content")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, width, height) of images, decoded by Spark's image source."""
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    return images.select(base_name(F.col("image.origin")).alias("name"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def timings(lines: DataFrame, col: str = "value", order: str | None = None) -> DataFrame:
    """(ptr, provider, millis) from log lines ptr.provider.json:millis; a line of another form is an error.

    The last line of a page and provider counts; ``order`` names the column that tells lines' order, without
    which the order in the file does.
    """
    one = r"^([^.:]*)\.([^.:]*)\.[^.:]*:([+-]?[0-9]+)$"
    line = F.col(col)
    checked = F.when(line.rlike(one), line).otherwise(F.raise_error(F.concat(F.lit("not a timing: "), line)))
    place = F.col(order) if order else F.monotonically_increasing_id()
    rows = lines.select(checked.alias("line"), place.alias("place"))
    part = lambda i: F.regexp_extract("line", one, i)
    rows = rows.select(part(1).alias("ptr"), part(2).alias("provider"), part(3).cast("long").alias("millis"), "place")
    return rows.groupBy("ptr", "provider").agg(F.max_by("millis", "place").alias("millis"))


def matrix(lines: DataFrame, col: str = "value") -> DataFrame:
    """(label, place, value) from rows label,v1,v2,...; rows may differ in length."""
    cells = F.split(F.col(col), ",")
    rows = lines.select(F.get(cells, F.lit(0)).alias("label"), F.posexplode(F.slice(cells, F.lit(2), F.size(cells))).alias("place", "value"))
    return rows.select("label", "place", "value")


def matrix_tiles(spark: SparkSession, path: str, columns: int = 1_000) -> DataFrame:
    """(label, place, value) of the matrix whose tiles ``sinks.matrix_tiles`` has written; places count over all tiles, empty
    cells are left out."""
    lines = spark.read.schema("value string, tile bigint").text(path)
    cells = F.split("value", ",")
    rows = lines.select("tile", F.get(cells, F.lit(0)).alias("label"), F.posexplode(F.slice(cells, F.lit(2), F.size(cells))).alias("column", "value"))
    return rows.where("value <> ''").select("label", (F.col("tile") * columns + F.col("column")).alias("place"), "value")


def edit_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, dist) from CSV; empty fields are empty texts."""
    rows = spark.read.schema("a string, b string, dist int").option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return rows.na.fill("", ["a", "b"])


def word_list(spark: SparkSession, path: str | None) -> DataFrame:
    """(word): one a line; without a path, none."""
    return spark.read.text(path).select(F.col("value").alias("word")).distinct() if path else spark.createDataFrame([], "word string")


def shelf_ids(pages: DataFrame, col: str = "json") -> DataFrame:
    """(shelf_id) of search answers kept as JSON text; an answer that has a next page is an error. the
    patterns of the stored format."""
    whole = F.when(F.contains(F.col(col), F.lit('"next": null,')), F.col(col)).otherwise(F.raise_error(F.lit("more results than one answer holds")))
    return pages.select(F.explode(F.regexp_extract_all(whole, F.lit('"shelf_id": "([A-Za-z0-9]*)",'), F.lit(1))).alias("shelf_id"))


def middle_extension(files: DataFrame, group: str, name: str) -> DataFrame:
    """(group, extension) of the middle one of each group's names in order."""
    line = Window.partitionBy(group).orderBy(name)
    rows = files.withColumns({"_at": F.row_number().over(line), "_n": F.count("*").over(Window.partitionBy(group))})
    rows = rows.where(F.col("_at") == F.expr("_n div 2 + 1"))
    return rows.select(group, F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"))
