"""Answers as they arrive: a folder of JSON, converted and appended. Converters are narrow, so the stream keeps
no state and needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkspan.operators import faults
from inkspan.operators.convert import to_detections
from inkspan.operators.layout import plain_text
from inkspan.sources import schemas


def answers(spark: SparkSession, path: str, files_at_once: int = 1_000) -> DataFrame:
    """The stream of ptr, provider and the envelope of a folder of JSON lines."""
    return spark.readStream.schema("ptr string, provider string, " + schemas.RESULT).option("maxFilesPerTrigger", files_at_once).json(path)


def page_texts(stream: DataFrame, strict: bool = True) -> DataFrame:
    """ptr, provider, txt and millis of each answer; if not strict, of each that has no faults."""
    trees = to_detections(stream) if strict else faults.good(faults.to_detections(stream))
    return trees.select("ptr", "provider", plain_text(F.col("blocks")).alias("txt"), "millis")


def quarantined(stream: DataFrame) -> DataFrame:
    """Each answer's tree or faults, and ``faulty``, for ``ingest`` with parts=["faulty"] and ``faults.read``."""
    found = faults.to_detections(stream)
    return found.withColumn("faulty", F.size("faults") > 0)


def ingest(stream: DataFrame, path: str, checkpoint: str, once: bool = False, parts: list[str] | None = None) -> StreamingQuery:
    """Appends converted answers as Parquet, in folders by ``parts``; once: what is there now, then it ends."""
    writer = stream.writeStream.partitionBy(*(parts or [])).format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_passes(stream: DataFrame, delay: str = "10 minutes", arrived: str = "arrived") -> DataFrame:
    """(window, provider, passed): pages that came in by minute, for streams with the time of arrival."""
    return stream.withWatermark(arrived, delay).groupBy(F.window(arrived, "1 minute"), "provider").agg(F.count("*").alias("passed"))
