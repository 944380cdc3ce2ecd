"""Writers. Files are written by the tasks, a folder for each provider; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results(answers: DataFrame, path: str, mode: str = "append") -> None:
    """Answers as JSON lines by provider; ``raw`` is written as base64."""
    answers.write.mode(mode).partitionBy("provider").option("ignoreNullFields", False).json(path)


def detections(trees: DataFrame, path: str, mode: str = "append") -> None:
    """Trees as JSON lines by provider, empty lists kept."""
    trees.write.mode(mode).partitionBy("provider").option("ignoreNullFields", False).json(path)


def detection_json(algo: str = "algo", date: str = "date", millis: str = "millis", blocks: str = "blocks"):
    """A tree's JSON as one column."""
    return F.to_json(F.struct(F.col(algo).alias("algo"), F.col(date).alias("date"), F.col(millis).alias("millis"), F.col(blocks).alias("blocks")), {"ignoreNullFields": "false"})


def page_texts(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Page texts by provider, as JSON lines of ptr and txt (a text may hold line feeds)."""
    pages.select("provider", "ptr", "txt").write.mode(mode).partitionBy("provider").json(path)


def page_files(pages: DataFrame, uri: str) -> None:
    """One file, <name>.txt, for each row of (name, text), written by the tasks under a URI that pyarrow's file systems
    know (file, hdfs, s3, gs); a task that is run again writes the same files. All in one folder, so a job that fails leaves
    what it has written; ``sources.page_files`` writes all or nothing."""

    def write(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for row in rows:
            with store.open_output_stream(f"{base}/{row['name']}.txt") as out:
                out.write((row["text"] or "").encode())

    pages.select("name", "text").foreachPartition(write)


def matrix(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Metric matrices (doc, place, line) as text, a folder for each document, lines in order."""
    rows.repartition("doc").sortWithinPartitions("doc", "place").select("doc", "line").write.mode(mode).partitionBy("doc").text(path)


def matrix_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tiles of a matrix (``compare.tiles``) as text, a folder for each tile, lines in order."""
    tiles.repartition("tile").sortWithinPartitions("tile", "place").select("tile", "line").write.mode(mode).partitionBy("tile").text(path)


def config_lines(title: str, formats: str, folders: list[str], limits: list[str]) -> list[str]:
    """The explorer's configuration, a few lines whatever the corpus' size. A stored format."""
    return [f"title,{title} Explorer", f"imgs-fmt,{formats}", "txts-dirs," + ",".join(folders), "[]links,Data;data/", "[]range,CER;0;1", *limits]
