"""A text file for each page, as a data source whose writes are all there or not there at all.

Each task writes into a folder of its own below the job's; when all tasks have ended, the job's list of folders is
written, and readers go by these lists. Folders of attempts that failed or ran twice are on no list, and a job that
fails removes what it wrote; a task that ends later finds the mark of the failure and removes its own. ``clean``
takes away what killed processes have left. Nothing is renamed, so stores without cheap renames do. Folders are read a partition
each; only their names and numbers of files pass through the driver.

Files lie under a URI that pyarrow's file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "page_files"
#: Where a folder's lists of finished jobs are.
DONE = "_done"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


@dataclass
class Folder(InputPartition):
    folder: str


def _file_name(name: str | None) -> str:
    if not name or "/" in name or name in (".", "..") or name.startswith("_"):
        raise ValueError(f"not a name for a page's file: {name}")
    return f"{name}.txt"


class Writer(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = fs.FileSystem.from_uri(self.uri)
        folder, n = f"{self.job}/{uuid.uuid4().hex}", 0
        for row in iterator:
            if not n:
                store.create_dir(f"{base}/{folder}")
            with store.open_output_stream(f"{base}/{folder}/{_file_name(row['name'])}") as out:
                out.write((row["text"] or "").encode())
            n += 1
        if n and store.get_file_info(f"{base}/{DONE}/{self.job}.failed").type == fs.FileType.File:
            store.delete_dir(f"{base}/{folder}")
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.uri)
        before = [f.path for f in _lists(store, base)]
        listed = {m.folder: m.files for m in messages if m and m.files}
        store.create_dir(f"{base}/{DONE}")
        with store.open_output_stream(f"{base}/{DONE}/{self.job}.json") as out:
            out.write(json.dumps(listed).encode())
        if self.overwrite:  # the new list is there; the old ones and their folders go
            for path in before:
                store.delete_file(path)
                job = f"{base}/{path.rpartition('/')[2].removesuffix('.json')}"
                if store.get_file_info(job).type == fs.FileType.Directory:
                    store.delete_dir(job)
        # what other attempts have left
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(f"{base}/{self.job}")):
                if f"{self.job}/{f.base_name}" not in listed:
                    store.delete_dir(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.uri)
        store.create_dir(f"{base}/{DONE}")
        store.open_output_stream(f"{base}/{DONE}/{self.job}.failed").close()
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


def clean(uri: str) -> int:
    """Removes the folders of jobs that are on no list, and says how many; for times when no job writes."""
    store, base = fs.FileSystem.from_uri(uri)
    jobs = {f.base_name.removesuffix(".json") for f in _lists(store, base)}
    left = [f for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name not in (*jobs, DONE)]
    for f in left:
        store.delete_dir(f.path)
    for f in store.get_file_info(fs.FileSelector(f"{base}/{DONE}", allow_not_found=True)):
        if f.base_name.endswith(".failed"):
            store.delete_file(f.path)
    return len(left)


def _lists(store: fs.FileSystem, base: str) -> list[fs.FileInfo]:
    return [f for f in store.get_file_info(fs.FileSelector(f"{base}/{DONE}", allow_not_found=True)) if f.base_name.endswith(".json")]


class Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Folder]:
        store, base = fs.FileSystem.from_uri(self.uri)
        out = []
        for f in sorted(_lists(store, base), key=lambda f: f.path):
            with store.open_input_stream(f.path) as list_:
                out += [Folder(x) for x in json.loads(list_.read())]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not isinstance(partition, Folder):  # no folders: Spark asks once for nothing
            return
        store, base = fs.FileSystem.from_uri(self.uri)
        for f in store.get_file_info(fs.FileSelector(f"{base}/{partition.folder}")):
            with store.open_input_stream(f.path) as text:
                yield f.base_name.removesuffix(".txt"), text.read().decode()


class PageFiles(DataSource):
    """Rows of name and text; the option ``path`` is the folder's URI."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def write(pages: DataFrame, uri: str, mode: str = "append") -> None:
    """A file <name>.txt for each row of (name, text): all of them, or after an error none."""
    pages.sparkSession.dataSource.register(PageFiles)
    pages.select("name", "text").write.format(NAME).mode(mode).option("path", uri).save()


def read(spark: SparkSession, uri: str) -> DataFrame:
    """(name, text) of the files that finished jobs have written."""
    spark.dataSource.register(PageFiles)
    return spark.read.format(NAME).option("path", uri).load()
