"""Files of pages: all there or none."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from inkspan.sources import page_files


def files(path):
    return sorted(os.path.basename(f) for f in glob.glob(f"{path}/**/*.txt", recursive=True))


def test_round_trip(spark, tmp_path):
    uri = f"file://{tmp_path}/pages"
    rows = [(f"p-{i}", None if i == 3 else f"text {i}\nü\r\n" * (i % 4)) for i in range(50)]
    df = spark.createDataFrame(rows, "name string, text string").withColumn("other", F.lit(1)).repartition(4)
    page_files.write(df, uri)
    back = page_files.read(spark, uri)
    assert sorted(map(tuple, back.collect())) == sorted((n, t or "") for n, t in rows)
    assert back.rdd.getNumPartitions() == 4 and files(tmp_path) == sorted(f"{n}.txt" for n, _ in rows)
    page_files.write(df.limit(2).withColumn("name", F.concat(F.lit("new-"), "name")), uri)
    assert page_files.read(spark, uri).count() == 52
    page_files.write(df.limit(7), uri, mode="overwrite")
    assert page_files.read(spark, uri).count() == 7 and len(files(tmp_path)) == 7


def test_failing_task_leaves_nothing(spark, tmp_path):
    uri = f"file://{tmp_path}/pages"
    good = spark.createDataFrame([("kept", "x")], "name string, text string")
    page_files.write(good, uri)
    # all tasks but the last have written their files when it fails
    late = spark.range(0, 40, numPartitions=4).select(F.when(F.col("id") == 39, F.lit("a/b")).otherwise(F.concat(F.lit("n"), "id")).alias("name"), F.lit("t").alias("text"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="not a name"):
            page_files.write(late, uri, mode)
        assert [tuple(r) for r in page_files.read(spark, uri).collect()] == [("kept", "x")]
    page_files.clean(uri)  # a process that was killed may have left something
    assert files(tmp_path) == ["kept.txt"] and len(glob.glob(f"{tmp_path}/pages/_done/*")) == 1


def test_task_that_ends_after_the_failure(tmp_path):
    """Whichever comes first, the task's last file or the removal, nothing is left."""
    row = {"name": "a", "text": "b"}
    writer = page_files.Writer(f"file://{tmp_path}/p", False)
    writer.write(iter([row]))
    writer.abort([])
    assert files(tmp_path) == []
    writer.write(iter([row]))
    assert files(tmp_path) == []


def test_unlisted_folders_are_not_read(spark, tmp_path):
    """What an attempt that was lost has left is on no list."""
    uri = f"file://{tmp_path}/pages"
    page_files.write(spark.createDataFrame([("a", "1")], "name string, text string"), uri)
    os.makedirs(tmp_path / "pages" / "job" / "attempt")
    (tmp_path / "pages" / "job" / "attempt" / "b.txt").write_text("2")
    assert [r.name for r in page_files.read(spark, uri).collect()] == ["a"]
    assert page_files.clean(uri) == 1 and files(tmp_path) == ["a.txt"]


def test_nothing(spark, tmp_path):
    uri = f"file://{tmp_path}/none"
    assert page_files.read(spark, uri).collect() == []
    page_files.write(spark.createDataFrame([], "name string, text string"), uri)
    assert page_files.read(spark, uri).collect() == []
