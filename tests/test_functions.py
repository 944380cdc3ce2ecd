"""Scalar functions against fixed vectors, brute force and properties."""

import pytest
from pyspark.sql import functions as F

from inkspan.functions import geometry, render, sql, text
from inkspan.streaming import ingest

#: Edit distances that must come out in both directions.
VECTORS = [("", "", 0), ("a", "a", 0), ("ab", "abc", 1), ("potatoe", "tomatoe", 2), ("bonanza", "gonzaga", 4), ("alfalfa", "allfalf", 2), ("1234567", "ABCDEFG", 7), ("wrong", "bad", 5), ("one", "", 3), ("", "three", 5), ("hamlet", "omelet", 3)]
#: l0, r0, l1, r1, whether they meet, shared length.
INTERVALS = [(0, 0, 0, 0, True, 0), (-10, 10, 0, 0, True, 0), (-10, 10, 100, 100, False, 0), (0, 10, 0, 10, True, 10), (0, 10, 1, 9, True, 8), (1, 9, 0, 10, True, 8), (0, 10, -1, 1, True, 1), (0, 10, 9, 11, True, 1), (0, 10, -2, -1, False, 0), (0, 10, 11, 12, False, 0)]


def brute(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_levenshtein_vectors_and_bytes(spark):
    rows = [(a, b, d) for a, b, d in VECTORS] + [(b, a, d) for a, b, d in VECTORS] + [("é", "e", 2), ("straße", "strasse", 2)]
    rows += [(x, y, brute(x.encode(), y.encode())) for x, y in (("a" * 300 + "é", "b" * 40 + "a" * 280), ("abc" * 200, "acb" * 190), ("x" * 400, "y" * 390))]
    df = spark.createDataFrame(rows, "a string, b string, d int")
    got = df.select("d", text.byte_levenshtein(F.col("a"), F.col("b")).alias("got"), text.byte_levenshtein_within(F.col("a"), F.col("b"), 3).alias("near")).collect()
    assert all(r.got == r.d and r.near == (r.d if r.d <= 3 else -1) for r in got)


def test_error_rates(spark):
    df = spark.createDataFrame([(0, "", 0.0), (0, "abc", 0.0), (5, "", 1.0), (3, "é", 1.5)], "d int, t string, want double")
    assert all(r.got == r.want for r in df.select("want", text.cer(F.col("d"), F.col("t")).alias("got")).collect())


def test_intervals_and_boxes(spark):
    df = spark.createDataFrame(INTERVALS, "l0 int, r0 int, l1 int, r1 int, meets boolean, shared int")
    c = [F.col(x) for x in ("l0", "r0", "l1", "r1")]
    for r in df.select("meets", "shared", geometry.interval_meets(*c).alias("m"), geometry.interval_overlap(*c).alias("s")).collect():
        assert (r.m, r.s) == (r.meets, r.shared)
    boxes = [((0, 10, 4, 14), (5, 15, 9, 19), False), ((0, 0, 3, 3), (1, 1, 4, 4), True), ((2, 2, 8, 8), (0, 0, 10, 10), True), ((0, 10, 3, 14), (1, 15, 4, 19), False)]
    for a, b, want in boxes:
        one = geometry.box_meets(tuple(map(F.lit, a)), tuple(map(F.lit, b))), geometry.box_meets(tuple(map(F.lit, b)), tuple(map(F.lit, a)))
        assert spark.range(1).select(one[0].alias("x"), one[1].alias("y")).first() == (want, want)


@pytest.mark.parametrize("bad", ["1,2,3", "1,2,3,4,5", "1, 2,3,4", "a,b,c,d", "", "1,2,3,99999999999999999999"])
def test_bounds(spark, bad):
    df = spark.createDataFrame([(bad,), ("-1,+2,3,4",)], "s string")
    got = [r.b for r in df.select(geometry.parse_bounds(F.col("s"), strict=False).alias("b")).collect()]
    assert got[0] is None and tuple(got[1]) == (-1, 2, 3, 4)
    with pytest.raises(Exception, match="bounds are not"):
        df.select(geometry.parse_bounds(F.col("s"))).collect()


def test_names(spark):
    row = spark.range(1).select(
        text.sanitized(F.lit("Aé😀-9 z")), text.algorithm_id(F.lit("AzureRead"), F.lit("3.1")), text.algorithm_id(F.lit("Azure"), F.lit("v1")), text.without_suffix(F.lit("page-uz.azu"), "azu", legacy=True), text.without_suffix(F.lit("page-uz.azu"), "azu"),
        text.word_count(F.lit(" a\u0085b c\td ")), text.page_pointer(F.lit("f"), F.lit(3), F.lit(101)), text.page_pointer(F.lit("f"), F.lit(0), F.lit(1)), F.sort_array(text.spelling_words(F.lit("ſo, so é12 12 a-b"))), text.colour_of(F.lit("x-AWS-azu")), text.unsigned32(F.lit(5_000_000_000)),
    ).first()
    assert list(row) == ["a__-9_z", "azureread-3_1", "azu-v1", "page-", "page-uz", 4, "f-003", "f-0", ["a", "b", "so"], "orange", 705032704]


def test_rendering(spark):
    df = spark.createDataFrame([(0, "0"), (1005, "1"), (1500, "1.5"), (12340, "12.34"), (None, None)], "ms int, want string")
    assert all(r.got == r.want for r in df.select("want", render.seconds_text("ms").alias("got")).collect())
    assert spark.range(1).select(render.fixed(F.lit(0.125), 2)).first()[0] == "0.12"
    assert render.limits_text("Seconds", 0.5, 11.6, "seconds") == "Seconds;0.50;12"


def test_font_size(spark):
    df = spark.createDataFrame([(w, n) for w in range(1, 120) for n in range(1, 9)], "w long, n int").withColumn("s", F.repeat(F.lit("x"), F.col("n")))
    for r in df.select("w", "n", geometry.font_size(F.col("s"), F.col("w")).alias("size")).collect():
        assert 6 * r.n * r.size >= 10 * r.w > 6 * r.n * (r.size - 1)


def test_sql_names(spark):
    sql.register(spark)
    assert spark.sql("SELECT byte_levenshtein('é', 'e'), cer(2, 'ab'), sanitized('A b'), interval_overlap(0, 10, 9, 11)").first() == (2, 1.0, "a_b", 1)


def test_dates_and_names(spark):
    df = spark.createDataFrame([("/a/b/p-0.aws.json",), ("plain",)], "n string")
    assert [r[0] for r in df.select(text.base_name(F.col("n"))).collect()] == ["p-0.aws.json", "plain"]
    row = spark.range(1).select(F.lit("2020-01-02 03:04:05").cast("timestamp").alias("a"), F.lit("2020-01-02 03:04:06.25").cast("timestamp").alias("b"))
    assert tuple(row.select(text.utc_text(F.col("a")), text.elapsed_millis(F.col("a"), F.col("b"))).first()) == ("2020-01-02 03:04:05 UTC", 1250)


def test_running_passes(spark, tmp_path):
    rows = [("azu", "2020-01-01 00:00:10"), ("azu", "2020-01-01 00:00:50"), ("aws", "2020-01-01 00:01:10")]
    spark.createDataFrame(rows, "provider string, at string").select("provider", F.col("at").cast("timestamp").alias("arrived")).write.parquet(f"{tmp_path}/in")
    stream = ingest.running_passes(spark.readStream.schema("provider string, arrived timestamp").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("passes").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.provider, r.passed) for r in spark.table("passes").collect()) == [("aws", 1), ("azu", 2)]
