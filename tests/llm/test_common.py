from collections import Counter

from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, dealt, undealt


def test_equal_rows_are_dealt_in_pieces(spark):
    rows = [(None, None)] * 50 + [(1, "a")] * 10 + [(1, None)] * 4 + [(2, "b")] * 3 + [(None, "b")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = dealt(docs, ["id", "text"], Scratch(spark), most=3, piece=4)
    pieces = Counter((r.id, r.text, r.piece, r.copies) for r in got.collect())
    assert pieces == Counter([(None, None, p, 4 if p < 12 else 2) for p in range(13)] + [(1, "a", 0, 4), (1, "a", 1, 4), (1, "a", 2, 2), (1, None, 0, 4)] + [(2, "b", 0, 1)] * 3 + [(None, "b", 0, 1)])
    assert Counter(tuple(r) for r in undealt(got).drop("piece").collect()) == Counter(rows)


def test_few_equal_rows_stay(spark):
    docs = spark.createDataFrame([(1, "a")] * 3, "id long, text string")
    got = dealt(docs, ["id", "text"], Scratch(spark), most=3)
    assert [tuple(r) for r in got.collect()] == [(1, "a", 0, 1)] * 3
    assert dealt(docs.limit(0), ["id"], Scratch(spark)).where(F.col("copies") > 0).count() == 0
