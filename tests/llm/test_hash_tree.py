import collections
import zlib

import pytest
from pyspark.sql import functions as F

from inkspan.llm import hash_tree as ht


def test_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ht.shards(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(abs(len(x) - 125) < 50 for x in slots.values())
    assert 60 < sum(r.grown_shard == 8 for r in rows) < 170


def test_weights_and_movement(spark):
    """Rows follow weights; a changed weight moves rows only into or out of subtrees that hold it."""
    before = ht.topology(8)
    after = [ht.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in before]
    keys = spark.range(40_000)
    both = ht.with_shard(ht.with_shard(keys, F.col("id"), before, "a"), F.col("id"), after, "b")
    moves = {(r.a, r.b): r.n for r in both.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    share = sum(n for (_, b), n in moves.items() if b == 5) / 40_000
    assert abs(share - 0.3) < 0.02
    assert all(a == b or b // 4 == 1 for a, b in moves)  # shards 0-3: a region whose weight stays; nothing enters
    assert all(a == b or b // 2 == 2 for a, b in moves if a // 4 == 1)  # inside the region only rack 2 gains


def test_edges(spark):
    rows = [(None, None, 1), (None, None, 1), (1, "", 2), (1, "é", 2), (1, "é", 2), (2, "x" * 300_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = ht.shards(docs, n_shards=2).collect()
    assert len(out) == 6
    assert len({r.shard for r in out if r.doc_id == 1}) == 1
    for s in {r.shard for r in out}:
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))
    assert ht.shards(docs.limit(0)).collect() == []


def test_many_equal_rows(spark, monkeypatch):
    """A third of all rows are one row, another third one text: slots stay gapless and the same whatever the ranges are."""
    rows = [(5, "same")] * 400 + [(i, "copy") for i in range(400)] + [(i, f"t{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for size in (3, 100_000):
        monkeypatch.setattr(ht, "RANGE_ROWS", size)
        seen.append(sorted(map(tuple, ht.shards(docs.repartition(4)).collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 1200
    slots = collections.defaultdict(list)
    for r in seen[0]:
        slots[r[4]].append(r[5])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_no_column_is_lost(spark):
    docs = spark.createDataFrame([(i, "r", "k") for i in range(20)], "doc_id long, _shard_region string, _shard_rack string")
    out = ht.with_shard(docs, F.col("doc_id"), ht.topology(8), "shard")
    assert out.columns == [*docs.columns, "shard"] and {(r[1], r[2]) for r in out.collect()} == {("r", "k")}
    with pytest.raises(ValueError):
        ht.with_shard(out, F.col("doc_id"), ht.topology(8), "SHARD")
