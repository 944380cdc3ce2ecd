"""The whole pipeline against each stage's brute force, and the registry's contract."""

import collections
import hashlib
import math
import re

import duckdb
import test_decontamination
import test_mixing
import test_ngram_jaccard

import corpus_pipeline
from inkspan.llm import hash_tree, oracles

DIR = "/root/testdata/sf0.001"


def draw(key, path, weight):
    bits = int(hashlib.md5(f"{key}/{path}".encode()).hexdigest()[:12], 16)
    return -math.log((bits + 0.5) / 2**48) / weight


def shard(doc, leaves):
    key = "null" if doc is None else f"k{doc}"
    at: tuple = ()
    for level in ("region", "rack", "shard"):
        below = collections.defaultdict(float)
        for x in leaves:
            path = (x.region, x.rack, x.shard)
            if path[: len(at)] == at:
                below[path[: len(at) + 1]] += x.weight
        at = min(sorted(below), key=lambda p: draw(key, "/".join(map(str, p)), below[p]) if len(below) > 1 else 0)
        assert level
    return at[2]


def test_stages(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.OP9}) WHERE kept").fetchall()}
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r.doc_id in kept]
    near = {d: c for d, _, c in test_ngram_jaccard.brute([(d, t) for d, t, _ in docs], 5, 80)}
    docs = [x for x in docs if near[x[0]] == x[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {r[0] for r in test_decontamination.brute([(d, t) for d, t, _ in docs], items)}
    docs = [x for x in docs if x[0] not in leaks]
    size = {d: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t, _ in docs}
    sources = collections.Counter()
    for d, _, s in docs:
        sources[s] += size[d]
    goal = test_mixing.goals(sources, (1, 2, 3), 3)
    want = collections.Counter()
    for s, total in sources.items():
        budget = math.floor(goal[s] + 0.5)
        epochs, left = divmod(budget, total)
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        mine = [(int(md5(f"mix/{d}/{md5(t)}/0{x}")[:12], 16), d) for d, t, x in docs if x == s]
        for _, d in sorted(mine):
            want[d, shard(d, hash_tree.topology(8))] += epochs + (left > 0 and size[d] > 0)
            left -= size[d]
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == [*spark.read.parquet(f"{DIR}/documents.parquet").columns, "shard"]
    assert collections.Counter((r.doc_id, r.shard) for r in got.collect()) == +want


def test_shards_of_any_key():
    tree = hash_tree.topology(9, full=8)
    assert {x.region for x in tree} == {0, 1, 2}
    assert collections.Counter(shard(i, tree) for i in range(4000)).keys() == set(range(9))


def test_registry():
    from inkspan.llm import registry

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES] == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_edges(spark):
    """Null and repeated ids, null columns, repeated rows, clashing names and an empty table through all stages."""
    good = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(7)]
    rows = [(None, good[0], "en", "a"), (None, good[0], "en", "a"), (None, good[1], None, None), (1, good[2], "en", "a"), (1, good[3], "en", None), (2, good[2], "en", "b"), (3, None, None, "a"), (4, "", "en", "a"), (5, good[4], "en", "b"), (5, good[4], "en", "b"), (6, " ".join(f"z{i}" for i in range(60_000)), "en", "a"), (7, good[5], "de", "")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int, _shard_region string, k0 int, n int")
    columns = docs.columns
    want = [{t for t in good[:6]} | {rows[10][1]}] * 4
    for (_, stage), texts in zip(corpus_pipeline.STAGES[:4], want, strict=True):
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r.text for r in docs.collect()} <= texts
    got = corpus_pipeline.STAGES[4][1](spark, docs, DIR)
    assert got.columns == [*columns, "_shard"]
    assert all(r.shard == 1 and 0 <= r["_shard"] < 8 for r in got.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).collect() == []


def test_one_of_each_group(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(4)]
    rows = [(None, good[0]), (None, good[0]), (1, good[1]), (1, good[1]), (1, good[2]), (2, good[2]), (3, good[1] + " end"), (None, good[3]), (4, good[3]), (5, ""), (5, None)]
    docs = spark.createDataFrame([(*r, "en", "s", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    left = corpus_pipeline.near_copies(spark, docs, DIR).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, [(None, good[0]), (1, good[1]), (1, good[2]), (4, good[3]), (5, ""), (5, None)]))
