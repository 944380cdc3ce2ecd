import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkspan.llm import merkle
from inkspan.llm.registry import op12_merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes):
    """All levels of a tree, from its leaves to its one top."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    """(place, others) at each level but the top."""
    out = []
    for level in tree[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((i % 16, "".join(run[: i % 16] + run[i % 16 + 1 :])))
        i //= 16
    return out


def fold(node, way):
    for place, others in way:
        node = sha(others[: 64 * place] + node + others[64 * place :])
    return node


def brute(rows, tamper):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text), from whole trees."""
    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            way = path(trees[s], i) + path(top, k)
            shown = leaf(tamper(r))
            got = fold(shown, way)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(o for _, o in way)), got, got == top[-1][0]))
    return sorted(out, key=repr)


def lowered(r):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0
    return (*r[:4], r[4].translate(low) if hit and r[4] is not None else r[4])


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_traversal(n):
    """The paths of a block, one after another, are those of the whole tree, and no more than two runs a level are held."""
    nodes = [sha(str(i)) for i in range(n)]
    tree = levels(nodes)
    got = list(merkle.paths([x.encode() for x in nodes], merkle.depth(n)))
    assert merkle.depth(n) == len(tree) - 1
    assert [[(p, o.decode()) for p, o in way] for way in got] == [path(tree, i) for i in range(n)]


def test_last_block_of_more():
    """A block that is not its tree's only one has all levels, however few leaves it has."""
    nodes = [sha(str(i)).encode() for i in range(3)]
    (first, *_) = merkle.paths(nodes, 3)
    assert [p for p, _ in first] == [0, 0, 0] and [len(o) for _, o in first] == [128, 0, 0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def manifest(docs, levels=3):
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    shown = merkle.leaf(*(F.col(c) for c in FIELDS[:-1]), F.when(hit, text).otherwise(F.col("text")))
    return merkle.manifest(docs, FIELDS, shown, levels=levels)


def seen(df):
    rows = df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted([tuple(r) for r in rows], key=repr)


def test_edges(spark):
    pick = random.Random(1)
    rows = [(pick.choice([None, *range(400)]), pick.choice([None, "", "b", "É", "𝄞"]), pick.choice([None, "", "en"]), pick.choice([None, 0, -7]), pick.choice([None, "", "UPPER", "lower", "Ünï"])) for _ in range(900)]
    rows += [rows[0]] * 40
    docs = frame(spark, rows).withColumn("src", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    assert seen(manifest(docs)) == brute(rows, lowered)
    one = [(5, "s", None, None, "Text")]
    assert seen(manifest(frame(spark, one))) == brute(one, lowered)
    assert seen(manifest(frame(spark, one).limit(0))) == []


def test_blocks_of_blocks(spark, monkeypatch):
    """Trees of more blocks than one, in three stages; a hot source, a third of whose rows are one row."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 700)
    rows = [(i, f"s{i % 23}" if i % 3 else "hot", "en", i, f"T{i}") for i in range(5000)] + [(7, "hot", "en", 1, "Same")] * 700
    assert seen(manifest(frame(spark, rows).repartition(7), levels=1)) == brute(rows, lowered)


def test_large_source(spark):
    """More than a block's leaves in one source."""
    rows = [(i, "one", None, i, f"Text {i}") for i in range(9000)] + [(1, "two", None, 1, "x")]
    assert seen(manifest(frame(spark, rows))) == brute(rows, lowered)


def test_query_and_proofs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in table.select(FIELDS).collect()]
    got = op12_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert seen(got) == brute(rows, lowered)
    full = merkle.manifest(table, FIELDS, with_proof=True).withColumn("again", merkle.checked(F.col("leaf"), F.col("places"), F.col("others")))
    bad = full.where((F.col("again") != F.col("root")) | ~F.col("verified") | (F.sha2(F.array_join("others", "").cast("binary"), 256) != F.col("proof_sha256")))
    assert bad.count() == 0
