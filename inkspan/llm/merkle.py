"""Merkle manifest of a dataset: one root over all documents, and a proof for each of them.

A leaf is the digest of a document's fields. Leaves of a source, in the order of their ids, are hashed in runs of
``ARITY`` until one node, the source's subroot, remains; subroots, in the order of the sources, likewise give
the root. A proof is what each run on the way up holds besides the node itself.

Positions come from a range sort and prefix sums over the ranges, so no source is numbered in one task. Leaves are
dealt into aligned blocks, which are whole subtrees of ``levels`` levels (of ``LEVELS``: 4,096 leaves). Inside a block the paths come
from a fractal traversal: of each level it holds the existing run, on the current leaf's path, and the desired
one, which is hashed up by one leaf a step and is whole when the existing run is used up; so it keeps two runs a
level and no tree. Blocks' nodes are the leaves of the next tree, which goes the same way, and so on until
a source has one node: each block gets its proof above from that table, and appends it to what it emits.

Defined cases: null fields are ``-``; a null source is a source of its own, the first; null ids come first; equal ids
go by leaf; rows that repeat each have a leaf (they are put together with a count before rows are dealt out and
spread again inside blocks); an empty table has no root and gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, small_enough

ARITY = 16
#: Levels of a block.
LEVELS = 3
#: Rows in a key range, about, and entries of the table of ranges that may be broadcast (some 50 bytes each).
RANGE_ROWS, BROADCAST_ROWS = 100_000, 200_000
#: Hex digits of a digest.
WIDTH = 64


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, as hex digits: of each ``-`` if it is null, else its bytes' number, ``:`` and itself."""
    text = [c.cast("string") for c in fields]
    each = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def parent(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


class Run:
    """The run of a level's nodes that starts above the leaf ``first``, hashed up from its leaves one at a time."""

    def __init__(self, leaves: list[bytes], first: int, level: int):
        self.leaves, self.at, self.level = leaves, first, level
        self.stop = min(len(leaves), first + ARITY ** (level + 1))
        self.open: list[list[bytes]] = [[] for _ in range(level + 1)]  # of each level the nodes without a parent yet

    def step(self) -> None:
        """Takes in one more leaf, if there is one; the last one closes runs that aren't full."""
        if self.at >= self.stop:
            return
        self.open[0].append(self.leaves[self.at])
        self.at += 1
        for k in range(self.level):
            if len(self.open[k]) == ARITY or (self.at == self.stop and self.open[k]):
                self.open[k + 1].append(parent(self.open[k]))
                self.open[k] = []

    def whole(self) -> list[bytes]:
        while self.at < self.stop:
            self.step()
        return self.open[self.level]


def paths(leaves: list[bytes], levels: int) -> Iterator[list[tuple[int, bytes]]]:
    """For each leaf in turn, level by level: its node's place in the run, and the others of the run."""
    existing = [Run(leaves, 0, k).whole() for k in range(levels)]
    desired = [Run(leaves, ARITY ** (k + 1), k) for k in range(levels - 1)]
    for i in range(len(leaves)):
        path = []
        for k, run in enumerate(existing):
            place = i // ARITY**k % ARITY
            path.append((place, b"".join(run[:place] + run[place + 1 :])))
        yield path
        for k, run in enumerate(desired):
            run.step()
            if (i + 1) % ARITY ** (k + 1) == 0:
                existing[k] = run.whole()
                desired[k] = Run(leaves, i + 1 + ARITY ** (k + 1), k)


def fold(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """What is at the upper end of a path, seen from a node and the others of its runs."""
    for place, others in path:
        node = hashlib.sha256(others[: WIDTH * place] + node + others[WIDTH * place :]).hexdigest().encode()
    return node


def depth(total: int) -> int:
    """Levels above ``total`` leaves."""
    d = 0
    while ARITY**d < total:
        d += 1
    return d


def _digests(packed: bytes) -> list[bytes]:
    text = packed.hex().encode()
    return [text[i : i + WIDTH] for i in range(0, len(text), WIDTH)]


def _number(batches):
    """Sorted rows of a range with ``start``: how many leaves of their source the range has before them."""
    last, upto = None, 0
    for b in batches:
        src, n = b.column("src").to_pylist(), b.column("n").to_pylist()
        start = []
        for s, k in zip(src, n, strict=True):
            if s != last:
                last, upto = s, 0
            start.append(upto)
            upto += k
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start, pa.int64())], names=[*b.schema.names, "start"])


def _numbered(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Stored rows (src, id, digest, presented, n) with ``pos``, the leaves of the source before them, and ``total``, all its leaves."""
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    order = "src", "id", "digest", "presented"
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt.mapInArrow(_number, f"{kinds}, part int, start long"), f"{name}-dealt")
    sizes = dealt.groupBy("src", "part").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("src").orderBy("part")) - F.col("size")
    sizes = scratch.save(sizes.select("src", "part", before.alias("before"), F.sum("size").over(Window.partitionBy("src")).alias("total")), f"{name}-sizes")
    sizes = F.broadcast(sizes) if small_enough(sizes, BROADCAST_ROWS) else sizes
    return dealt.join(sizes, ["src", "part"]).withColumn("pos", F.col("before") + F.col("start")).drop("part", "start", "before")


def _pack(levels: int):
    """A block as one row, with the node above it."""

    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t.column("n").to_numpy()
        if n.max() > 1:
            t = t.take(np.repeat(np.arange(t.num_rows), n))
        column = lambda c: t.column(c).combine_chunks()
        digests = b"".join(column("digest").to_pylist())
        leaves, up = _digests(digests), min(levels, depth(t.column("total")[0].as_py()))
        node = parent(Run(leaves, 0, up - 1).whole()) if up else leaves[0]
        one = lambda c: t.column(c).slice(0, 1)
        ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), column("id"))
        presented = b"".join(column("presented").to_pylist())
        return pa.table({"src": one("src"), "block": one("block"), "total": one("total"), "node": pa.array([node.decode()]), "digests": pa.array([digests], pa.binary()), "presented": pa.array([presented], pa.binary()), "ids": ids})

    return make


def _blocks(rows: DataFrame, levels: int) -> DataFrame:
    """(src, block, total, node, digests, presented, ids): a row for each block, from (src, id, digest, presented, n, pos, total)."""
    kind, size = rows.schema["id"].dataType.simpleString(), ARITY**levels
    span = F.sequence(F.expr(f"pos div {size}"), F.expr(f"(pos + n - 1) div {size}"))
    rows = rows.withColumn("block", F.explode(span))
    first = F.greatest("pos", F.col("block") * size)
    rows = rows.withColumn("n", F.least(F.col("pos") + F.col("n"), (F.col("block") + 1) * size) - first).withColumn("pos", first)
    return rows.groupBy("src", "block").applyInArrow(_pack(levels), f"src string, block long, total long, node string, digests binary, presented binary, ids array<{kind}>")


def _path_above(above: pa.Table) -> list[tuple[int, bytes]]:
    return [(place, others.encode()) for place, others in zip(above.column("places")[0].as_py(), above.column("others")[0].as_py(), strict=True)]


def _proofs_below(levels: int, id_name: str):
    """The proofs of a block's members, which are nodes with trees below them."""

    def make(block: pa.Table, above: pa.Table) -> pa.Table:
        total, rest = block.column("total")[0].as_py(), _path_above(above)
        whole = [path + rest for path in paths(_digests(block.column("digests")[0].as_py()), min(levels, depth(total)))]
        n = len(whole)
        again = lambda t, c: pa.array([t.column(c)[0].as_py()] * n, pa.string())
        columns = {"places": pa.array([[p for p, _ in path] for path in whole], pa.list_(pa.int32())), "others": pa.array([[o.decode() for _, o in path] for path in whole], pa.list_(pa.string())), "subroot": again(above, "subroot")}
        return pa.table(({} if id_name == "src" else {"src": again(block, "src")}) | {id_name: block.column("ids")[0].values} | columns)

    return make


def _above(blocks: DataFrame, levels: int, scratch: Scratch, name: str) -> DataFrame:
    """(src, block, places, others, subroot): the way from each stored block's node to the top of its tree, whose node is ``subroot``."""
    size = ARITY**levels
    top = blocks.where(F.col("total") <= size).select("src", "block", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("others"), F.col("node").alias("subroot"))
    lower = blocks.where(F.col("total") > size)
    if not lower.limit(1).count():
        return top
    digest = F.unhex("node")
    nodes = lower.select("src", F.col("block").alias("id"), digest.alias("digest"), digest.alias("presented"), F.lit(1).cast("long").alias("n"), F.col("block").alias("pos"), F.expr(f"(total + {size - 1}) div {size}").alias("total"))
    upper = scratch.save(_blocks(nodes, levels), f"{name}-up")
    rest = scratch.save(_above(upper, levels, scratch, f"{name}-up"), f"{name}-rest")
    found = upper.groupBy("src", "block").cogroup(rest.groupBy("src", "block")).applyInArrow(_proofs_below(levels, "block"), "src string, block long, places array<int>, others array<string>, subroot string")
    return top.unionByName(found)


def _emit(levels: int, with_proof: bool):
    def make(block: pa.Table, above: pa.Table) -> pa.Table:
        total, rest = block.column("total")[0].as_py(), _path_above(above)
        top = b"".join(others for _, others in rest)
        leaves, presented = (_digests(block.column(c)[0].as_py()) for c in ("digests", "presented"))
        out: dict[str, list] = {c: [] for c in ("proof_sha256", "folded_root", "places", "others")}
        for node, path in zip(presented, paths(leaves, min(levels, depth(total))), strict=True):
            proof = hashlib.sha256(b"".join(others for _, others in path))
            proof.update(top)
            out["proof_sha256"].append(proof.hexdigest())
            out["folded_root"].append(fold(node, path + rest).decode())
            if with_proof:
                out["places"].append([p for p, _ in path + rest])
                out["others"].append([o.decode() for _, o in path + rest])
        n = len(leaves)
        fixed = {c: pa.array([above.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")}
        pos = block.column("block")[0].as_py() * ARITY**levels + np.arange(n)
        columns = {"id": block.column("ids")[0].values, "src": pa.array([block.column("src")[0].as_py()] * n, pa.string()), "pos": pos, "leaf": pa.array([x.decode() for x in leaves]), **fixed, "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"]}
        if with_proof:
            columns |= {"places": pa.array(out["places"], pa.list_(pa.int32())), "others": pa.array(out["others"], pa.list_(pa.string()))}
        return pa.table(columns)

    return make


def manifest(docs: DataFrame, fields: list[str], presented: Column | None = None, with_proof: bool = False, id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """One row for each row of ``docs``: id, source, pos (in its source), leaf, subroot, root, proof_sha256, folded_root and verified.

    ``presented`` is the leaf that is checked against the proof, in place of the row's own. proof_sha256: the
    digest of all others on the way up; with_proof: these themselves, as ``places`` and ``others``, a level each.
    """
    scratch = Scratch(docs.sparkSession)
    own = leaf(*(F.col(c) for c in fields))
    src = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    rows = docs.select(src.alias("src"), F.col(id_col).alias("id"), F.unhex(own).alias("digest"), F.unhex(own if presented is None else presented).alias("presented"))
    rows = scratch.save(rows.groupBy("src", "id", "digest", "presented").agg(F.count("*").alias("n")), "leaves")
    kind = rows.schema["id"].dataType.simpleString()
    blocks = scratch.save(_blocks(_numbered(rows, scratch, "leaves"), levels), "blocks")
    scratch.drop("leaves", "leaves-dealt")
    above = scratch.save(_above(blocks, levels, scratch, "blocks"), "above")

    # sources are the leaves of one more tree
    tops = above.select("src", "subroot").distinct()
    subroot = F.unhex("subroot")
    tops = scratch.save(tops.select(F.lit("").alias("src"), F.col("src").alias("id"), subroot.alias("digest"), subroot.alias("presented"), F.lit(1).cast("long").alias("n")), "tops")
    forest = scratch.save(_blocks(_numbered(tops, scratch, "tops"), levels), "forest")
    rest = scratch.save(_above(forest, levels, scratch, "forest"), "forest-above")
    roots = forest.groupBy("src", "block").cogroup(rest.groupBy("src", "block")).applyInArrow(_proofs_below(levels, "src"), "src string, places array<int>, others array<string>, subroot string")
    roots = scratch.save(roots.withColumnsRenamed({"places": "top_places", "others": "top_others", "subroot": "root"}), "roots")
    above = above.join(roots, "src").select("src", "block", F.concat("places", "top_places").alias("places"), F.concat("others", "top_others").alias("others"), "subroot", "root")

    schema = f"id {kind}, src string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    schema += ", places array<int>, others array<string>" if with_proof else ""
    out = blocks.groupBy("src", "block").cogroup(above.groupBy("src", "block")).applyInArrow(_emit(levels, with_proof), schema)
    source = F.when(F.col("src") != "0", F.substring("src", F.lit(2), F.length("src")))
    more = ["places", "others"] if with_proof else []
    return out.select(F.col("id").alias(id_col), source.alias(source_col), "pos", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *more)


def checked(presented: Column, places: Column, others: Column) -> Column:
    """The root that a leaf and a proof's levels lead to, as an expression."""
    put = lambda node, x: F.sha2(F.concat(F.substring(x["others"], F.lit(1), x["places"] * WIDTH), node, F.substring(x["others"], x["places"] * WIDTH + 1, F.length(x["others"]))).cast("binary"), 256)
    return F.aggregate(F.arrays_zip(places.alias("places"), others.alias("others")), presented, put)
