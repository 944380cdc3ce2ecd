"""N-gram Jaccard join: texts whose sets of word shingles overlap by a given part, exactly.

Shape of the job, for a threshold t and sets of n shingles:

1. One Arrow pass makes each text's set, its fingerprint and the shingles in a hash region.
   Texts with the same set share a fingerprint, so groups of copies are one set from here on.
2. A set that links with any other shares ceil(t*n) shingles, so it has at most n - ceil(t*n) that
   occur nowhere else. Counting these in the region (one aggregation: min and max fingerprint a
   shingle) rules most sets out; the region shrinks with n and is wide enough to tell. Sets that are out no
   longer share anything, so the count is repeated among the rest while that rules out many more.
3. What is left is counted over whole sets. Shingles are ordered rare first; the first
   n - ceil(t*n) + 1 of them (those that occur elsewhere) are the set's tile keys.
4. Each set is compared with the least altered set among its tiles; links become components.
5. Tiles that still hold several components are cut into size bands and blocks. In a tile, hashed
   bitmaps bound each pair's overlap from above by bit counts; pairs that may reach the threshold are
   intersected as sorted arrays. Pairs inside one component need no test: they add no component.

Defined cases: null and empty texts, and texts without words, have n_shingles 0 and link with nothing;
a text of fewer than k words is one shingle; rows that repeat a doc_id are judged alone and get the same
answer; rows with a null doc_id link like others but never name a component (null if nobody else does).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, components, once, row_key, small_enough, without
from inkspan.llm.words import distinct, flat, lists, portions, runs, words

#: Sets in one block of a tile.
BLOCK = 512
#: Representatives whose ids may be broadcast (16 bytes each).
BROADCAST_ROWS = 2_000_000


def shingle_sets(texts, k: int) -> Iterator[np.ndarray]:
    """The sorted set of each text's k-word shingles."""
    data, ends = flat(texts)
    h, _, _, at = words(data, ends, lower=True)
    every = runs(h, k)
    for i, j in zip(at[:-1], at[1:], strict=True):
        if j - i >= k:
            yield distinct(every[i : j - k + 1])
        elif j > i:
            yield runs(h[i:j], int(j - i))
        else:
            yield h[:0]


def fingerprint(tokens: np.ndarray) -> int:
    """63 bits of a hash; the lowest is left free."""
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), len(tokens)) & ~1).astype(np.int64))


def least(n: int, percent: int) -> int:
    """ceil(t*n) in whole numbers."""
    return -(-percent * n // 100)


def region(n: int, percent: int) -> float:
    """The part of the hash range in which a set of n shingles lists its own; steps down with n."""
    low = 4 ** int(math.log(max(n, 1), 4) + 1e-9)
    return min(1.0, 1 - percent / 100 + 1.25 / math.sqrt(low))


def _listed(k: int, percent: int):
    def make(batches):
        for b in portions(batches, 1):
            n, fp, listed, judged = [], [], [], []
            for s in shingle_sets(b.column(1), k):
                n.append(len(s))
                fp.append(fingerprint(s) if len(s) else None)
                wide = region(len(s), percent)
                narrow = min(region(x, percent) for x in (least(len(s), percent), len(s), len(s) * 100 // percent + 1))
                cut = len(s) if wide >= 1 else np.searchsorted(s, np.uint64(int(wide * 2**64)))
                listed.append(s[:cut])
                judged.append(2**63 - 1 if narrow >= 1 else int(narrow * 2**64) - 2**63)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(judged, pa.int64()), lists(listed)], names=["id", "k0", "k1", "n", "fp", "judged", "listed"])

    return make


def _sets(k: int):
    def make(batches):
        for b in portions(batches, 1):
            sets = [s for s in shingle_sets(b.column(1), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, sets), pa.int64()), lists(sets)], names=["fp", "tokens"])

    return make


def _bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=np.uint8)
    out[tokens.view(np.uint64) % np.uint64(bits)] = 1
    return np.packbits(out)


def _bitmaps():
    def make(batches):
        for b in batches:
            tokens = b.column(1)
            values, ends = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            out = []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                bits = min(8192, max(256, 1 << int(4 * (j - i)).bit_length()))
                out.append(_bitmap(values[i:j], bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["fp", "bits"])

    return make


def _fold(rows: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one width: a wider one folds onto a narrower one, as the widths are powers of two."""
    out = np.zeros((len(rows), size), dtype=np.uint8)
    for i, x in enumerate(rows):
        out[i] = np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)
    return out.view(np.uint64)


def _tile(percent: int):
    """Pairs of a tile (two blocks, or one with itself) that bit counts can't rule out."""

    def make(t: pa.Table) -> pa.Table:
        fp, n, s, root = (t.column(x).to_numpy() for x in ("fp", "n", "s", "root"))
        side, one = t.column("side").to_numpy(), t.column("one").to_numpy()
        bits = t.column("bits").to_pylist()
        sig = _fold(bits, min(len(x) for x in bits))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        for i in left:
            j = left if one[i] else right
            j = j[(root[j] != root[i]) & ((fp[j] > fp[i]) if one[i] else True)]
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            j = j[(np.minimum(s[i], s[j]) >= need) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
            if len(j):
                need = -(-percent * (n[i] + n[j]) // (100 + percent))
                mine = n[i] - np.bitwise_count(sig[i] & ~sig[j]).sum(axis=1, dtype=np.int64)
                other = n[j] - np.bitwise_count(sig[j] & ~sig[i]).sum(axis=1, dtype=np.int64)
                j = j[np.minimum(mine, other) >= need]
                out.append(np.stack([np.full(len(j), fp[i]), fp[j]]))
        a, b = np.concatenate(out, axis=1) if out else (fp[:0], fp[:0])
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return make


def _intersect(percent: int):
    def make(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xs, xe, ys, ye = x.values.to_numpy().view(np.uint64), x.offsets.to_numpy(), y.values.to_numpy().view(np.uint64), y.offsets.to_numpy()
            keep = []
            for i in range(len(x)):
                p, q = xs[xe[i] : xe[i + 1]], ys[ye[i] : ye[i + 1]]
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return make


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_copies): one row for each row of ``docs``.

    n_copies: rows with the same set. Links: 100 * intersection >= percent * union.
    """
    return _classes(docs, k, percent, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_copies")


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, k0, k1, n, root, component_id, n_copies) of every row; k0 and k1: its key, root: null without words."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pairs_of = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    # 1. sets, fingerprints and regions
    k0, k1 = row_key(F.col("id"), F.col("text"))
    keyed = pairs_of.select("id", "text", k0.alias("k0"), k1.alias("k1"))
    listed = scratch.save(keyed.mapInArrow(_listed(k, percent), "id long, k0 long, k1 long, n long, fp long, judged long, listed array<long>"), "listed")
    every = scratch.save(listed.select("id", "k0", "k1", "n", "fp"), "every")
    sets = listed.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.min("id").alias("rep"), F.min("judged").alias("judged"))
    sets = scratch.save(sets, "sets")

    # 2. sets with too many shingles of their own in the region; what is ruled out counts no more for the rest
    left, part = sets, listed.where("n > 0").select("fp", "judged", "listed")
    n_left = left.count()
    for i in range(1, 9):
        # a token's place inside its set's own region takes the fingerprint's free bit; tokens
        # are unsigned, and with the sign bit turned they compare as such
        judged = F.col("token").bitwiseXOR(F.lit(-(2**63))) < F.col("judged")
        marked = F.col("fp") + F.when(judged, 1).otherwise(0)
        seen = part.select(F.explode("listed").alias("token"), "fp", "judged").select("token", marked.alias("fp"))
        seen = seen.groupBy("token").agg(F.min("fp").alias("fp"), F.max("fp").alias("most"))
        own = seen.where((F.col("fp") == F.col("most")) & (F.col("fp") % 2 != 0)).groupBy((F.col("fp").bitwiseAND(F.lit(-2))).alias("fp")).agg(F.count("*").alias("own"))
        left = left.join(own, "fp", "left").where(F.coalesce("own", F.lit(0)) <= F.col("n") - F.expr(f"({percent} * n + 99) div 100"))
        left = scratch.save(left.select("fp", "n", "rep", "judged"), f"left-{i}")
        before, n_left = n_left, left.count()
        if n_left > 0.9 * before:
            break
        few = left.select("fp")
        few = F.broadcast(few) if n_left <= BROADCAST_ROWS else few
        part = scratch.save(part.join(few, "fp", "left_semi"), f"part-{i}")
        scratch.drop(f"left-{i - 1}", f"part-{i - 1}", "listed")
    scratch.drop("listed", *[f"part-{i}" for i in range(1, 9)])
    left = left.select("fp", "n", "rep")

    # 3. whole sets of the rest, each from the text of its smallest id
    ids = left.where("rep is not null").select(F.col("rep").alias("id")).distinct()
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_ROWS) else ids
    texts = pairs_of.where("id is not null").join(ids, "id", "left_semi")
    if left.where("rep is null").limit(1).count():
        texts = texts.union(pairs_of.where("id is null"))
    tokens = scratch.save(texts.mapInArrow(_sets(k), "fp long, tokens array<long>"), "texts")
    if tokens.count() > left.count():  # repeated ids, or ids that are null
        tokens = scratch.save(tokens.join(left.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "tokens")
        scratch.drop("texts")
    # a token in every set is counted before the shuffle, and the join with its count can be split
    rows = tokens.select("fp", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    common = scratch.save(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "common")
    rows = rows.join(common, "token")
    # how common a token is (by doublings) before the token, in one number: rare ones first. Tokens that agree
    # in all but seven bits share a tile, which costs a comparison and no link.
    rank = (F.shiftleft(F.length(F.bin("df")).cast("long"), 57) + F.shiftrightunsigned("token", 7)).alias("rank")
    shared = rows.select("fp", "n", rank).groupBy("fp").agg(F.first("n").alias("n"), F.count("*").alias("s"), F.array_sort(F.collect_list("rank")).alias("shared"))
    take = F.expr(f"greatest(0L, s - ({percent} * n + 99) div 100 + 1)").cast("int")
    shared = shared.where(f"s >= ({percent} * n + 99) div 100").select("fp", "n", "s", F.slice("shared", F.lit(1), take).alias("keys"))
    shared = scratch.save(shared, "shared")
    scratch.drop("common")
    tiles = shared.select(F.explode("keys").alias("key"), "fp", "n", "s")

    # 4. each set against the least altered set of its tiles
    pivots = tiles.groupBy("key").agg(F.min(F.struct(F.expr("n - s").alias("own"), "n", "fp", "s")).alias("p"))
    star = tiles.join(pivots, "key").where("p.fp <> fp").where(_may_link("n", "s", "p.n", "p.s", percent))
    star = star.groupBy("fp", F.col("p.fp").alias("pivot")).agg(F.count("*").alias("hits")).groupBy("fp").agg(F.max(F.struct("hits", "pivot")).alias("best"))
    star = scratch.save(star.select(F.col("best.pivot").alias("a"), F.col("fp").alias("b")), "star-pairs")
    links = scratch.save(_verify(star, tokens, percent), "star")
    roots = components(links, scratch, "star-cc")

    # 5. tiles with several components: bands and blocks, bit counts, then exact intersections
    rooted = shared.select("fp", "n", "s", "keys").join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.save(rooted, "rooted")
    tiles = rooted.select(F.explode("keys").alias("key"), "fp", "n", "s", "root")
    seen = tiles.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("n").alias("kn"), F.max("s").alias("ks"))
    seen = scratch.save(seen.where("least <> most").select("key", "kn", "ks"), "seen")
    inner = tiles.join(seen, "key").where(_may_link("n", "s", "kn", "ks", percent, sizes=False)).drop("kn", "ks")
    # a hair wider than the ratio, so that rounding puts no two sets that may link two bands apart
    band = F.floor(F.log("n") / (1.000001 * math.log(100 / percent))).cast("int")
    banded = scratch.save(inner.withColumn("band", band), "banded")
    size = banded.groupBy("key", "band").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    size = scratch.save(size.select("key", "band", "blocks"), "size")
    placed = banded.join(size, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    above = size.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = size.select("key", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    placed = placed.join(above, ["key", "band"], "left").join(below, ["key", "band"], "left")
    # a tile is (lower band, block; upper band, block); each set goes to those that it takes part in
    same = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("band").alias("lo"), F.least(o, "block").alias("i"), F.col("band").alias("hi"), F.greatest(o, "block").alias("j"), F.when(F.col("block") > o, 1).otherwise(0).alias("side"), (o == F.col("block")).alias("one")))
    up = F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda o: F.struct(F.col("band").alias("lo"), F.col("block").alias("i"), (F.col("band") + 1).alias("hi"), o.alias("j"), F.lit(0).alias("side"), F.lit(False).alias("one")))
    down = F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda o: F.struct((F.col("band") - 1).alias("lo"), o.alias("i"), F.col("band").alias("hi"), F.col("block").alias("j"), F.lit(1).alias("side"), F.lit(False).alias("one")))
    none = F.expr("array()").cast("array<struct<lo:int,i:int,hi:int,j:int,side:int,one:boolean>>")
    placed = placed.select("key", "fp", "n", "s", "root", F.explode(F.concat(same, F.coalesce(up, none), F.coalesce(down, none))).alias("t"))
    bits = scratch.save(_asked(tokens, scratch.save(banded.select("fp").distinct(), "asked")).mapInArrow(_bitmaps(), "fp long, bits binary"), "bits")
    placed = placed.join(bits, "fp").select("key", "fp", "n", "s", "root", "t.*", "bits")
    found = scratch.save(placed.groupBy("key", "lo", "i", "hi", "j").applyInArrow(_tile(percent), "a long, b long").distinct(), "found")
    more = scratch.save(_verify(found, tokens, percent), "more")
    roots = components(links.union(more), scratch, "all-cc")

    # classes of every row; the smallest id of a component names it
    classes = sets.select("fp", "rep").join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = scratch.save(classes, "classes")
    names = scratch.save(classes.groupBy("root").agg(F.min("rep").alias("component_id")), "names")
    copies = every.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n_copies"))
    named = classes.join(names, "root").join(copies, "fp").select("fp", "root", "component_id", "n_copies")
    named = scratch.save(named, "named")
    out = every.join(named, "fp", "left")
    return out.select("id", "k0", "k1", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def _may_link(n: str, s: str, pn: str, ps: str, percent: int, sizes: bool = True):
    """Whether two sets of n and pn, of which s and ps occur elsewhere, can overlap enough."""
    fits = F.expr(f"(100 + {percent}) * least({s}, {ps}) >= {percent} * ({n} + {pn})")
    return fits & F.expr(f"100 * least({n}, {pn}) >= {percent} * greatest({n}, {pn})") if sizes else fits


def _asked(tokens: DataFrame, fps: DataFrame) -> DataFrame:
    """The sets whose fingerprints a stored table (fp) has; it is broadcast if it is small, so that sets stay
    where they are."""
    fps = fps.distinct()
    return tokens.join(F.broadcast(fps) if small_enough(fps, BROADCAST_ROWS) else fps, "fp", "left_semi")


def _verify(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a stored table whose sets link, by intersecting sorted arrays."""
    x = _asked(tokens, pairs.select(F.col("a").alias("fp"))).select(F.col("fp").alias("a"), F.col("tokens").alias("x"))
    y = _asked(tokens, pairs.select(F.col("b").alias("fp"))).select(F.col("fp").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_intersect(percent), "a long, b long")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, null last, and of several texts under
    that id the one with the smallest hash. Rows without words stay."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(_classes(docs, k, percent, id_col, text_col).where("root is not null").select("id", "k0", "k1", "root"), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k0", "k1")).alias("f"))
    first = scratch.save(first.select("root", F.col("f.k0").alias("f0"), F.col("f.k1").alias("f1")), "first")
    rows = rows.join(first, "root").withColumn("stays", F.expr("k0 = f0 and k1 = f1"))
    gone = scratch.save(rows.where("not stays").select("k0", "k1").distinct(), "gone")
    copies = scratch.save(rows.where("stays").groupBy("k0", "k1").agg(F.count("*").alias("n")).where("n > 1").select("k0", "k1"), "copies")
    key = lambda df: row_key(df[id_col].cast("long"), df[text_col])
    left = without(docs, key(docs), gone)
    if copies.limit(1).count():
        left = without(left, key(left), copies).unionByName(once(without(left, key(left), copies, how="left_semi"), row_key(F.col(id_col).cast("long"), F.col(text_col))))
    return left
