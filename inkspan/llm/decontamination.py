"""Benchmark decontamination by spaced seeds: masks over word windows that skip some positions.

A mask hashes the words at its ones; words under its zeros may differ. Benchmark windows and training
windows meet in a join on the hash. Around each hit the words are compared along its diagonal, as far as the
longest item reaches; of the runs with a positive score (1 for an equal word, -2 for another) the one with the most
equal words counts if it has enough. The masks ask for five equal words within eight, so that hardly any run that
counts has none of them, whatever the item's length (README: measured shares).

Items of five to seven words are found where all their words stand in a row, by hashes of every five, six and seven
words. Items of fewer words are found where they are a whole text: inside other texts they are chance.

A filter of fixed size with the benchmark's hashes goes to every task, so that only windows that may
match leave it, with the words around them; a full filter costs time, not results.

Every item that has a passage is reported: items with the same words are one class, as are surroundings with
the same words, each pair of classes is compared once and stands for all members.

Defined cases: null and empty texts match nothing; ids are cast to long; rows that repeat a doc_id or an item_id are searched alone, and their findings merge; null ids are kept;
empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, row_key, without
from inkspan.llm.words import flat, lists, mix, portions, words

MASKS = ("110111", "11010011", "11100101")
#: Words of the shortest items that masks are for, and of the shortest ones that are looked for inside texts.
MASKED, INSIDE = 8, 5
#: Equal words that make an overlap; an item too short for that needs 80 per cent of its words.
MIN_EQUAL = 13
#: Bits of the filter: 2 MB, whatever the benchmark's size.
FILTER_BITS = 24


_PRIME = 0x9E3779B97F4A7C15


def _windows(h: np.ndarray, at: np.ndarray, mask: str, code: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of every window of a mask that stays inside its text."""
    n = max(0, len(h) - len(mask) + 1)
    ok = np.flatnonzero(np.arange(n) + len(mask) <= np.repeat(at[1:], np.diff(at))[:n])
    x = np.full(n, np.uint64(code), dtype=np.uint64)
    for o, bit in enumerate(mask):
        if bit == "1":
            x += h[o : o + n] * np.uint64(pow(_PRIME, o + 1, 2**64))
    return mix(x[ok]), ok


def seeds(h: np.ndarray, at: np.ndarray, items: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of every seed of texts, or of benchmark items: these have no masks if they are short, and
    windows of five to seven words only if they are one."""
    size = np.diff(at)
    owner = lambda pos: np.searchsorted(at, pos, side="right") - 1
    found = []
    for i, mask in enumerate(MASKS):
        x, pos = _windows(h, at, mask, i + 1)
        ok = size[owner(pos)] >= MASKED if items else slice(None)
        found.append((x[ok], pos[ok]))
    for n in range(1, MASKED):
        x, pos = _windows(h, at, "1" * n, 1000 + n)
        ok = size[owner(pos)] == n if items or n < INSIDE else slice(None)
        found.append((x[ok], pos[ok]))
    return np.concatenate([x for x, _ in found]), np.concatenate([pos for _, pos in found])


def _slots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(2**FILTER_BITS - 1)
    return (x & low).astype(np.int64), ((x >> np.uint64(FILTER_BITS)) & low).astype(np.int64)


def _items(batches):
    for b in portions(batches, 1):
        yield _seeded(b)


def _seeded(b: pa.RecordBatch) -> pa.RecordBatch:
    data, ends = flat(b.column(1))
    h, _, _, at = words(data, ends, lower=True)
    x, pos = seeds(h, at, items=True)
    doc = np.searchsorted(at, pos, side="right") - 1
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(len(ends)))
    parts = [order[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    tokens = [h[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([b.column(0), lists(tokens), lists([x[p] for p in parts]), lists([pos[p] - at[i] for i, p in enumerate(parts)])], names=["item", "words", "hash", "pos"])


def _regions(filter_bytes: bytes, reach: int):
    """Windows that the filter lets through, with the words around them; overlapping surroundings merge."""
    bits = np.frombuffer(filter_bytes, np.uint8)

    def has(slot):
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    def make(batches):
        for b in portions(batches, 1):
            data, ends = flat(b.column(1))
            h, _, _, at = words(data, ends, lower=True)
            x, pos = seeds(h, at, items=False)
            one, two = _slots(x)
            keep = has(one)
            keep[keep] = has(two[keep])
            x, pos = x[keep], pos[keep]
            order = np.argsort(pos, kind="stable")
            x, pos = x[order], pos[order]
            doc = np.searchsorted(at, pos, side="right") - 1
            lo, hi = np.maximum(pos - reach, at[doc]), np.minimum(pos + reach, at[doc + 1])
            fresh = np.ones(len(pos), dtype=bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(pos))[: len(first)]
            out = [(doc[i], lo[i] - at[doc[i]], h[lo[i] : hi[j - 1]], x[i:j], pos[i:j] - lo[i]) for i, j in zip(first, last, strict=True)]
            ids = b.column(0).take(pa.array([int(o[0]) for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([int(o[1]) for o in out], pa.int64()), *(lists([o[c] for o in out]) for c in (2, 3, 4))], names=["doc", "start", "words", "hash", "pos"])

    return make


def best_run(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(equal, start, end) of the run of positive score with the most equal words, of ``b`` compared with ``a`` at j + shift; positions in ``b``."""
    j0, j1 = max(0, -shift), min(len(b), len(a) - shift)
    if j1 <= j0:
        return 0, 0, 0
    same = a[j0 + shift : j1 + shift] == b[j0:j1]
    if not same.any():
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    count = np.concatenate([[0], np.cumsum(same)])
    z = np.arange(len(total))
    i = np.searchsorted(-np.minimum.accumulate(total), 1 - total)  # the first start that leaves a positive score
    z = z[i < z]
    i = i[z]
    most = count[z] - count[i]
    at = np.flatnonzero(same)
    i, z = at[count[i]], at[count[z] - 1] + 1  # without other words at its ends
    best = np.lexsort((i, total[i] - total[z], -most))[0]
    return int(most[best]), j0 + int(i[best]), j0 + int(z[best])


def enough(equal: int, n_item: int) -> bool:
    return equal >= min(MIN_EQUAL, -(-8 * n_item // 10))


def _verified(batches):
    for b in batches:
        out = []
        a, w = b.column(4), b.column(5)
        av, ae, wv, we = a.values.to_numpy(), a.offsets.to_numpy(), w.values.to_numpy(), w.offsets.to_numpy()
        starts, shifts = b.column(1).to_pylist(), b.column(3).to_pylist()
        for r in range(len(a)):
            x, y = av[ae[r] : ae[r + 1]], wv[we[r] : we[r + 1]]
            equal, i, z = best_run(x, y, shifts[r])
            if enough(equal, len(y)):
                out.append((r, equal, z - i, starts[r] + shifts[r] + i, i))
        rows = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), *(pa.array([o[c] for o in out], pa.int64()) for c in range(1, 5))], names=["region", "row", "n_equal", "n_words", "doc_start", "item_start"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_equal, n_words, doc_start, item_start): the longest overlap of each document and item.

    n_words: words of the overlap, n_equal: those that are equal; starts count words from 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    items = items.mapInArrow(_items, "item long, words array<long>, hash array<long>, pos array<long>")
    items = scratch.save(items.withColumn("row", F.xxhash64("words")), "items")
    each = F.inline(F.arrays_zip("hash", "pos"))
    stand = scratch.save(items.dropDuplicates(["row"]).select("row", each).select("hash", "row", "pos"), "seeds")

    # the filter: at most 2**FILTER_BITS / 8 bytes reach the driver, however large the benchmark is
    low = F.lit(2**FILTER_BITS - 1)
    slot = F.explode(F.array(F.col("hash").bitwiseAND(low), F.shiftright("hash", FILTER_BITS).bitwiseAND(low)))
    filled = stand.select(slot.alias("slot")).groupBy(F.expr("cast(slot div 8 as int)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(slot % 8 as int)))").alias("bits"))
    bits = np.zeros(2**FILTER_BITS // 8, dtype=np.uint8)
    for part in filled.toLocalIterator():
        bits[part["byte"]] = part["bits"]
    shared = bits.tobytes()

    # what a hit is part of has the item's words at most on each side
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_regions(shared, reach), "doc long, start long, words array<long>, hash array<long>, pos array<long>")
    found = scratch.save(found.withColumn("region", F.xxhash64("words")), "regions")
    regions = found.dropDuplicates(["region"])
    hits = regions.select("region", each).withColumnRenamed("pos", "at").join(stand, "hash")
    hits = hits.select("region", "row", (F.col("at") - F.col("pos")).alias("shift")).distinct()
    texts = items.select("row", F.col("words").alias("item_words")).dropDuplicates(["row"])
    pairs = hits.join(texts, "row").join(regions.select("region", "words"), "region").select("region", F.lit(0).cast("long").alias("start"), "row", "shift", "words", "item_words")
    best = pairs.mapInArrow(_verified, "region long, row long, n_equal long, n_words long, doc_start long, item_start long")
    longest = F.max(F.struct("n_equal", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "n_words")).alias("b")
    best = best.groupBy("region", "row").agg(longest).select("region", "row", "b.n_equal", "b.n_words", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"))
    best = best.join(found.select("region", "doc", "start").distinct(), "region").join(items.select("row", "item").distinct(), "row")
    best = best.select("doc", "item", "n_equal", "n_words", (F.col("start") + F.col("doc_start")).alias("doc_start"), "item_start")
    best = best.groupBy("doc", "item").agg(longest)
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.n_equal", "b.n_words", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps with an item, whatever other rows their ids have."""
    key = row_key(docs[text_col])
    texts = docs.select(key[0].alias("k0"), F.col(text_col).alias("text"))
    gone = overlaps(texts, benchmark, "k0", "text", item_col, item_text_col).select("k0", F.lit(0).alias("k1")).distinct()
    return without(docs, (key[0], F.lit(0)), Scratch(docs.sparkSession).save(gone, "leaks"))
