"""Probabilistic suffix tree over words: variable-length contexts, smoothed, scored by the longest one.

Tokens are a text's words and one end; a text is read as if an end stood before it. The root gives the
smoothed frequency of a token. A context of d words is a candidate if it, with one more token, is seen at least
``min_count`` times in the training texts. A context is kept if its next-token distribution diverges from that of its longest kept suffix by
``divergence`` nats or more (tokens without a frequent gram count as one symbol, so the estimate is a lower
bound).

In a kept context a frequent gram has (n + smooth * q) / (N + smooth), where q is what the suffix says; all
other tokens share what is left in the proportions of the suffix, so the probabilities add up to 1.

Words, grams and contexts grow with the corpus and stay in tables. Counting goes by length, one pass each:
a portion of text gives sorted arrays of its grams and their counts, cut by the first bits of the key into
parts that are merged each by itself. The same pass counts the next length by shortened keys, which tells
what can't be frequent, so that whole keys are shuffled for little else. Scoring deals texts into blocks; a
block asks the parts for the words, grams and contexts it has, once each. The ``HOT`` heaviest of them, which
nearly every block would ask for, go to every task instead, as do filters of bounded size that tell what
the tree lacks; a full filter costs time, not results.

Defined cases: null and empty texts are one end; a null id is held out or not by the checksum of the empty
text; ids keep their type and are read as text for that; rows that repeat are counted and scored each; without training rows every token has the same
probability; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, block_of, dealt, text_bytes, undealt
from inkspan.llm.words import distinct, flat, gathered, mix, slices, words

#: Text in a block, in a portion that is counted at once, and for each part of the keys, about.
BLOCK_BYTES, PORTION_BYTES, PART_BYTES = 8 << 20, 6 << 20, 16 << 20
#: Text of a block that is worked on at once, about.
SLICE_BYTES = 1 << 20
#: Stands for the end of a text among the words' hashes.
END = np.uint64(0x243F6A8885A308D3)
#: Keys that every task holds at most, with their values: 4 MB.
HOT = 1 << 18
#: Bytes of a key that a block sends to the key's part, which stands for the first bits.
KEY_BYTES = 6
#: Chunks of a filter, and the bounds of a chunk's bits, as powers of 2: 32 MB at most, whatever the tree's size.
CHUNKS, LEAST_BITS, MOST_BITS = 10, 10, 18
PACKED = "part int, kind int, key binary, context binary, tail binary, n binary"
MERGED = "kind int, key long, context long, tail long, n long"


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, each text's followed by its end, and the index at which each text starts."""
    data, ends = flat(texts)
    h, _, _, at = words(data, ends, lower=True)
    out = np.full(len(h) + len(ends) - 1, END, dtype=np.uint64)
    doc = np.searchsorted(at, np.arange(len(h)), side="right") - 1
    out[np.arange(len(h)) + doc] = h
    return out, at + np.arange(len(at))


def look(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The index of each key, -1 where it is absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int64)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == keys, i, -1)


def gram_key(context: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The key of a gram from those of all its tokens but the last and of all but the first; a token is its own key."""
    return mix(mix(context + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) + tail)


def outside_key(context: np.ndarray) -> np.ndarray:
    """The key under which a kept context is stored beside its grams."""
    return mix(context ^ np.uint64(0xA4093822299F31D0))


def _places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key: its chunk of a filter, which is its first bits, and two bits in it."""
    low = np.uint64(2**bits - 1)
    one = (key >> np.uint64(64 - CHUNKS - bits)) & low
    return (key >> np.uint64(64 - CHUNKS)).astype(np.int64), one.astype(np.int64), (mix(key) & low).astype(np.int64)


def _chunk_bits(bits: int):
    def make(t: pa.Table) -> pa.Table:
        _, one, two = _places(t.column("key").to_numpy().view(np.uint64), bits)
        full = np.zeros(2**bits, dtype=np.uint8)
        full[one] = full[two] = 1
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())})

    return make


def make_filter(keys: DataFrame, scratch: Scratch) -> tuple[bytes, int]:
    """The filter of a stored table's one column, with the bits of its chunks; 2**CHUNKS rows reach the driver at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * keys.count() >> CHUNKS).bit_length()))
    found = keys.withColumn("chunk", F.shiftrightunsigned("key", 64 - CHUNKS).cast("int")).groupBy("chunk").applyInArrow(_chunk_bits(bits), "chunk int, bits binary")
    empty = bytes(2**bits // 8)
    with scratch.tidy():
        parts = dict(tuple(r) for r in found.collect())
    return b"".join(parts.get(c, empty) for c in range(2**CHUNKS)), bits


def has(shared: tuple[bytes, int], key: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key; quick for sorted ones."""
    full, bits = np.frombuffer(shared[0], np.uint8), shared[1]
    one = key >> np.uint64(64 - CHUNKS - bits)
    out = (full[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1 == 1
    i = np.flatnonzero(out)
    chunk, _, two = _places(key[i], bits)
    out[i] = (full[(chunk << (bits - 3)) + (two >> 3)] >> (two & 7).astype(np.uint8)) & 1 == 1
    return out


class Values:
    """Values by key; keys are evenly spread 64 bits, so their first bits lead to the few places to compare."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.bits = max(4, len(key).bit_length())
        self.key, self.value = key[order], value[order]
        self.first = np.searchsorted(self.key >> np.uint64(64 - self.bits), np.arange(2**self.bits + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """The value of each key, NaN without one."""
        bucket = key >> np.uint64(64 - self.bits)
        i, stop = self.first[bucket], self.first[bucket + np.uint64(1)]
        out = np.full(len(key), np.nan)
        todo = np.flatnonzero(i < stop)
        while len(todo):
            at = i[todo]
            same = self.key[at] == key[todo]
            out[todo[same]] = self.value[at[same]]
            i[todo] += 1
            todo = todo[~same]
            todo = todo[i[todo] < stop[todo]]
        return out


def keys_at(token: np.ndarray, at: np.ndarray, depth: int):
    """For each depth: (context's key, key of the context and the token, whether the text has that context) at each token."""
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[at[:-1]] = END
    place = np.arange(len(token)) - np.repeat(at[:-1], np.diff(at))
    gram = token
    for d in range(depth):
        gram = gram_key(context, gram)
        yield context, gram, place >= d  # the end before a text is one token
        context = np.empty_like(gram)
        context[1:] = gram[:-1]
        context[:1] = END


def _pack(keys: np.ndarray, width: int = 8) -> bytes:
    """The lowest ``width`` bytes of each key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(parts: list[bytes], width: int = 8) -> np.ndarray:
    flatly = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    out = np.zeros((len(flatly), 8), dtype=np.uint8)
    out[:, :width] = flatly
    return out.view(np.uint64).ravel()


def _parts(keys: np.ndarray, shift: int):
    """(part, slice) of sorted keys; the bits above ``shift`` are the part."""
    part = keys >> np.uint64(shift)
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
    return [(int(part[i]), slice(i, j)) for i, j in zip(edges[:-1], edges[1:], strict=True) if i < j]


def _tally(order: int, shared, part_bits: int, width: int, more: bool):
    """Counts of a portion's grams of ``order`` tokens that the broadcast filter may hold (None: of all), and, with ``more``,
    of those with one more token by the first ``width`` bytes of their keys, if both shorter grams may be frequent."""

    def exact(context, gram, tail, ok):
        i = np.flatnonzero(ok)
        i = i[np.argsort(gram[i])]
        key = gram[i]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else i
        n, i, key = np.diff(np.append(first, len(key))), i[first], key[first]
        return [(p, 0, None, _pack(context[i[s]]), _pack(tail[i[s]]), n[s].astype(np.uint32).tobytes()) for p, s in _parts(key, 64 - part_bits)]

    def shortened(gram, ok):
        key, n = np.unique(gram[ok] >> np.uint64(64 - 8 * width), return_counts=True)
        n = np.minimum(n, 2**16 - 1).astype(np.uint16)
        return [(p, 1, _pack(key[s], width), None, None, n[s].tobytes()) for p, s in _parts(key, 8 * width - part_bits)]

    def make(batches):
        for texts in gathered(batches, 0, PORTION_BYTES):
            token, at = tokens(texts)
            rows, tail, ok = [], token, np.ones(len(token), dtype=bool)
            if order == 1:
                key, n = np.unique(token, return_counts=True)
                rows += [(p, 0, _pack(key[s]), None, None, n[s].astype(np.uint32).tobytes()) for p, s in _parts(key, 64 - part_bits)]
            for length, (context, gram, there) in enumerate(keys_at(token, at, order if more else order - 1), 2):
                if length == order:
                    shift = np.uint64(64 - 8 * width)
                    ok = there & has(shared.value, gram >> shift << shift)
                    rows += exact(context, gram, tail, ok)
                elif length == order + 1:
                    first = np.full(len(ok), order == 1)
                    first[1:] |= ok[:-1]
                    rows += shortened(gram, there & ok & first)
                tail = gram
            kinds = pa.int32(), pa.int32(), *[pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["part", "kind", "key", "context", "tail", "n"])

    return make


def _merge(order: int, width: int, min_count: int):
    """The sums of a part's counts: words all, grams and shortened keys (with zeros behind) of ``min_count`` or more."""

    def make(t: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            rows = t.filter(pa.compute.equal(t.column("kind"), kind))
            column = lambda c, size=8: _unpack(rows.column(c).to_pylist(), size)  # noqa: B023, E731
            context, tail = (column("context"), column("tail")) if order > 1 and not kind else (None, None)
            key = column("key", width if kind else 8) if context is None else gram_key(context, tail)
            n = np.frombuffer(b"".join(rows.column("n").to_pylist()), np.uint16 if kind else np.uint32).astype(np.int64)
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            n = np.add.reduceat(n[by], first) if len(key) else n
            often = n >= (min(min_count, 2**16 - 1) if kind else min_count if order > 1 else 0)
            first, n = first[often], n[often]
            context, tail = (pa.nulls(len(n), pa.int64()) if c is None else pa.array(c[by][first].view(np.int64)) for c in (context, tail))
            out.append(pa.table({"kind": pa.array(np.full(len(n), kind), pa.int32()), "key": (key[first] << np.uint64(64 - 8 * width if kind else 0)).view(np.int64), "context": context, "tail": tail, "n": n}))
        return pa.concat_tables(out)

    return make


def _outside(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(outside_key(b.column(0).to_numpy().view(np.uint64)).view(np.int64)), b.column(1), b.column(2)], names=["key", "value", "weight"])


def asked(block: pa.Table, depth: int, shared, hot: np.ndarray) -> list[np.ndarray]:
    """The sorted keys that a block's scores need and that aren't hot: of words, and of grams and contexts that the tree may have."""
    words_, others = [], []
    for part in slices(block, "text", SLICE_BYTES):
        token, at = tokens(part.column("text"))
        below = distinct(token)  # each text has an end, which stands before the next
        words_.append(below)
        for _, gram, ok in keys_at(token, at, depth):
            out = outside_key(below)
            others.append(out[has(shared, out)])
            below = distinct(gram[ok])
            others.append(below[has(shared, below)])
    keys = (distinct(np.concatenate(k)) for k in (words_, others))
    return [k[look(hot, k) < 0] for k in keys]


def _block_keys(depth: int, known, bits: int):
    def make(t: pa.Table) -> pa.Table:
        shared, hot, _ = known.value
        keys = asked(t, depth, shared, hot)
        rows = [(kind, p, _pack(key[s], KEY_BYTES)) for kind, key in enumerate(keys) for p, s in _parts(key, 64 - bits)]
        block = pa.array(np.full(len(rows), t.column("block")[0].as_py()), pa.int32())
        return pa.table({"block": block, "part": pa.array([r[1] for r in rows], pa.int32()), "kind": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[2] for r in rows], pa.binary())})

    return make


def _answers(asks: pa.Table, known: pa.Table) -> pa.Table:
    """The counts of words (0: none) or values of grams and contexts (NaN: none) that each block asks of a part, in
    four bytes each: a word that isn't hot has a count below 2**32, unless there are 2**50 tokens."""
    tables = []
    for kind in (0, 1):
        t = known.filter(pa.compute.equal(known.column("kind"), kind))
        key = t.column("key").to_numpy().view(np.uint64) & np.uint64(2 ** (8 * KEY_BYTES) - 1)
        by = np.argsort(key)
        tables.append((key[by], np.append(t.column("value").to_numpy()[by], np.nan if kind else 0).astype(np.float32 if kind else np.uint32)))
    out = []
    for kind, blob in zip(asks.column("kind").to_pylist(), asks.column("keys"), strict=True):
        key, value = tables[kind]
        out.append(value[look(key, _unpack([blob.as_buffer()], KEY_BYTES))].tobytes())
    return pa.table({"block": asks.column("block"), "part": asks.column("part"), "kind": asks.column("kind"), "values": pa.array(out, pa.binary())})


def _scores(depth: int, broadcast, total: int, vocabulary: int):
    def part_scores(part: pa.Table, value: Values) -> pa.Table:
        token, at = tokens(part.column("text"))
        n = np.nan_to_num(value(token))
        best = np.log10((n + 0.5) / (total + 0.5 * (vocabulary + 1)))
        add = lambda x: np.add.reduceat(x, at[:-1]) if len(token) else np.zeros(0)
        base, known = add(best), add((n > 0).astype(np.int64)).astype(np.int64)
        for context, gram, ok in keys_at(token, at, depth):
            shift = value(outside_key(context))
            i = np.flatnonzero(ok & ~np.isnan(shift))
            inside = value(gram[i])
            best[i] = np.where(np.isnan(inside), shift[i] + best[i], inside)
        return pa.table({"id": part.column("id"), "held_out": part.column("held_out"), "n_tokens": np.diff(at).astype(np.int64), "n_known": known, "base_score": base, "score": add(best), "copies": part.column("copies")})

    def make(docs: pa.Table, found: pa.Table) -> pa.Table:
        shared, hot, hot_values = broadcast.value
        keys, values = asked(docs, depth, shared, hot), []
        for kind, dtype in ((0, np.uint32), (1, np.float32)):
            t = found.filter(pa.compute.equal(found.column("kind"), kind)).sort_by("part")
            values.append(np.frombuffer(b"".join(t.column("values").to_pylist()), dtype).astype(np.float64))
        value = Values(np.concatenate([hot, *keys]), np.concatenate([hot_values, *values]))
        return pa.concat_tables([part_scores(part, value) for part in slices(docs, "text", SLICE_BYTES)])

    return make


def train(texts: DataFrame, scratch: Scratch, depth: int, min_count: int, smooth: float, divergence: float, size: int) -> tuple[DataFrame, DataFrame, int, int, int]:
    """The tree of the texts (one column, about ``size`` bytes) and the counts of all their tokens as tables (key, value, weight); tokens, distinct tokens and kept contexts.

    weight: how often the training texts ask for a key.
    """
    bits = part_bits(size)
    width = min(7, max(4, -(-(size.bit_length() + 2) // 8)))  # bytes of a shortened key: at least 16 values for each token
    shared = counts = below = tree = None
    total = vocabulary = n_kept = 0
    for order in range(1, depth + 2):
        merged = texts.mapInArrow(_tally(order, shared, bits, width, order <= depth), PACKED).groupBy("part").applyInArrow(_merge(order, width, min_count), MERGED)
        merged = scratch.save(merged, f"counts-{order}")
        if shared is not None:
            shared.destroy()
        if order <= depth:
            shared = scratch.spark.sparkContext.broadcast(make_filter(merged.where("kind = 1").select("key"), scratch))
        grams = merged.where("kind = 0")
        if order == 1:
            counts = grams.select("key", F.col("n").cast("double").alias("value"), F.col("n").alias("weight"))
            total, vocabulary = grams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
            below = grams.where(F.col("n") >= min_count).select(F.col("key").alias("gram"), "n", ((F.col("n") + 0.5) / F.lit(total + 0.5 * (vocabulary + 1))).alias("chain"))
            continue
        # a frequent gram's context and its last tokens are frequent, so neither join loses a row
        grams = grams.select(F.col("key").alias("gram"), "context", "tail", "n")
        grams = grams.join(below.select(F.col("gram").alias("context"), F.col("n").alias("whole")), "context")
        grams = grams.join(below.select(F.col("gram").alias("tail"), F.col("chain").alias("q")), "tail")
        p = (F.col("n") + smooth * F.col("q")) / (F.col("whole") + smooth)
        grams = scratch.save(grams.select("gram", "context", "n", "whole", "q", (F.col("n") / F.col("whole")).alias("seen"), p.alias("p")), f"grams-{order}")
        sums = grams.groupBy("context").agg(F.sum(F.col("seen") * F.log(F.col("seen") / F.col("q"))).alias("gain"), F.greatest(1 - F.sum("seen"), F.lit(0.0)).alias("rest"), F.greatest(1 - F.sum("q"), F.lit(1e-12)).alias("rest_q"), F.greatest(1 - F.sum("p"), F.lit(1e-12)).alias("rest_p"), F.max("whole").alias("weight"))
        gain = F.col("gain") + F.when(F.col("rest") > 0, F.col("rest") * F.log(F.col("rest") / F.col("rest_q"))).otherwise(0.0)
        kept = scratch.save(sums.where(gain >= divergence).select("context", F.log10(F.col("rest_p") / F.col("rest_q")).alias("outside"), "weight"), f"kept-{order}")
        n_kept += kept.count()
        level = grams.join(kept.select("context", "outside"), "context", "left")
        level = scratch.save(level.select("gram", "n", "outside", "p", F.when(F.col("outside").isNull(), F.col("q")).otherwise(F.col("p")).alias("chain")), f"level-{order}")
        scratch.drop(f"grams-{order}")
        part = kept.mapInArrow(_outside, "key long, value double, weight long").union(level.where("outside is not null").select("gram", F.log10("p"), "n"))
        part = part.withColumn("value", F.col("value").cast("float").cast("double"))  # values have 32 bits wherever they are kept
        tree = part if tree is None else tree.union(part)
        below = level.select("gram", "n", "chain")
    tree = scratch.save(tree, "tree")
    scratch.drop(*[f"{name}-{order}" for name in ("counts", "kept", "level") for order in range(2, depth + 2)])
    return tree, counts, total, vocabulary, n_kept


def part_bits(size: int) -> int:
    return min(30, max(4, (size // PART_BYTES).bit_length()))


def hottest(values: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys with the greatest weights, sorted, and their values: as many whole classes of weight as ``most`` rows hold."""
    weight = F.floor(8 * F.log2("weight")).cast("int")
    total, least = 0, None
    for r in values.groupBy(weight.alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("w")).collect():  # 8 classes for each doubling
        total += r["n"]
        if total > most:
            break
        least = r["w"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    got = values.where(weight >= least).select("key", "value").toArrow()
    key = got.column("key").to_numpy().view(np.uint64)
    by = np.argsort(key)
    return key[by], got.column("value").to_numpy()[by]


def score(docs: DataFrame, depth: int = 3, min_count: int = 5, smooth: float = 2.0, divergence: float = 0.01, folds: int = 5, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_contexts.

    Held out: the rows whose crc32 of the id, as text, leaves ``held_fold`` on division by ``folds``; the rest train.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(F.col(id_col).alias("id"), (fold == held_fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    size = text_bytes(rows, "text")
    tree, counts, total, vocabulary, contexts_kept = train(rows.where("not held_out").select("text"), scratch, depth, min_count, smooth, divergence, size)
    shared, bits, values = make_filter(tree.select("key"), scratch), part_bits(size), counts.withColumn("kind", F.lit(0)).union(tree.withColumn("kind", F.lit(1)))
    common = spark.sparkContext.broadcast((shared, *hottest(values, HOT)))
    # no group by id or text goes to one block
    rows = dealt(rows, ["id", "text"], scratch)
    rows = rows.withColumn("block", block_of(F.xxhash64("id", "text", "piece"), max(1, -(-size // BLOCK_BYTES))))
    asks = rows.groupBy("block").applyInArrow(_block_keys(depth, common, bits), "block int, part int, kind int, keys binary")
    known = values.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("part"), "kind", "key", "value")
    found = asks.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_answers, "block int, part int, kind int, values binary")
    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scores(depth, common, total, vocabulary), f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, copies long")
    return undealt(out).select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", F.lit(contexts_kept).alias("n_contexts"))
