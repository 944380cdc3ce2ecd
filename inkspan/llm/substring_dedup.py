"""Substring dedup over sliding sentence spans.

A sentence ends after a word that ends in '.', '!' or '?', at a line's end and at the text's end. Every run
of ``run`` consecutive sentences with at least ``min_words`` words is hashed (words folded A-Z, white space
ignored). Runs are joined over all documents; the first one, by document id and position, stays, and
the sentences that any other covers are removed.

With ``whole`` a run takes as many more sentences as it needs for ``min_words`` words, so that short ones make
longer runs, and sentences above ``LONG`` words are cut after the word with the smallest hash in each ``WINDOW``
words, so that a long one makes several spans that count as sentences. Spans have ``LONG`` words at most, so 50
words that two documents share, with equal line ends, hold a whole run of ``run`` = 3 and ``min_words`` = 20.

Documents are dealt into blocks by a hash of id and text; many equal rows are a few that stand for them. A block gives each of its runs once, with the first
place and how often, so a run in a third of all documents is a few rows; firsts are found by an aggregation that
adds up before the shuffle, and what repeats goes back to the blocks that have it by a join that Spark can split.

Defined cases: null texts stay null and empty ones empty; a text with nothing to remove stays as it is, byte
for byte; a null id sorts last; texts that share an id, or have none, are documents of their own in the order of
their hashes; rows with one id and one text are one document, so that an exact repetition of a row is no repeat;
ids are cast to long; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, block_of, dealt, n_blocks, undealt
from inkspan.llm.words import flat, mix, words

#: Text in a block, about.
BLOCK_BYTES = 4 << 20
LAST = 2**63 - 1
#: With ``whole``: words of a sentence that isn't cut, and of the windows that place the cuts.
LONG, WINDOW = 12, 8
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def _cuts(h, last):
    """The words inside long sentences after which these are cut, by the words around alone."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    part = np.cumsum(last) - last
    size = np.bincount(part)
    ok = np.flatnonzero((part[:n] == part[WINDOW - 1 :]) & (size[part[:n]] > LONG))
    x = mix(h)
    best, at = x[ok], ok.copy()
    for o in range(1, WINDOW):
        less = x[ok + o] <= best
        best[less], at[less] = x[ok[less] + o], ok[less] + o
    return at


def sentences(texts, whole: bool = False):
    """(hash, words, first byte, index of each text's first sentence, bytes, ends of texts)."""
    data, ends = flat(texts)
    h, start, stop, at = words(data, ends, lower=True)
    if not len(h):
        none = np.zeros(0, np.int64)
        return h, none, none, np.zeros(len(ends), np.int64), data, ends
    last = _END[data[stop - 1]]
    breaks = np.flatnonzero(data == 0x0A)
    last[:-1] |= np.searchsorted(breaks, start[1:]) > np.searchsorted(breaks, stop[:-1])
    last[at[1:][np.diff(at) > 0] - 1] = True
    if whole:
        last[_cuts(h, last)] = True
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    n = np.diff(np.append(first, len(h)))
    place = (np.arange(len(h)) - np.repeat(first, n)).astype(np.uint64)
    code = np.add.reduceat(mix(h + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), first)
    return mix(code), n, start[first], np.searchsorted(first, at), data, ends


def _spans(texts, run: int, min_words: int, whole: bool):
    """Sentences as above, and (hash, first sentence, number of sentences, text) of each run inside a text."""
    h, n, byte, at, data, ends = sentences(texts, whole)
    total = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(len(h))
    doc = np.searchsorted(at, first, side="right") - 1
    size = np.full(len(h), run)
    if whole:
        size = np.maximum(run, np.searchsorted(total, total[:-1] + min_words) - first)
    ok = np.flatnonzero(first + size <= at[doc + 1])
    ok = ok[total[ok + size[ok]] - total[ok] >= min_words]
    first, size, doc = first[ok], size[ok], doc[ok]
    code = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for o in range(int(size.max(initial=0))):
        i = np.flatnonzero(size > o)
        code[i] += h[first[i] + o] * np.uint64(pow(0xC2B2AE3D27D4EB4F, o + 1, 2**64))
    return (h, n, byte, at, data, ends), mix(code), first, size, doc


def _keys(run: int, min_words: int, whole: bool):
    def make(t: pa.Table) -> pa.Table:
        (_, _, _, at, _, _), code, first, _, doc = _spans(t.column("text"), run, min_words, whole)
        ids, ties = t.column("order").to_numpy(), t.column("tie").to_numpy()
        where = first - at[doc]
        order = np.lexsort((where, ties[doc], ids[doc], code))
        code, owner, tie, where = code[order], ids[doc][order], ties[doc][order], where[order]
        head = np.ones(len(code), dtype=bool)
        head[1:] = code[1:] != code[:-1]
        again = np.ones(len(code), dtype=bool)
        again[1:] = head[1:] | (owner[1:] != owner[:-1]) | (tie[1:] != tie[:-1]) | (where[1:] != where[:-1])
        i = np.flatnonzero(head)
        n = np.add.reduceat(again.astype(np.int64), i) if len(i) else i
        block = t.column("block")[0].as_py() if t.num_rows else 0
        return pa.table({"block": pa.array(np.full(len(i), block), pa.int32()), "code": code[i].view(np.int64), "owner": owner[i].astype(np.int64), "tie": tie[i].astype(np.int64), "place": where[i].astype(np.int64), "n": n.astype(np.int64)})

    return make


def _cut(run: int, min_words: int, whole: bool):
    def make(docs: pa.Table, found: pa.Table) -> pa.Table:
        (_, n, byte, at, data, ends), code, first, size, doc = _spans(docs.column("text"), run, min_words, whole)
        ids, ties = docs.column("order").to_numpy(), docs.column("tie").to_numpy()
        known = found.column("code").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, owner, tie, place = known[order], *(found.column(c).to_numpy()[order] for c in ("owner", "tie", "place"))
        gone = np.zeros(len(n), dtype=bool)
        if len(known) and len(code):
            i = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = (known[i] == code) & ~((owner[i] == ids[doc]) & (tie[i] == ties[doc]) & (place[i] == first - at[doc]))
            first, size = first[hit], size[hit]
            for o in range(int(size.max(initial=0))):
                gone[first[size > o] + o] = True
        texts, total, removed, lost = [], np.diff(at), [], []
        for d in range(len(ends) - 1):
            i, j = at[d], at[d + 1]
            g = gone[i:j]
            removed.append(int(g.sum()))
            lost.append(int(n[i:j][g].sum()))
            if removed[-1]:
                edge = np.append(byte[i:j], ends[d + 1])
                texts.append(b"".join(data[edge[s] : edge[s + 1]].tobytes() for s in np.flatnonzero(~g)).decode())
            else:
                texts.append(docs.column("text")[d].as_py())
        return pa.table({"id": docs.column("id"), "text": pa.array(texts, pa.string()), "n_sentences": total.astype(np.int64), "n_removed": pa.array(removed, pa.int64()), "words_removed": pa.array(lost, pa.int64()), "copies": docs.column("copies")})

    return make


def dedup(docs: DataFrame, run: int = 2, min_words: int = 10, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, text without repeats, n_sentences, n_removed, words_removed, changed."""
    blocks = n_blocks(docs, text_col, BLOCK_BYTES)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("order"), F.xxhash64(text).alias("tie"), text.alias("text"))
    # rows with one id and one text may lie in several blocks: what covers a place of theirs is never that place itself
    scratch = Scratch(docs.sparkSession)
    rows = dealt(rows, ["id", "text"], scratch)
    rows = rows.withColumn("block", block_of(F.xxhash64("order", "tie", "piece"), blocks))
    keys = rows.groupBy("block").applyInArrow(_keys(run, min_words, whole), "block int, code long, owner long, tie long, place long, n long")
    keys = scratch.save(keys, "keys")
    firsts = keys.groupBy("code").agg(F.min(F.struct("owner", "tie", "place")).alias("first"), F.sum("n").alias("n")).where("n > 1")
    firsts = scratch.save(firsts.select("code", "first.*"), "firsts")
    found = scratch.save(keys.select("block", "code").join(firsts, "code"), "found")
    scratch.drop("keys", "firsts")
    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut(run, min_words, whole), "id long, text string, n_sentences long, n_removed long, words_removed long, copies long")
    return undealt(out).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_sentences", "n_removed", "words_removed", (F.col("n_removed") > 0).alias("changed"))
