import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pytest

from inkspan.llm import suffix_tree as pst
from inkspan.llm.registry import op3_suffix_tree_scores

DOCS = "/root/testdata/sf0.01/documents.parquet"


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1


def brute(rows, depth, min_count, smooth, divergence, ask=None):
    """The same tree from dictionaries, one text at a time."""
    train = [["</s>", *split(t)] for d, t in rows if not held(d)]
    one = collections.Counter(w for s in train for w in s[1:])
    total, v = sum(one.values()), len(one)
    least = min_count
    root = lambda w: (one[w] + 0.5) / (total + 0.5 * (v + 1))
    grams = [{(w,): n for w, n in one.items() if n >= least}]
    for d in range(1, depth + 1):
        n = collections.Counter(tuple(s[i : i + d + 1]) for s in train for i in range(len(s) - d))
        grams.append({g: c for g, c in n.items() if c >= least and g[:-1] in grams[-1] and (g[-1],) in grams[0]})
    kept = {}

    def prob(context, w):
        for k in range(len(context)):
            s = context[k:]
            if s in kept:
                inside, rest, rest_q = kept[s]
                return inside[w] if w in inside else rest / rest_q * prob(s[1:], w)
        return root(w)

    for d in range(1, depth + 1):
        by = collections.defaultdict(dict)
        for g, c in grams[d].items():
            by[g[:-1]][g[-1]] = c
        new = {}
        for s, nxt in by.items():
            n = grams[d - 1][s]
            q = {w: prob(s[1:], w) for w in nxt}
            rest, rest_q = 1 - sum(nxt.values()) / n, 1 - sum(q.values())
            gain = sum(c / n * math.log(c / n / q[w]) for w, c in nxt.items()) + (rest * math.log(rest / rest_q) if rest > 1e-12 else 0)
            if gain >= divergence:
                p = {w: (c + smooth * q[w]) / (n + smooth) for w, c in nxt.items()}
                new[s] = (p, 1 - sum(p.values()), rest_q)
        kept |= new
    if ask:
        ask(prob, one, kept)
    out = []
    for doc, text in rows:
        s = ["</s>", *split(text)]
        base = sum(math.log10(root(w)) for w in s[1:])
        full = sum(math.log10(prob(tuple(s[max(0, i - depth) : i]), s[i])) for i in range(1, len(s)))
        out.append((doc, held(doc), len(s) - 1, sum(one[w] > 0 for w in s[1:]), total, base, full))
    return out, len(kept)


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-6)  # the tree's values have 32 bits


def test_same_as_dictionaries(spark, monkeypatch):
    """The query's own parameters."""
    monkeypatch.setattr(pst, "BLOCK_BYTES", 300_000)
    rows = [tuple(r) for r in spark.read.parquet(DOCS).select("doc_id", "text").collect()]
    got = op3_suffix_tree_scores(spark, DOCS.rpartition("/")[0]).collect()
    want, kept = brute(rows, 3, 5, 2.0, 0.01)
    compare([tuple(r)[:7] for r in got], want)
    assert got[0].n_contexts == kept > 20
    fresh = [r for r in got if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_adds_up_to_one(spark):
    """After any context the probabilities of all words, the end and an unknown word add up to 1; the tables give these probabilities."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcde") if rng.random() < 0.5 else "ab"[j % 2] for j in range(30))) for i in range(200)]

    def ask(prob, one, kept):
        assert {len(s) for s in kept} == {1, 2, 3}
        for context in [*list(kept)[::7], (), ("a", "zz", "b"), ("</s>",), ("</s>", "a", "b")]:
            assert sum(prob(context, w) for w in [*one, "unknown"]) == pytest.approx(1, abs=1e-9)

    want, kept = brute(rows, 3, 5, 2.0, 0.001, ask)
    got = pst.score(spark.createDataFrame(rows, "doc_id long, text string"), divergence=0.001).collect()
    compare([tuple(r)[:7] for r in got], want)
    assert got[0].n_contexts == kept


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c"), (5, "a b " * 50_000), (7, "É é"), (8, "\n")]
    docs = spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id long, text string, held_out boolean, block int")
    want, _ = brute(rows, 3, 5, 2.0, 0.01)
    compare([tuple(r)[:7] for r in pst.score(docs).collect()], want)
    named = docs.selectExpr("concat('n', doc_id) AS doc_id", "text")
    assert {r.doc_id: r.held_out for r in pst.score(named).collect()} == {None if d is None else f"n{d}": held(None if d is None else f"n{d}") for d, _ in rows}
    only = docs.where("doc_id = 5")
    assert len(pst.score(only).collect()) == 1
    assert pst.score(docs.limit(0)).collect() == []


def test_grams_grow_with_the_corpus(spark):
    rng = random.Random(3)
    pairs = [(f"a{i}", f"b{i}") for i in range(300)]
    rows = [(d, " ".join(" ".join(rng.choice(pairs)) for _ in range(2500))) for d in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rare = [(1000 + i, " ".join(f"r{i} s{i} t{i}" for i in range(8))) for i in range(8)]
    got = pst.score(docs.union(spark.createDataFrame(rare, "doc_id long, text string"))).collect()
    assert got[0].train_tokens > 900_000  # 1e-5 of them is more than the rare words' counts
    want, kept = brute(rows + rare, 3, 5, 2.0, 0.01)
    compare([tuple(r)[:7] for r in got], want)
    assert got[0].n_contexts == kept


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(pst, "BLOCK_BYTES", 500)
    monkeypatch.setattr(pst, "dealt", functools.partial(pst.dealt, most=3, piece=4))
    rows = [(None, None)] * 50 + [(3, "a b c a b c")] * 41 + [(3, "a b")] * 3 + [(6, "b c d")] * 5
    want, _ = brute(rows, 3, 5, 2.0, 0.01)
    compare([tuple(r)[:7] for r in pst.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()], want)
