import collections
import re

import pytest

from inkspan.llm import mixing


def goals(sizes, weights, cap):
    """Targets by giving what is above to the others, again and again."""
    total, left = sum(sizes.values()), dict(sizes)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, pool = {}, total
    while left:
        share = {s: pool * w[s] / sum(w[x] for x in left) for s in left}
        above = [s for s in left if share[s] > cap * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = cap * sizes[s]
            pool -= out[s]
            del left[s]
    return out


def check(docs, rows, sizes):
    want = goals(sizes, (1, 2, 3), 3)
    taken = collections.Counter()
    for r, source in rows:
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-6


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) for r in docs.collect()}
    sizes = collections.Counter()
    for s, n in words.values():
        sizes[s] += n
    rows = mixing.takes(docs).collect()
    assert all(r.size == words[r.doc_id][1] for r in rows)
    check(docs, [(r, words[r.doc_id][0]) for r in rows], sizes)
    again = mixing.takes(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    rows = [(1, "a b c", "z"), (2, None, "z"), (3, "x " * 40_000, "big"), (4, "one", None), (4, "one", None), (5, "", "empty"), (None, "q r", "z"), (7, "é ü", "É")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, range long")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    got = mixing.takes(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for i, t, s in rows:
        by[i, len((t or "").split())].append(s)
    check(docs, [(r, by[r.doc_id, r.size].pop()) for r in got], sizes)
    assert mixing.takes(docs.limit(0)).collect() == []
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect())[1] >= 1


def test_one_source(spark):
    docs = spark.createDataFrame([(i, "w " * i, "s") for i in range(50)], "doc_id long, text string, source string")
    assert all(r.taken == r.size for r in mixing.takes(docs).collect())


def test_many_ranges_and_repeated_ids(spark, monkeypatch):
    """More ranges than 2**16, null and repeated ids that share a key, and names that clash."""
    rows = [(None, f"a b c n{i}", "s") for i in range(40)] + [(7, f"d e m{i}", "t") for i in range(40)] + [(100 + i, "x y z", "u") for i in range(40)] + [(9, "same", "u")] * 5
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, n long, k0 long, _mix_n long, i int")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    source = {(i, len(t.split())): s for i, t, s in rows}
    for size in (1e-4, 1, 2_000):
        monkeypatch.setattr(mixing, "RANGE_ROWS", size)
        got = mixing.takes(docs).collect()
        assert len(got) == len(rows)
        check(docs, [(r, source[r.doc_id, r.size]) for r in got], sizes)
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        words = collections.Counter()
        for r in mixed.collect():
            words[r.source] += len(r.text.split())
        assert all(0 <= words[s] - goal < 5 for s, goal in goals(sizes, (1, 2, 3), 3).items())


def test_ranges_change_nothing(spark, monkeypatch):
    """However many ranges there are, each row is taken as often: one id with many texts, no ids, and many equal rows."""
    rows = [(5, " ".join(["w"] * (i % 17)) + f" t{i}", "a") for i in range(300)] + [(None, f"n{i} o p", "b") for i in range(300)] + [(8, "same old text", "b")] * 200 + [(i, "u v", None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen, mixes = [], []
    for size in (0.5, 20, 100_000):
        monkeypatch.setattr(mixing, "RANGE_ROWS", size)
        seen.append(sorted((tuple(r) for r in mixing.takes(docs).collect()), key=repr))
        mixes.append(collections.Counter(tuple(r) for r in mixing.mix(docs).collect()))
    assert seen[0] == seen[1] == seen[2] and mixes[0] == mixes[1] == mixes[2]
    # the order is that of the hashes, not of the lengths
    taken = [(r.size, r.taken) for r in mixing.takes(docs, weights=(1, 9), max_epochs=3.0).collect() if r.doc_id == 5 and r.size]
    short = [t / n for n, t in taken if n < 6]
    assert 0.1 < sum(short) / len(short) < 0.9
