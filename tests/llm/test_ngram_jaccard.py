import re

import pytest

from inkspan.llm import ngram_jaccard as nj

DOCS = "/root/testdata/sf0.01/documents.parquet"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """component of each row by testing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def run(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in nj.jaccard_classes(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_same_as_all_pairs(spark, k, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).select("doc_id", "text").collect()]
    assert order(run(spark, rows, k, percent)) == order(brute(rows, k, percent))


def test_chains_of_near_copies(spark):
    """A group in which each text links with its neighbours only, and looser ones that link with nothing."""
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(130)]
    rows, w = [], list(base)
    for i in range(40):
        if i:
            w = list(w)
            w[(i * 7) % 130] = f"x{i}"
        rows.append((100 - i, " ".join(w)))
    for i in range(60):
        v = list(base)
        for j in rng.sample(range(130), rng.randrange(1, 12)):
            v[j] = f"y{i}-{j}"
        rows.append((200 + i, " ".join(v)))
    got = order(run(spark, rows, 4, 85))
    assert got == order(brute(rows, 4, 85))
    assert len({c for _, _, c in got}) > 2


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 3)
    long = " ".join(f"t{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one"), (7, long), (8, long + " end"), (None, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (9, "other text in a repeated id"), (None, "alone here now x"), (10, "É b c d e"), (11, "é b c d e")]
    assert order(run(spark, rows, 4, 85)) == order(brute(rows, 4, 85))
    assert run(spark, [], 4, 85) == []


def test_extra_columns_and_drop(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, "x"), (2, "A b c d e f", 1, 2, 3, "y"), (3, None, 0, 0, 0, "z")], "doc_id long, text string, n long, fp long, token long, key string")
    out = nj.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
