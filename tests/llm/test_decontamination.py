import random
import re

import numpy as np

from inkspan.llm import decontamination as dc


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """Every mask at every position of every pair, and the best run on each diagonal that one hits; all words in a row
    for items of five to seven words, and equal texts for shorter ones."""
    out = {}
    split = [(i, tokens(t)) for i, t in items]
    for doc, text in docs:
        x = tokens(text)
        for item, y in split:
            if 0 < len(y) < 8:
                for i in range(len(x) - len(y) + 1) if len(y) > 4 else [0]:
                    if x[i : i + len(y)] == y and (len(y) > 4 or len(x) == len(y)):
                        new = (len(y), -i, 0, len(y))
                        out[doc, item] = max(out.get((doc, item), new), new)
            for m in dc.MASKS if len(y) >= 8 else ():
                ones = [o for o, c in enumerate(m) if c == "1"]
                where = {}
                for j in range(len(y) - len(m) + 1):
                    where.setdefault(tuple(y[j + o] for o in ones), []).append(j)
                for i in range(len(x) - len(m) + 1):
                    for j in where.get(tuple(x[i + o] for o in ones), ()):
                        equal, a, z = dc.best_run(np.array(x), np.array(y), i - j)
                        if dc.enough(equal, len(y)):
                            new = (equal, -(i - j + a), -a, z - a)
                            out[doc, item] = max(out.get((doc, item), new), new)
    return sorted((d, i, e, n, -s, -t) for (d, i), (e, s, t, n) in out.items())


def rule(x, y):
    """Whether two texts overlap by the rule alone: some stretch of some diagonal with over two thirds equal words that are enough."""
    return any(most_equal(x, y, shift) >= min(13, -(-8 * len(y) // 10)) for shift in range(-len(y) + 1, len(x)))


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, item long, words string")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc long")
    return [tuple(r) for r in dc.overlaps(d, b).collect()]


def test_substitutions(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(26, 80)))) for i in range(12)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(100, 400))]
        if d % 2:
            part = items[d % 12][1].upper().split()
            for j in range(rng.randrange(3, 7), len(part), rng.randrange(5, 12)):
                part[j] = "other"
            at = rng.randrange(len(w))
            w[at:at] = part
        docs.append((d, "\n".join(w)))
    got = run(spark, docs, items)
    assert sorted(got) == brute(docs, items)
    assert {r[0] for r in got} >= {d for d in range(60) if d % 2}
    assert all(r[0] % 2 for r in got)


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert sorted(run(spark, docs, items)) == brute(docs, items)


def test_edges(spark):
    text = " ".join(f"v{i}" for i in range(20))
    shared = " ".join(f"s{i}" for i in range(30))
    items = [(1, text), (1, text), (2, None), (3, ""), (4, "too short"), (None, " ".join(f"n{i}" for i in range(20))), (6, shared + " p q r"), (7, shared + " x y z"), (8, "a b c d e f g h")]
    docs = [(1, None), (2, ""), (3, text.upper()), (3, text), (None, "é " + text), (5, " ".join(f"n{i}" for i in range(20))), (6, "z " * 100_000 + text), (7, shared), (8, "a b c d e f g h"), (9, "a b c d e f g i")]
    got = {(r[0], r[1]): r[2] for r in run(spark, docs, items)}
    assert got == {(3, 1): 20, (None, 1): 20, (5, None): 20, (6, 1): 20, (7, 6): 30, (7, 7): 30, (8, 8): 8, (9, 8): 7}
    assert run(spark, docs, []) == [] and run(spark, [], items) == []
    left = dc.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in dc.overlaps(d, spark.createDataFrame(items, "item_id long, text string")).collect()), key=lambda r: (r[0] is None, r))


def test_every_item_of_a_passage(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = words(30)
    items = [(1, shared + " p q r"), (2, "x y z " + shared), (3, shared), (4, shared), (4, words(30)), (5, words(40))]
    docs = [(d, f"{words(20)} {shared if d % 2 else words(30)} {words(20)}") for d in range(6)] + [(7, shared), (8, shared)]
    got = found(spark, docs, items)
    assert got == brute(docs, items)
    assert {r[:2] for r in got} == {(d, i) for d in (1, 3, 5, 7, 8) for i in (1, 2, 3, 4)}


def most_equal(x, y, shift):
    """The most equal words of any stretch of a diagonal in which over two thirds are equal."""
    same = [x[j + shift] == y[j] for j in range(len(y)) if 0 <= j + shift < len(x)]
    return max((sum(same[i:z]) for i in range(len(same)) for z in range(i + 1, len(same) + 1) if 3 * sum(same[i:z]) > 2 * (z - i)), default=0)


def test_run_with_most_equal_words():
    rng = np.random.default_rng(4)
    for _ in range(400):
        y = np.arange(rng.integers(1, 50))
        x = np.where(rng.random(len(y)) < rng.choice([0.1, 0.3, 0.5]), -1, y)
        shift = int(rng.integers(-3, 4))
        x = x[-shift:] if shift < 0 else np.append(np.full(shift, -2), x)
        equal, i, z = dc.best_run(x, y, shift)
        assert equal == most_equal(x, y, shift)
        assert equal == sum(x[j + shift] == y[j] for j in range(i, z))


def test_short_and_split_overlaps(spark):
    rng = random.Random(6)
    items = [(i, [f"i{i}w{j}" for j in range(32 if i < 2 else 6 + i)]) for i in range(11)]
    docs = [(0, [w if j < 12 or j > 18 and j != 25 else "x" for j, w in enumerate(items[0][1])])]
    for i, w in items[2:]:
        for d in range(6):
            gone = rng.sample(range(len(w)), len(w) - min(13, -(-8 * len(w) // 10)))
            docs.append((10 * i + d, ["before"] * 9 + ["x" if j in gone else v for j, v in enumerate(w)] + ["after"] * 9))
    got = found(spark, [(d, " ".join(w)) for d, w in docs], [(i, " ".join(w)) for i, w in items])
    assert [r[:2] for r in got] == [(d, d // 10) for d, _ in docs]


def test_whole_short_texts(spark):
    items = [(1, "Yes"), (2, "one two three"), (3, None), (4, ""), (5, "one two three four five six seven"), (6, "a b c d e f g h")]
    docs = [(1, "yes"), (2, "\none  TWO three"), (3, "one two three four five six seven"), (4, "one two three four"), (None, "yes"), (5, ""), (6, None), (7, "x a b c d e f g h y"), (8, "yes yes")]
    docs += [(9, "so one two three four five six seven is said"), (10, "one two three four five six eight"), (11, "one two three")]
    got = found(spark, docs, items)
    assert {r[:3] for r in got} == {(1, 1, 1), (2, 2, 3), (3, 5, 7), (None, 1, 1), (7, 6, 8), (9, 5, 7), (11, 2, 3)}
    assert sorted(map(str, got)) == sorted(map(str, brute(docs[:4] + docs[5:], items) + [(None, 1, 1, 1, 0, 0)]))


def test_recall_of_the_rule(spark):
    """Against the rule itself, which knows no masks: of the overlaps of each length and share of replaced words nine
    tenths at least are found, and nothing else is."""
    rng = random.Random(9)
    items, docs, should = [], [], {}
    for n in [8, 10, 13, 16, 17, 18, 20, 24, 30, 40, 60]:
        for percent in (10, 20, 30):
            kind = n, percent
            should[kind] = set()
            while len(should[kind]) < 40:
                item = [f"i{len(items)}w{j}" for j in range(n)]
                part = ["x" if rng.random() * 100 < percent else w for w in item]
                text = ["a", "b", "c"] * 4 + part + ["d", "e"] * 6
                if rule(text, item):
                    should[kind].add(len(items))
                items.append((len(items), " ".join(item)))
                docs.append((len(docs), " ".join(text)))
    got = {r[:2] for r in found(spark, docs, items)}
    every = set().union(*should.values())
    assert all(d == i for d, i in got) and {d for d, _ in got} <= every
    shares = {kind: len([d for d in ids if (d, d) in got]) / len(ids) for kind, ids in should.items()}
    assert min(shares.values()) >= 0.9, shares


def test_long_overlaps_are_measured_whole(spark):
    """An overlap goes on far beyond its last seed."""
    item = [f"w{j}" for j in range(1200)]
    text = [w if j < 300 or j % 3 < 2 and j % 6 != 3 or j > 1100 else f"x{j}" for j, w in enumerate(item)]
    text = ["before"] * 50 + text[:300] + item[300:700] + ["after"] * 50
    assert found(spark, [(1, " ".join(text))], [(1, " ".join(item))]) == [(1, 1, 700, 700, 50, 0)]
    # replaced so that no mask fits into what follows: two of three words, then one of two
    text = [w if j < 60 or (j - 60) % 4 in (0, 1, 2) and j % 8 != 1 else "x" for j, w in enumerate(item[:400])]
    (row,) = found(spark, [(1, " ".join(text))], [(1, " ".join(item))])
    equal, i, z = dc.best_run(np.array(text), np.array(item), 0)
    assert row[2:] == (equal, z - i, i, i)


def test_clean_by_row(spark):
    item = " ".join(f"v{i}" for i in range(20))
    rows = [(1, item), (1, "other words of the same id"), (None, "x " + item), (None, "clean"), (None, None), (2, "clean"), (2, "clean")]
    docs = spark.createDataFrame([(*r, "a", 3) for r in rows], "doc_id long, text string, k0 string, _k0 long")
    left = dc.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(map(str, (r.text for r in left.collect()))) == ["None", "clean", "clean", "clean", "other words of the same id"]
