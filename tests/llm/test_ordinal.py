import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspan.llm import ordinal as o

DIR = "/root/testdata/sf0.1"
GRADE = "case when toxic = 1 then 0 when quality = 0 then 1 else 2 end"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    model = o.train(docs, labels.where(~held), F.expr(GRADE), 3)
    got = o.score(docs, model, top=2).join(labels.where(held), "doc_id").withColumn("grade", F.expr(GRADE))
    kept = {r.grade: r.kept for r in got.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[2] > 0.98 and kept[1] < 0.1 and kept[0] < 0.2
    grades = {r.grade: r.e for r in got.groupBy("grade").agg(F.avg("expected_grade").alias("e")).collect()}
    assert grades[0] < grades[1] < grades[2]
    assert got.where("tail_probability < 0 or tail_probability > 1 or expected_grade < tail_probability").count() == 0


def test_features_of_a_text():
    """Shares by counting one word at a time."""
    texts = ["Ab ab AB, x1 x1 é É", "", None, "zz", "a " * 1000]
    owner, dim, value = o.features(pa.array(texts))
    for d, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        again = sum(a.lower() == b.lower() for a, b in zip(w, w[1:], strict=False) if a.isascii() and b.isascii())
        assert (value[owner == d] ** 2).sum() * max(len(w), 1) == pytest.approx(2 * len(w) + again)
    one, two = (o.features(pa.array([t]))[1].tolist() for t in ("Same text", "same  TEXT\n"))
    assert set(one) & set(two)


def test_fit_finds_the_thresholds():
    """Against the likelihood that grid search reaches with one feature."""
    rng = np.random.default_rng(3)
    x = rng.random(3000)
    u = rng.random(3000)
    tails = [1 / (1 + np.exp(-(4 * x - c))) for c in (1.0, 3.0)]
    grade = (u < tails[0]).astype(int) + (u < tails[1]).astype(int)
    m = o.fit(np.arange(3000), np.zeros(3000, dtype=int), x, grade, 3, epochs=3000, lasso=0.0)
    assert m.weights[0] == pytest.approx(4, abs=0.5)
    assert m.cuts == pytest.approx([1, 3], abs=0.35)
    assert (np.diff(m.cuts) > 0).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "good words here", 3), (3, "good words here", 3), (None, "bad", 4), (4, "w " * 200_000, 5)], "doc_id long, text string, grade int")
    ratings = spark.createDataFrame([(3, 2), (1, 0), (None, 1), (4, None), (9, 1)], "doc_id long, grade int")
    model = o.train(docs, ratings, F.col("grade"), 3)
    assert len(o.score(docs, model, 2).collect()) == 6
    none = o.train(docs, ratings.limit(0), F.col("grade"), 3)
    assert all(math.isclose(r.expected_grade, 1.0) for r in o.score(docs, none, 2).collect())
    assert o.score(docs.limit(0), none, 2).collect() == []


def test_features_are_bounded(spark, monkeypatch):
    """The fit's features stay within the bound, whole texts count, and a wider bound takes the same ones and more."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(10 + i))) for i in range(60)] + [(7, " ".join(f"w7x{j}" for j in range(17)))], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")

    def seen(bound):
        def look(grades):
            def make(t):
                return pa.table({"weights": pa.array([[float(k) for k in sorted(t.column("key").to_pylist())]], pa.list_(pa.float64())), "cuts": pa.array([[float(len(x)) for x in t.column("dims").to_pylist()]], pa.list_(pa.float64()))})

            return make

        monkeypatch.setattr(o, "_fit", look)
        m = o.train(docs, ratings, F.col("grade"), 3, most_features=bound)
        return set(m.weights.tolist()), int(m.cuts.sum())

    (few, n), (more, m), (every, _) = seen(500), seen(1500), seen(1 << 20)
    assert 300 < n <= 500 and 1300 < m <= 1500
    assert few < more < every and len(every) == 60


def one_hash(word):
    data, ends = o.flat(pa.array([word]))
    return int(o.words(data, ends, lower=False)[0][0])


def shape(word):
    """Classes of the bytes, runs of one class once."""
    out = b""
    for c in word.encode():
        k = b"a" if 97 <= c <= 122 else b"A" if 65 <= c <= 90 else b"0" if 48 <= c <= 57 else b"\x80" if c >= 128 else bytes([c])
        out += k if out[-1:] != k else b""
    return out


def line(text, model):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    n = {}
    for x, y in zip(w, low, strict=True):
        data = np.frombuffer(shape(x), np.uint8)
        s = int(o.words(data, np.array([0, len(data)]), lower=False)[0][0])
        for code in (one_hash(y), s ^ 0x5851F42D4C957F2D):
            n[code % o.DIMENSIONS] = n.get(code % o.DIMENSIONS, 0) + 1
    for a, b in zip(low, low[1:], strict=False):
        if a == b:
            n[77 % o.DIMENSIONS] = n.get(77 % o.DIMENSIONS, 0) + 1
    return sum(model.weights[d] * math.sqrt(k / len(w)) for d, k in n.items())


def test_scores_one_text_at_a_time(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = o.train(docs, labels, F.expr(GRADE), 3)
    assert np.count_nonzero(model.weights) > 50
    some = docs.orderBy("doc_id").limit(150).union(spark.createDataFrame([(-1, None, "", "", 0), (-2, "É é É 12ab", "", "", 0)], docs.schema))
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in o.score(some, model, top=2).collect():
        tails = [1 / (1 + math.exp(c - line(texts[r.doc_id], model))) for c in model.cuts]
        assert r.expected_grade == pytest.approx(sum(tails), abs=1e-9) and r.tail_probability == pytest.approx(tails[1], abs=1e-9)
        assert r.kept == (r.tail_probability >= 0.5)


def test_repeated_rows_are_learnt_once(spark):
    texts = [f"good words {i} here" if i % 2 else f"bad thing {i} there" for i in range(40)]
    once = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "another text of that id")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(40)], "doc_id long, grade int")
    many = once.union(spark.createDataFrame([(3, texts[3])] * 200, once.schema))
    for sample in (8, 40):
        a, b = (o.train(d, ratings, F.col("grade"), 3, sample=sample) for d in (once, many))
        assert np.array_equal(a.weights, b.weights) and np.array_equal(a.cuts, b.cuts)
