import collections
import random
import re

from pyspark.sql import functions as F

from inkspan.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def base(text):
    """The base counts, one text at a time."""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_base_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in qr.judge(docs).collect():
        assert tuple(r)[1:7] == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_good_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {(r.quality, r.kept): r.n for r in qr.judge(docs).join(labels, "doc_id").where("n_words >= 50").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert got[1, True] > 0.97 * (got[1, True] + got.get((1, False), 0))
    assert got[0, False] > 0.7 * (got[0, False] + got.get((0, True), 0))


def test_sketch(spark):
    x = spark.range(5000).withColumn("b", qr.bucket(F.col("id"))).withColumn("v", qr.value(F.col("b")))
    rows = x.orderBy("id").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert all(r.id <= r.v <= r.id * 33 / 32 + 1 for r in rows)


def test_edges(spark):
    text = "a1 b2 " * 60 + "é\x0b\x0c\r#"
    rows = [(1, None, "en", "s"), (2, "", None, None), (2, " \n\t", "en", "s"), (None, text, "en", None), (None, "x y\nx y\n\n\nx y", "de", "s"), (5, " ".join(f"w{i}" for i in range(200_000)), "en", "s")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, lang string, source string, n_words long, src string")
    got = sorted(tuple(r)[1:7] for r in qr.judge(docs).collect())
    assert got == sorted(base(t) for _, t, _, _ in rows)
    assert qr.judge(docs.limit(0)).collect() == []
    left = qr.keep_good(docs)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [5]


def test_bounds_follow_the_group(spark):
    """Groups that differ in every ratio get bounds of their own; a small one leans on its language."""
    rng = random.Random(3)

    def text(length, marks, copies, again):
        lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(length - 1, length + 2))) for _ in range(12)) for _ in range(10)]
        for i in range(copies):
            lines[i + 5] = lines[i]
        return "\n".join(lines) + " " + " ".join(["#"] * marks) + " q r s t u v w" * again

    def group(n, source, *levels, lang="en"):
        return [(f"{source}", lang, text(*levels)) for _ in range(n)]

    rows = group(600, "prose", 5, 0, 0, 0) + group(600, "code", 9, 40, 1, 2) + group(20, "few", 9, 40, 1, 2)
    docs = spark.createDataFrame([(i, t, lang, s) for i, (s, lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    bounds = {r.src[1:]: r for r in qr.fences(qr.blended(qr.sketch(qr.counts(docs, "doc_id", "text", "lang", "source")), 50)).collect()}
    for m in qr.RATIOS:
        assert bounds["prose"][f"{m}_hi"] < bounds["code"][f"{m}_hi"], m
    assert bounds["prose"].word_length_lo < bounds["code"].word_length_lo
    assert all(r.kept for r in qr.judge(docs).collect())
    # 40 marks are usual in code and junk in prose
    odd = spark.createDataFrame([(9000, text(5, 40, 0, 0), "en", "prose"), (9001, text(9, 40, 0, 0), "en", "code"), (9002, text(5, 3, 0, 0), "en", "prose")], docs.schema)
    got = {r.doc_id: r.outside for r in qr.judge(docs.union(odd)).where("doc_id >= 9000").collect()}
    assert "symbols" in got[9000] and got[9001] == got[9002] == ""


def test_bounds_of_rare_counts(spark):
    """On the documents no bound is the same in all groups, though most documents have no symbol and no repeated line."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    bounds = qr.fences(qr.blended(qr.sketch(qr.counts(docs, "doc_id", "text", "lang", "source")), 50)).collect()
    assert len(bounds) == 80
    for m in qr.RATIOS:
        assert len({r[f"{m}_hi"] for r in bounds}) > 10, m
    assert min(r.symbols_hi for r in bounds) > 0


def test_what_is_allowed_grows_with_the_text(spark):
    """Four marks are nothing in 15,000 words and too many in 60, also where no other text has any."""
    text = lambda n, marks: " ".join(f"w{j:05d}" for j in range(n - marks)) + "".join(f" v{j:04d}%" for j in range(marks))
    rows = [(i, " ".join(f"w{i * 97 + j:05d}" for j in range(200)), "en", "none") for i in range(300)]
    rows += [(1000, text(15_000, 4), "en", "none"), (1001, text(60, 4), "en", "none"), (1002, text(60, 1), "en", "none")]
    got = {r.doc_id: r.outside for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("doc_id >= 1000").collect()}
    assert got == {1000: "", 1001: "symbols", 1002: ""}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    source = docs.first().source
    long = spark.createDataFrame([(-1, rows[-3][1], "en", source)], docs.schema)
    assert qr.judge(docs.union(long)).where("doc_id = -1").first().kept


def test_each_row_by_itself(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(5)]
    rows = [(None, good[0]), (None, "x y"), (7, good[1]), (7, "short"), (8, good[2]), (8, good[2]), (9, None), (None, "x y")]
    docs = spark.createDataFrame([(*r, "en", "s", "k0", 1) for r in rows], "doc_id long, text string, lang string, source string, k0 string, _gone0 long")
    left = qr.keep_good(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(None, good[0]), (7, good[1]), (8, good[2]), (8, good[2])], key=str)
