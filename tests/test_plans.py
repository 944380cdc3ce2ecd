"""What plans must be like, groups that hold all rows, and the small functions around the joins."""

import random

import pytest
from pyspark.sql import functions as F

from inkspan.functions import geometry, tables
from inkspan.operators import compare, convert, layout, sets, spelling
from inkspan.plans import catalogue
from inkspan.sources import markup, readers, sinks


def test_middle_of_any_group(spark):
    """Groups from one row to most of the table, ties, null keys and values."""
    pick = random.Random(1)
    rows = [("hot", pick.randrange(50), i) for i in range(3000)] + [(k, pick.choice([None, 1, 2, 3]), i) for i in range(200) for k in ("b", None)] + [("one", 5, 0), ("two", 5, 1), ("two", 5, 2)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    got = {r.k: (r.v, r.i) for r in sets.middle(df, ["k"], ["v", "i"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted(((r[1], r[2]) for r in rows if r[0] == k), key=lambda x: (x[0] is not None, x))
        want[k] = mine[len(mine) // 2]
    assert got == want
    assert sets.middle(df.limit(0), ["k"], ["v"]).collect() == []


def test_join_same(spark):
    a = spark.createDataFrame([(1, None, "x"), (None, None, "y"), (2, "b", "z")], "i long, s string, v string")
    b = spark.createDataFrame([(1, None, 10), (None, None, 20), (2, "c", 30)], "i long, s string, w long")
    assert sorted((r.v, r.w) for r in tables.join_same(a, b, ["i", "s"]).collect()) == [("x", 10), ("y", 20)]


def reads(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_sources_are_read_once(spark):
    """Payloads are parsed, texts split and values counted once, whatever is asked of them afterwards."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = docs.select(F.lit("the").alias("word")).distinct()
    assert reads(spelling.spelling_error_rate(docs, ["doc_id"], known, text="text"), "spelling") == 0
    assert reads(spelling.spelling_error_rate(docs.select("doc_id", "text"), ["doc_id"], spark.createDataFrame([("the",)], "word string"), text="text"), "Relation") == 1
    answers = spark.createDataFrame([("p", "AWS", b'{"Blocks": []}')], "ptr string, service string, raw binary")
    assert reads(convert.aws_by_join(answers, "ptr", F.lit(1), F.lit(1)), "from_json") == 0
    assert reads(compare.quantiles(docs, ["lang"], "n_chars"), "text#") == 0
    # a page's own text is in one row of it, not beside each provider's
    plan = catalogue.wide(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "truth" not in plan.split("RepartitionByExpression")[1].split("Generate")[0]


def test_words_of_pages_without_any(spark):
    pages = spark.createDataFrame([(1, "Good wrod 12, good"), (2, ""), (3, None), (4, "stop")], "i long, txt string")
    lists = [spark.createDataFrame([(w,)], "word string") for w in ("good", "stop")]
    got = {r.i: (r.n_words, r.n_wrong, r.ser) for r in spelling.spelling_error_rate(pages, ["i"], *lists).collect()}
    assert got == {1: (3, 2, 2 / 3), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (1, 0, 0.0)}


def test_rectangles_that_meet(spark):
    pick = random.Random(2)
    rows = [tuple(pick.randrange(-3, 8) for _ in range(2)) + tuple(pick.randrange(0, 5) for _ in range(2)) + tuple(pick.randrange(-3, 8) for _ in range(2)) + tuple(pick.randrange(0, 5) for _ in range(2)) for _ in range(300)]
    names = ["a", "b", "c", "d", "e", "f", "g", "h"]
    one, two = ({k: F.col(n) for k, n in zip("xywh", part, strict=True)} for part in (names[:4], names[4:]))
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)).coalesce(1).select(geometry.rect_meets(one, two)).collect()]
    cells = lambda x, y, w, h: {(i, j) for i in range(x, x + w + 1) for j in range(y, y + h + 1)}
    assert got == [bool(cells(*r[:4]) & cells(*r[4:])) for r in rows]


def test_merge_and_matches(spark):
    tree = lambda text: spark.createDataFrame([("p", [("0,0,1,1", [("0,0,1,1", [("0,0,1,1", text)])])])], "ptr string, blocks array<struct<xywh:string,lines:array<struct<xywh:string,words:array<struct<xywh:string,text:string>>>>>>")
    both = layout.merge(layout.flatten(tree("a"), "ptr"), layout.flatten(tree("b"), "ptr"))
    assert sorted((r.ptr, r.source_ix, r.text) for r in both.collect()) == [("p", 0, "a"), ("p", 1, "b")]
    pictures = spark.createDataFrame([("p", b"1"), ("q", b"2")], "ptr string, content binary")
    assert [(r.ptr, bytes(r.content)) for r in layout.pdf_matches(pictures, tree("a")).collect()] == [("p", b"1")]


@pytest.mark.parametrize(("html", "late"), [
    ('<p>a<p>b<p>c <a class="page-number">Page</a> d</p></div>', True),
    ('<p>a<p>b<p>c <a class="page-number">Page 10 U. S. 207</a> d</p></div>', False),
    ('<p>a <a class="page-number">Page</a> b</p></div>', False),
    ('<p>a<p>b<p>c <a class="page-number" name="7">Page</a> d</p></div>', False),
])
def test_page_number_expected(spark, html, late):
    files = spark.createDataFrame([("f", '<div id="tab-opinion-1">' + html)], "name string, html string")
    assert ("a page number was expected" in [r.error for r in markup.html_errors(files).collect()]) == late


@pytest.mark.parametrize("columns", [7, 100, 10_000])
def test_tiles_of_a_whole_matrix(spark, tmp_path, columns):
    """The transposed matrix of all pages, there and back, with more pages than a tile holds."""
    pick = random.Random(columns)
    rows = [(m, f"M{m}", f"doc-{p:05d}", pick.random()) for m in range(3) for p in range(250) if m == 0 or pick.random() < 0.8]
    pick.shuffle(rows)
    matrix = spark.createDataFrame(rows, "metric_ix int, metric string, ptr string, value double")
    made = compare.tiles(matrix, columns)
    assert made.select("tile").distinct().count() == -(-250 // columns)
    assert made.agg(F.max(F.size(F.split("line", ",")))).first()[0] == min(250, columns) + 1
    sinks.matrix_tiles(made, f"{tmp_path}/m")
    got = readers.matrix_tiles(spark, f"{tmp_path}/m", columns).collect()
    names = {r.place: r.value for r in got if r.label == "ptr"}
    assert names == {p: f"doc-{p:05d}" for p in range(250)}
    assert sorted((r.label, names[r.place], float(r.value)) for r in got if r.label != "ptr") == sorted((n, p, v) for _, n, p, v in rows)
    # pasted side by side in order, the tiles are the matrix's lines
    lines = {}
    for r in sorted(made.collect(), key=lambda r: r.tile):
        lines.setdefault(r.place, []).append(r.line if not lines.get(r.place) else r.line.split(",", 1)[1])
    assert ",".join(lines[-1]) == ",".join(["ptr", *(names[p] for p in range(250))])


def test_numbered(spark):
    got = tables.numbered(spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "a long, b long"), ["a"], "n").collect()
    assert sorted((r.a, r.n) for r in got) == [(i, i) for i in range(101)]
