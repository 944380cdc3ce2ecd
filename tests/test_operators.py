"""Operators against small fixtures and brute force."""

import itertools
import json
import random
import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.operators import compare, convert, layout, pointers, raster, sets, spatial, spelling
from inkspan.sources import markup, readers, recognisers, sinks
from inkspan.streaming import ingest


def answer(spark, service, payload):
    return spark.createDataFrame([("p-0", service, "V1", "", 5_000_000_000, "d", json.dumps(payload).encode())], "ptr string, service string, version string, text string, milliseconds long, date string, raw binary")


def aws(kind, i, text=None, ids=None, rels=None, left=0.125):
    b = {"BlockType": kind, "Id": i, "Text": text, "Geometry": {"BoundingBox": {"Left": left, "Top": 0.25, "Width": 0.5, "Height": 0.1}}}
    return b | ({"Relationships": rels or [{"Type": "VALUE", "Ids": ["v"]}, {"Type": "CHILD", "Ids": ids}]} if ids is not None or rels else {})


def test_aws(spark):
    blocks = [aws("PAGE", "p", ids=["l1", "l2"]), aws("PAGE", "q"), aws("LINE", "l1", ids=["w1", "w2"]), aws("LINE", "l2"), aws("WORD", "w1", "a"), aws("WORD", "w2", "b", left=0.05)]
    df = answer(spark, "AWS", {"Blocks": blocks}).withColumns({"w": F.lit(10), "h": F.lit(20)})
    row = convert.to_detections(df, "w", "h").first()
    assert (row.algo, row.millis, len(row.blocks), len(row.blocks[0].lines)) == ("aws-v1", 705032704, 1, 1)
    assert [(w.xywh, w.text) for w in row.blocks[0].lines[0].words] == [("1,5,5,2", "a"), ("1,5,5,2", "b")]
    joined = convert.aws_by_join(df, "ptr", F.lit(10), F.lit(20)).orderBy("word_ix").collect()
    assert [(r.line_ix, r.word_ix, r.text) for r in joined] == [(0, 0, "a"), (0, 1, "b")]


@pytest.mark.parametrize(("blocks", "message"), [([aws("PAGE", "p", ids=["x"])], "line not found"), ([aws("TABLE", "t")], "unknown block"), ([aws("PAGE", "p", rels=[{"Type": "ODD", "Ids": []}])], "unknown relationship")])
def test_aws_errors(spark, blocks, message):
    with pytest.raises(Exception, match=message):
        convert.to_detections(answer(spark, "AWS", {"Blocks": blocks})).collect()


def test_other_services(spark):
    azure = convert.to_detections(answer(spark, "Azure", {"regions": [{"boundingBox": "1,2,3,4", "lines": [{"boundingBox": "x", "words": [{"boundingBox": "5,6,7,8", "text": "é"}, {"boundingBox": "9,9,9,9"}]}]}]})).first()
    assert (azure.blocks[0].xywh, azure.blocks[0].lines[0].xywh, [w.text for w in azure.blocks[0].lines[0].words]) == ("1,2,3,4", "x", ["é", ""])
    assert convert.to_detections(answer(spark, "Azure", {})).first().blocks == []
    with pytest.raises(Exception, match="refused"):
        convert.to_detections(answer(spark, "Azure", {"code": "Bad"})).collect()
    box = [5, 1, 9, 2, 8, 7, 4, 6]
    read = convert.to_detections(answer(spark, "AzureRead", {"analyzeResult": {"readResults": [{"width": 30, "height": 40, "lines": [{"boundingBox": box, "text": "t", "words": [{"boundingBox": box, "text": "w"}]}]}]}})).first()
    assert (read.algo, read.blocks[0].xywh, read.blocks[0].lines[0].words[0].xywh) == ("azureread-v1", "0,0,30,40", "4,1,5,6")
    poly = {"vertices": [{}, {"x": 4}, {"x": 4, "y": 3}, {"y": 3}]}
    page = {"blocks": [{"bounding_box": poly, "paragraphs": [{"bounding_box": poly, "words": [{"bounding_box": poly, "symbols": [{"text": "a"}, {}, {"text": "b"}]}]}]}]}
    gcp = convert.to_detections(answer(spark, "GCP", {"pages": [page]})).first()
    assert (gcp.blocks[0].xywh, gcp.blocks[0].lines[0].words[0].text) == ("0,0,4,3", "ab")
    page["blocks"][0]["bounding_box"] = {"vertices": [{}, {}]}
    with pytest.raises(Exception, match="four vertices"):
        convert.to_detections(answer(spark, "GCP", {"pages": [page]})).collect()
    with pytest.raises(Exception, match="unknown service"):
        convert.to_detections(answer(spark, "Other", {})).collect()


@pytest.mark.parametrize("service", ["AWS", "Azure", "AzureRead", "GCP"])
def test_payload_is_parsed_once(spark, service):
    """Also under the flattening, whose optimisation otherwise tests the number of blocks first."""
    df = spark.createDataFrame([("p", service, "1", "", 1, "d", b"{}")], "ptr string, service string, version string, text string, milliseconds long, date string, raw binary")
    flat = layout.flatten(convert.to_detections(df.withColumn("service", F.lit(service))), "ptr", "algo")
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert flat.collect() == []


def test_repeated_ids(spark):
    blocks = [aws("PAGE", "p", ids=["l1"]), aws("LINE", "l1", ids=["w2", "w1"]), aws("WORD", "w1", "old"), aws("WORD", "w2", "b"), aws("WORD", "w1", "new")]
    row = convert.to_detections(answer(spark, "AWS", {"Blocks": blocks})).first()
    assert [w.text for w in row.blocks[0].lines[0].words] == ["b", "new"]


def test_files_round_trip(spark, tmp_path):
    """What the writers write, the readers read."""
    tree = convert.to_detections(answer(spark, "Azure", {"regions": [{"boundingBox": "1,2,3,4", "lines": [{"boundingBox": "5,6,7,8", "words": [{"boundingBox": "9,9,9,9", "text": "é"}]}]}]})).withColumn("provider", F.lit("azu"))
    one = tree.select(sinks.detection_json().alias("j")).first().j
    (tmp_path / "blw").mkdir()
    (tmp_path / "blw" / "p-0.azu.blw").write_text(one)
    (tmp_path / "blw" / "p-0.azu.txt").write_text("no tree")
    got = readers.detections(spark, str(tmp_path / "blw")).first()
    assert (got.ptr, got.provider, got.algo, got.blocks) == ("p-0", "azu", "azu-v1", tree.first().blocks)
    sinks.detections(tree, str(tmp_path / "trees"))
    assert spark.read.json(str(tmp_path / "trees")).first().blocks[0].lines[0].words[0].text == "é"
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "q-1.aws.json").write_text(json.dumps({"service": "AWS", "version": "1", "text": "t", "milliseconds": 7, "date": "d", "raw": "e30="}, indent=1))
    r = readers.results(spark, str(tmp_path / "json")).first()
    assert (r.ptr, r.provider, r.milliseconds, bytes(r.raw)) == ("q-1", "aws", 7, b"{}")
    pages = spark.createDataFrame([("azu", "p-0", "a\nb"), ("aws", "p-0", "c")], "provider string, ptr string, txt string")
    sinks.page_texts(pages, str(tmp_path / "texts"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "texts")).select("provider", "ptr", "txt").collect())) == sorted(map(tuple, pages.collect()))
    (tmp_path / "files").mkdir()
    sinks.page_files(spark.createDataFrame([("one", "x\ny"), ("two", "z")], "name string, text string"), f"file://{tmp_path}/files")
    assert sorted((r.name, r.text) for r in readers.texts(spark, str(tmp_path / "files")).collect()) == [("one.txt", "x\ny"), ("two.txt", "z")]
    cells = spark.createDataFrame([("d", 0, "A Seconds", "p1", 1.5), ("d", 0, "A Seconds", "p2", 2.0), ("d", 1, "B Seconds", "p1", 3.0), ("d", 1, "B Seconds", "p2", 0.25)], "doc string, metric_ix int, metric string, ptr string, value double")
    lines = compare.matrix_lines(compare.by_metric(cells, F.col("doc"), F.col("ptr")))
    assert [r.line for r in lines.orderBy("place").collect()] == ["ptr,p1,p2", "A Seconds,1.5,2.0", "B Seconds,3.0,0.25"]
    sinks.matrix(lines, str(tmp_path / "matrix"))
    back = readers.matrix(spark.read.text(str(tmp_path / "matrix")))
    assert sorted((r.label, r.place, r.value) for r in back.collect())[:2] == [("A Seconds", 0, "1.5"), ("A Seconds", 1, "2.0")]
    both = compare.paired_metrics(back.where("label <> 'ptr'").withColumn("label", F.when(F.col("label").startswith("A"), "A Seconds").otherwise("A Other")), "seconds", "other")
    assert sorted((r.name, r.place, r.x, r.y) for r in both.collect()) == [("A", 0, 1.5, 3.0), ("A", 1, 2.0, 0.25)]
    assert sinks.config_lines("T", "png", ["a", "b"], ["[]range,X;0;1"]) == ["title,T Explorer", "imgs-fmt,png", "txts-dirs,a,b", "[]links,Data;data/", "[]range,CER;0;1", "[]range,X;0;1"]


def test_small_readers(spark, tmp_path):
    (tmp_path / "v.csv").write_text("a,ab,1\n,,0\n,x,1\n")
    assert sorted(map(tuple, readers.edit_vectors(spark, f"{tmp_path}/v.csv").collect())) == [("", "", 0), ("", "x", 1), ("a", "ab", 1)]
    (tmp_path / "w.txt").write_text("b\na\nb\n")
    assert sorted(r.word for r in readers.word_list(spark, f"{tmp_path}/w.txt").collect()) == ["a", "b"]
    assert readers.word_list(spark, None).collect() == []
    answers = spark.createDataFrame([('{"next": null, "results": [{"shelf_id": "x1", "a": 1}, {"shelf_id": "Y2", "a": 2}]}',)], "json string")
    assert sorted(r.shelf_id for r in readers.shelf_ids(answers).collect()) == ["Y2", "x1"]
    with pytest.raises(Exception, match="more results"):
        readers.shelf_ids(answers.select(F.replace("json", F.lit("null"), F.lit('"page 2"')).alias("json"))).collect()
    files = spark.createDataFrame([("d", "b.txt"), ("d", "a.png"), ("d", "c.jpg"), ("e", "only.gif")], "g string, name string")
    assert sorted(map(tuple, readers.middle_extension(files, "g", "name").collect())) == [("d", ".txt"), ("e", ".gif")]
    boxes = spark.createDataFrame([("p", 1, 1, 3, 2)], "k string, x long, y long, w long, h long").withColumn("box", F.struct("x", "y", "w", "h"))
    (tmp_path / "p.png").write_bytes(raster.png(raster.annotate(boxes, ["k"], 9, 7), ["k"], 9, 7).first().png)
    sizes = readers.image_sizes(spark, f"{tmp_path}/p.png")
    assert tuple(sizes.first()) == ("p.png", 9, 7)
    results = spark.createDataFrame([("p", "x"), ("q", "y")], "ptr string, raw string")
    joined = convert.with_picture_sizes(results, sizes.select(F.lit("p").alias("ptr"), "width", "height"))
    assert [tuple(r) for r in joined.collect()] == [("p", "x", 9, 7)]


def test_lists_and_reports(spark):
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    assert sorted(r.word for r in sets.without_words(words, spark.createDataFrame([("b",)], "word string")).collect()) == ["a", "c"]
    rows = spark.createDataFrame([("x",), ("y",)], "ptr string")
    fixes = spark.createDataFrame([("x", "1"), ("z", "2")], "error string, correction string")
    assert [tuple(r) for r in sets.missing_patches(rows, fixes, "ptr").collect()] == [("z", "2")]
    assert tuple(sets.download_report(rows, rows.where("ptr = 'x'"), "ptr").first()) == (2, 1, 1)
    names = spark.createDataFrame([("010us008.html",), ("011us001.html",), ("x.txt",)], "n string")
    assert [r.n for r in names.where(pointers.only_corpus_files(F.col("n"), ".html", ["010us008.html"])).collect()] == ["011us001.html"]
    pts = spark.createDataFrame([(3, 4), (1, 9), (1, 2), (0, 5)], "d0 long, d1 long")
    assert [(r.d0, r.d1) for r in spatial.optimised(pts, 2).collect()] == [(1, 2), (0, 5), (3, 4), (1, 9)]
    assert compare.join_on_first([rows.withColumn("a", F.lit(1)), rows.where("ptr = 'y'").withColumn("b", F.lit(2))], "ptr").collect() == [("y", 1, 2)]
    t = compare.transpose(spark.createDataFrame([("r", "c", 1)], "row string, col string, v int"), "row", "col", "v").first()
    assert (t.row, t.col, t.v) == ("c", "r", 1)


def test_ring_and_matrix(spark):
    assert compare.ring(["b", "a"]) == [("a", "b")] and compare.ring(["c", "b", "a"]) == [("a", "b"), ("b", "c"), ("c", "a")] and compare.ring(["a"]) == []
    rows = [("p", "a", "xy", 1500), ("p", "b", "xz", 700), ("q", "a", "only", 1), ("p", "a", "old", 3)]
    wide = compare.side_by_side(spark.createDataFrame(rows, "ptr string, provider string, txt string, millis long"), ["a", "b"])
    got = {r.metric: r.value for r in compare.metric_matrix(wide.withColumn("truth", F.lit("x y")), ["a", "b"], "truth").collect()}
    assert got == {"A vs B": 1.0, "A vs PDF": 1.0, "A Seconds": 1.5, "B Seconds": 0.7, "PDF Word Count": 2.0}
    assert compare.limits(wide.where("false"), "ptr").first() == (None, None)


def test_quantiles(spark):
    rng = np.random.default_rng(5)
    data = {"one": [7.0], "ties": [1.0] * 500 + [2.0] * 3, "many": rng.integers(0, 900, 3000).astype(float).tolist(), "real": rng.normal(size=777).tolist()}
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("one", None)], "k string, v double")
    for r in compare.quantiles(df, ["k"], "v", cells=16).collect():
        assert np.allclose(r.quantiles, np.percentile(data[r.k], [0, 25, 50, 75, 100]), rtol=1e-12)


def test_spatial(spark):
    rng = random.Random(3)
    pts = [(rng.randrange(-50, 200), rng.randrange(0, 80)) for _ in range(300)]
    bxs = [(i, x, y, x + rng.choice([-1, 0, 1, 30, 300]), y + rng.choice([0, 2, 100])) for i, (x, y) in enumerate([*pts[:60], (0, 0)])]
    points, boxes = spark.createDataFrame(pts, "d0 long, d1 long"), spark.createDataFrame(bxs, "i long, lo0 long, lo1 long, hi0 long, hi1 long")
    got = sorted((r.i, r.d0, r.d1) for r in spatial.region_join(points, boxes).collect())
    assert got == sorted((i, a, b) for i, x, y, u, v in bxs for a, b in pts if x <= a <= u and y <= b <= v)
    rects = [(i, rng.randrange(-20, 90), rng.randrange(0, 90), rng.choice([0, 1, 5, 70]), rng.choice([0, 3, 40])) for i in range(120)]
    df = spark.createDataFrame(rects, "id long, x long, y long, w long, h long")
    pairs = sorted((r.a_id, r.b_id) for r in spatial.overlap_join(df, df).collect())
    assert pairs == sorted((a[0], b[0]) for a, b in itertools.product(rects, rects) if a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4])
    for root, rest in (((3, 1), [(1, 0), (2, 1)]), ((4, 4), [(0, 4), (3, 3)])):
        left = spatial.delete(spark.createDataFrame([root, *rest], "d0 long, d1 long"), spark.createDataFrame([root], "d0 long, d1 long"))
        assert sorted(map(tuple, left.collect())) == sorted(rest)
    assert spatial.region_join(points, boxes.where("false")).count() == 0


def stepwise(x0, y0, x1, y1):
    """Accumulated error instead of the closed form."""
    if x1 < x0:
        x0, y0, x1, y1 = x1, y1, x0, y0
    w, h, up, out = x1 - x0, abs(y1 - y0), (y1 > y0) - (y1 < y0), set()
    x, y, error = x0, y0, 0
    for _ in range(max(w, h) + 1):
        out.add((x, y))
        error += min(w, h)
        turn = 2 * error >= max(w, h) and max(w, h) > 0
        error -= max(w, h) * turn
        if w >= h:
            x, y = x + 1, y + up * turn
        else:
            x, y = x + turn, y + up
    return out


def test_lines(spark):
    rows = [(i, 20, 20, 20 + dx, 20 + dy) for i, (dx, dy) in enumerate(itertools.product(range(-6, 7), range(-9, 10)))]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, d int")
    got: dict = {}
    for r in raster.drawn(df, ["id"], raster.line(*[F.col(c) for c in "abcd"]), 300, 300).collect():
        got.setdefault(r.id, set()).add((r.x, r.y))
    assert all(got[i] == stepwise(*rest) for i, *rest in rows)


def test_png(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 2, 1)], "id int, x int, y int")
    data = bytes(raster.png(df, ["id"], 4, 3).first().png)
    assert data.startswith(b"\x89PNG") and data.endswith(b"IEND\xaeB`\x82")


def test_layout(spark):
    words = [(1, 0, 0, 0, "1,2,3,4", "a"), (1, 0, 0, 1, "5,2,3,9", "b"), (1, 1, 0, 0, "0,0,1,1", "c")]
    flat = spark.createDataFrame(words, "page int, block_ix int, line_ix int, word_ix int, xywh string, text string")
    tree = layout.rebuild(flat, "page")
    row = tree.select("blocks", layout.plain_text(F.col("blocks")).alias("t"), layout.counts(F.col("blocks")).alias("n")).first()
    assert row.t == "a b\nc" and tuple(row.n) == (2, 2, 3) and row.blocks[0].xywh == "1,2,7,9"
    assert sorted(map(tuple, layout.flatten(tree, "page").collect())) == sorted(words)
    one = spark.createDataFrame([(1, 0, 0, 1, 1, 1, 1)], "p int, line_ix int, word_ix int, x long, y long, w long, h long")
    assert layout.line_gaps(one, "p").count() == 0
    with pytest.raises(Exception, match="no blocks"):
        spark.range(1).select(layout.not_empty(F.array().cast("array<struct<xywh:string,lines:array<struct<xywh:string,words:array<struct<xywh:string,text:string>>>>>>"))).collect()


def test_sets_and_spelling(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "w string") for s in ("112", "111"))
    assert sorted(r.w for r in sets.common_with_copies(a, b).collect()) == ["1", "1"]
    rows = spark.createDataFrame([(1, 0, "e"), (1, 1, "e"), (0, 5, "e"), (2, 0, "k")], "doc int, place int, ptr string")
    fixed = sets.patch_pointers(rows, spark.createDataFrame([("e", "c"), ("z", "y")], "error string, correction string"), "doc", "place", "ptr")
    assert sorted(map(tuple, fixed.collect())) == [(0, 5, "c"), (1, 0, "e"), (1, 1, "e"), (2, 0, "k")]
    pages = spark.createDataFrame([(1, "good bad 12"), (2, None), (3, "")], "id int, txt string")
    got = {r.id: (r.n_words, r.n_wrong, r.ser) for r in spelling.spelling_error_rate(pages, ["id"], spark.createDataFrame([("good",)], "word string")).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}
    p = spark.createDataFrame([("OA167605170001",), ("OA16760517x0001",), ("17410225-1",), ("18340225-1",), ("abcd0225-1",)], "p string")
    assert [r.u.split("/san/")[1] for r in p.select(pointers.proceedings_url(F.col("p")).alias("u")).collect()] == ["oa/OA16760517/OA167605170001.jpg", "oa/OA16760517x/OA16760517x0001.jpg", "ob/1740s/17410225-1.gif", "ccc/18340225/18340225-1.jpg", "ccc/abcd0225/abcd0225-1.jpg"]


XML = """<t><xptr type="pageFacsimile" doc="d1"/><p>One  <i>two</i>, three <b>x</b>y</p><xptr type="other" doc="no"/><p>Next<xptr type="pageFacsimile" doc="d2"/>page</p></t>"""
HTML = """<div id="tab-opinion-1"><p>a</p></div><div id="tab-opinion-2"><div><p>x <b>y</b></p><p>z</p></div><p><a class="page-number" name="7">*7</a>seven</p><p><a class="page-number">Page 10 U. S. 8</a>eight</p><ul></ul><p>[cut] kept</p></div><p>out</p>"""


def test_markup(spark):
    xml = spark.createDataFrame([("f", XML)], "name string, text string")
    assert sorted((r.at, r.ptr) for r in markup.xml_pointers(xml).collect()) == [(0, "d1"), (1, "d2")]
    assert sorted(map(tuple, markup.xml_pages(xml).collect())) == [("d1", "One  two , three x  y\n Next "), ("d2", "page")]
    files = spark.createDataFrame([("001us006", HTML)], "name string, html string")
    got = sorted(tuple(r)[1:] for r in markup.html_pages(files, first_page=F.lit("6")).collect())
    assert got == [(0, "6", "a"), (1, "6", "x y\nz"), (1, "7", "seven"), (1, "8", "eight\n] kept")]
    got = markup.html_pages(files, first_page=F.lit("6"), records=2).select("page", markup.page_file_name().alias("f")).collect()
    assert sorted((r.page, r.f) for r in got) == [("6", "001us006-000"), ("7", "001us006-001"), ("8", "001us006-002")]
    with pytest.raises(Exception, match="unexpected number of records"):
        markup.html_pages(files, records=3).collect()


def test_markup_errors(spark):
    rows = [("good", HTML), ("odd", '<div id="tab-opinion-1"><p>a <table>b</table> <l=|x>c<br></p></div><table>'), ("open", '<div id="tab-opinion-1"><em>a<p>b</div>'), ("text", '<div id="tab-opinion-1"><p>mark <h> here</p></div>'), ("none", None)]
    files = spark.createDataFrame(rows, "name string, html string")
    assert sorted(map(tuple, markup.html_errors(files).collect())) == [("odd", "a tag that is not known: table"), ("open", "a tag that is not balanced: em 1")]
    assert sorted(map(tuple, markup.tag_balance(files).collect())) == [("open", "em", 1), ("open", "p", 1)]
    assert markup.html_pages(files.where("name = 'text'")).first().text == "mark <h> here"


def articles(html):
    """The paragraphs of the articles, by cutting the page at its tags."""
    html = re.sub(r"(?s)<!--.*?-->", "", html)
    html = re.sub(r"(?s)(<(script|style)\b[^>]*>).*?</\2>", r"\1", html)
    out, depth, inside, fresh = [], 0, False, False
    for piece in re.split(r"(<[^>]*>)", html):
        if m := re.match(r"<(/?)(\w+)", piece):
            end, tag = m[1] == "/", m[2].lower()
            if tag == "article":
                if not end and not depth:
                    out.append("")
                    inside = False
                depth += -1 if end else 1
            elif tag == "p" and depth:
                inside, fresh = not end, not end
        elif depth and inside and piece and not piece.startswith("<"):
            out[-1] += ("\n" if fresh and out[-1] else "") + unescape(piece).replace("\r", "")
            fresh = False
    return out


def test_html_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted((r.page_id, i, "1", t) for r in pages.collect() for i, t in enumerate(articles(r.html)) )
    got = sorted(tuple(r) for r in markup.html_pages(pages, "page_id", "html", tag="article", prefix=None).collect())
    assert len(got) > 100 and got == want


def test_readers_sinks_and_stream(spark, tmp_path):
    a = answer(spark, "Azure", {"regions": [{"boundingBox": "", "lines": [{"boundingBox": "", "words": [{"text": "hi"}]}]}]}).withColumn("provider", F.lit("azu"))
    sinks.results(a, f"{tmp_path}/out")
    again = readers.replay(spark, f"{tmp_path}/out")
    assert convert.to_detections(again).select(layout.plain_text(F.col("blocks")).alias("t")).first().t == "hi"
    a.write.json(f"{tmp_path}/in")
    query = ingest.ingest(ingest.page_texts(ingest.answers(spark, f"{tmp_path}/in")), f"{tmp_path}/texts", f"{tmp_path}/state", once=True)
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/texts").select("ptr", "provider", "txt").first() == ("p-0", "azu", "hi")
    log = spark.createDataFrame([("a.aws.json:5",), ("a.aws.json:7",)], "value string").coalesce(1)
    assert readers.timings(log).collect() == [("a", "aws", 7)]
    with pytest.raises(Exception, match="not a timing"):
        readers.timings(spark.createDataFrame([("a.b.c.json:5",)], "value string")).collect()


class Fake:
    key = "fake"

    def run(self, image):
        if not image:
            raise ValueError("no image")
        return {"service": "Azure", "version": "1", "text": "t", "milliseconds": len(image), "date": "d", "raw": b"{}"}


def test_recognise(spark):
    pages = spark.createDataFrame([("p", b"abc"), ("q", b"")], "ptr string, content binary")
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__(__name__))
    got = {r.ptr: (r.milliseconds, r.error) for r in recognisers.recognise(pages, [Fake()]).collect()}
    assert got == {"p": (3, None), "q": (None, "no image")}


def test_credentials_and_cost(tmp_path):
    (tmp_path / "c.json").write_text('{"endpoint": "e", "subscription_key": "k", "more": 1}')
    assert recognisers.credentials(f"{tmp_path}/c.json") == {"endpoint": "e", "subscription_key": "k"}
    (tmp_path / "d.json").write_text('{"endpoint": ""}')
    with pytest.raises(ValueError, match="endpoint and subscription_key"):
        recognisers.credentials(f"{tmp_path}/d.json")
    assert recognisers.cost(20, 4) == pytest.approx(0.12)


def test_first_and_last_in_one_shuffle(spark):
    rows = spark.createDataFrame([("a", "3"), ("a", "1"), ("b", "2"), ("a", "2")], "txt string, ptr string")
    both = sets.first_and_last(rows, "txt", "ptr", "seen", "ptr")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, both.collect())) == [("a", "3", "1"), ("b", "2", "2")] and both.columns == ["txt", "ptr", "seen"]


def test_pixels_are_told_apart_by_numbers(spark):
    """Outlines that meet and cross give each pixel once, and no struct is compared with all others."""
    shape = spark.createDataFrame([(1, 0, 0, 9, 9)], "id int, a int, b int, c int, d int")
    a, b, c, d = (F.col(x) for x in "abcd")
    drawn = raster.drawn(shape, ["id"], raster.polygon((a, b), (c, d), (a, d), (c, b)), 8, 8)
    got = [(r.x, r.y) for r in drawn.collect()]
    assert len(got) == len(set(got)) and set(got) == {p for i in range(8) for p in ((i, i), (i, 0))} | {(9 - i, i) for i in range(2, 8)}
    assert drawn.schema["x"].dataType.simpleString() == drawn.schema["y"].dataType.simpleString() == "bigint"
    assert "array_distinct(transform(" in drawn._jdf.queryExecution().optimizedPlan().toString()
