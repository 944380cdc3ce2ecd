"""The events of marked-up files: the same whatever portions the parser is given, and in flat memory."""

import tracemalloc
from html.parser import HTMLParser
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspan.sources import markup

PIECES = ["<p>", "</p>", "<a class='page-number' name=\"7\">", "<!--", "-->", "<script>", "</script>", "<", ">", "&", "&amp;", "&am", ";", "x y", "\n", "<b", "/>", "'", '"', "<![CDATA[", "]]>", "<?x", "</", "<title>", "</title>", "é"]


def whole(html):
    """The events of a parser that is given all at once."""
    out = []

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            first = {}
            for k, v in attrs:
                first.setdefault(k, v)
            out.append(("start", tag, first.get("id"), first.get("class"), (first["name"] or "") if "name" in first else None, None))

        def handle_endtag(self, tag):
            out.append(("end", tag, None, None, None, None))

        def handle_data(self, data):
            out.append(("text", None, None, None, None, data))

    parser = Parser()
    parser.feed(html)
    parser.close()
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), st.integers(1, 9))
def test_html_portions_change_nothing(html, portion):
    assert list(markup.html_stream(html, portion)) == whole(html)


def tree_events(e, parent=None, depth=0):
    """The events of a whole tree."""
    yield "start", e.tag, e.get("type"), e.get("doc"), parent, depth, e.text
    for child in e:
        yield from tree_events(child, e.tag, depth + 1)
    yield "end", e.tag, None, None, parent, depth, e.tail


NODES = st.recursive(
    st.sampled_from(["", "a", " b\n", "&amp;", "<!-- c -->d", "<x/>", "<xptr type='pageFacsimile' doc='7'/>e"]),
    lambda inner: st.tuples(st.sampled_from("pqr"), st.lists(inner, max_size=4)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0]}>"),
    max_leaves=15,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(NODES, max_size=4).map("".join), st.integers(1, 9))
def test_xml_portions_change_nothing(inner, portion):
    xml = f"<t>{inner}</t>"
    assert list(markup.xml_stream(xml, portion)) == list(tree_events(ElementTree.fromstring(xml)))


@pytest.mark.parametrize("stream, text", [(markup.html_stream, "<p class='c'>some words</p>\n" * 200_000), (markup.xml_stream, "<t>" + "<p>some <i>more</i> words</p>\n" * 200_000 + "</t>")])
def test_flat_memory(stream, text):
    tracemalloc.start()
    n = sum(1 for _ in stream(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 600_000 and peak < 4_000_000


def test_long_comment_is_read_in_growing_portions():
    assert [e[0] for e in markup.html_stream("<!--" + "<x" * 200_000 + "--><p>", 16)] == ["start"]


def test_large_file_in_batches(spark):
    files = spark.createDataFrame([(1, "<p>a</p>" * 20_000), (2, "<b>"), (3, ""), (None, None)], "page_id long, html string")
    rows = markup.html_events(files, "page_id", "html")
    got = {r._file: (r.n, r.least, r.most, r.apart) for r in rows.groupBy("_file").agg(F.count("*").alias("n"), F.min("at").alias("least"), F.max("at").alias("most"), F.countDistinct("at").alias("apart")).collect()}
    assert got == {1: (60_000, 0, 59_999, 60_000), 2: (1, 0, 0, 1)}
    assert rows.schema["_file"].dataType.simpleString() == "bigint"
    assert {r.p for r in rows.where("at % 3 = 1").select(F.pmod("at", F.lit(3)).alias("p"), "text").distinct().collect()} == {1}


def test_bad_xml_is_an_error(spark):
    files = spark.createDataFrame([("f", "<t><p>x</t>")], "name string, text string")
    with pytest.raises(Exception, match="mismatched tag"):
        markup.xml_events(files).collect()
    empty = spark.createDataFrame([("e", ""), ("n", None)], "name string, text string")
    assert markup.xml_events(empty).count() == 0


def test_tasks_grow_with_the_files(spark, monkeypatch):
    """Events of more bytes are dealt out to more tasks, a file's to one."""
    files = spark.createDataFrame([(i, "<p>word</p>") for i in range(60)], "name int, html string")
    monkeypatch.setattr(markup, "SHARE", 33)
    events = markup._dealt(files, "html", markup.html_events(files))
    assert events.rdd.getNumPartitions() == 20
    assert events.groupBy("_file").count().where("count <> 3").count() == 0
