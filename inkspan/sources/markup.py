"""Page texts out of marked-up opinions and proceedings.

A parser of the standard library, which is all that runs in Python, turns each file into a flow of events, a row
each: tags opened and closed, and the text between them. The parser is given a portion of the file at a time and its
events leave it in batches, so that a file of any length takes the memory of its text. What the events mean is derived
by DataFrame expressions: open elements, records, pages and footnotes are running sums and last values over a file's
events in order, and Spark spills windows that are too large.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import islice
from xml.etree.ElementTree import XMLPullParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

#: Nesting that is followed, and the mark of a new page, in proceedings.
DEPTH = 50
FACSIMILE = "pageFacsimile"
#: Fixed values of opinions: tags that count, tags that may stay open, tags that are passed over, tags that are text,
#: and how a tag begins that is a slip of the pen.
COUNTED = ("div", "strong", "p", "em", "h2", "h3", "a", "b")
SLOPPY = ("p", "a", "b")
PASSED = ("span", "br", "ul", "font", "symbol", "s")
LITERAL = ("ra", "k", "h")
SLIP = "l=|"
#: The class of an anchor that turns the page, and the marks before a page's number in its text.
PAGE_ANCHOR = "page-number"
NUMBER_MARKS = ("U.S.", ",")

_HTML = "kind string, tag string, id string, class string, name string, text string"
_XML = "kind string, tag string, type string, doc string, parent string, depth int, text string"
#: Characters that a parser is given at once, about, and events in a batch of rows.
PORTION, EVENTS = 1 << 16, 4096
#: Bytes of files whose events one task sorts, about.
SHARE = 1 << 22
#: White space as Python's split() sees it.
_BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


class _Tags(HTMLParser):
    """The events of a file in order; who feeds it takes them away."""

    def __init__(self):
        super().__init__()
        self.events: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        first = dict(reversed(attrs))
        name = (first["name"] or "") if "name" in first else None
        self.events.append(("start", tag, first.get("id"), first.get("class"), name, None))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, None, None, None, None))

    def handle_data(self, data):
        self.events.append(("text", None, None, None, None, data))


def html_stream(html: str, portion: int = PORTION) -> Iterator[tuple]:
    """The events of a file, of which the parser is given a portion at a time. Portions end before a ``<``, where texts end
    too, so their size changes no event; a portion without an event (a long comment) is followed by twice as much."""
    parser, at, step = _Tags(), 0, portion
    while at < len(html):
        cut = html.find("<", at + step)
        cut = len(html) if cut < 0 else cut
        parser.feed(html[at:cut])
        at, step = cut, portion if parser.events else 2 * step
        yield from parser.events
        parser.events.clear()
    parser.close()
    yield from parser.events


def xml_stream(xml: str, portion: int = PORTION) -> Iterator[tuple]:
    """The events of a file, of which the parser is given a portion at a time.

    An element's own text and what follows its end are known when the next event is, so each event waits for the next;
    elements that have ended are taken out of the tree.
    """
    above, held = [], None
    for kind, e in _pulled(xml, portion):
        if held:
            yield _xml_event(*held)
            if held[0] == "end" and above:
                above[-1].remove(held[1])
        if kind == "end":
            above.pop()
        held = (kind, e, above[-1].tag if above else None, len(above))
        if kind == "start":
            above.append(e)
    if held:
        yield _xml_event(*held)


def _pulled(xml: str, portion: int) -> Iterator[tuple]:
    parser = XMLPullParser(["start", "end"])
    for at in range(0, len(xml), portion):
        parser.feed(xml[at : at + portion])
        yield from parser.read_events()
    if xml:
        parser.close()
    yield from parser.read_events()


def _xml_event(kind, e, parent, depth) -> tuple:
    if kind == "start":
        return kind, e.tag, e.get("type"), e.get("doc"), parent, depth, e.text
    return kind, e.tag, None, None, parent, depth, e.tail


def _events(files: DataFrame, key: str, text: str, stream: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """(_file, at, event's fields) of each file; _file is the key. Rows leave the parser in batches of ``EVENTS``, so a
    task holds the files it was handed and one batch, never a file's events."""
    rows = files.select(F.col(key).alias("_file"), F.col(text).cast("string").alias("_text"))
    schema = StructType([rows.schema["_file"], StructField("at", IntegerType()), *StructType.fromDDL(fields)])
    types = to_arrow_schema(schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                events, at = stream(b.column(1)[i].as_py() or ""), 0
                while part := list(islice(events, EVENTS)):
                    columns = [b.column(0).take(pa.array([i] * len(part))), pa.array(range(at, at + len(part)))]
                    columns += [pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), list(types)[2:], strict=True)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, types, strict=True)], schema=types)
                    at += len(part)

    return rows.mapInArrow(make, schema)


def html_events(files: DataFrame, key: str = "name", text: str = "html") -> DataFrame:
    """(_file, at, kind, tag, id, class, name, text): tags opened (start) and closed (end) and text, in order."""
    return _events(files, key, text, html_stream, _HTML)


def _dealt(files: DataFrame, text: str, events: DataFrame) -> DataFrame:
    """Events dealt out by file, to as many tasks as there are bytes for."""
    size = files.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first().n or 0
    return events.repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE)), "_file")


def xml_events(files: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """(_file, at, kind, tag, type, doc, parent, depth, text): at an element's start its first text, at its end what follows
    it; depth 0 is the root. XML that can't be read is an error."""
    return _events(files, key, text, xml_stream, _XML)


def xml_pointers(files: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """(key, at, ptr): the pages' pointers of each file and their order."""
    rows = xml_events(files, key, text).where((F.col("kind") == "start") & _turns())
    return rows.select(F.col("_file").alias(key), (F.row_number().over(Window.partitionBy("_file").orderBy("at")) - 1).alias("at"), F.col("doc").alias("ptr"))


def _turns() -> Column:
    return (F.col("tag") == "xptr") & F.coalesce(F.col("type") == FACSIMILE, F.lit(False)) & F.col("depth").between(1, DEPTH)


def xml_pages(files: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """(doc, text): white space collapsed, a line for each paragraph. Text before the first page is dropped; of pages
    that are opened again, or that several files hold, the last one counts.

    A page's text is a fold of its pieces: what an element's start adds, and at its end what follows it and the
    cut of white space at both ends. Inside a paragraph, what follows a mark-up joins on if it begins with punctuation.
    """
    line = Window.partitionBy("_file").orderBy("at")
    rows = xml_events(files, key, text).where(F.col("depth").between(1, DEPTH))
    rows = rows.withColumn("visit", F.sum(F.when((F.col("kind") == "start") & _turns(), 1).otherwise(0)).over(line))
    rows = rows.withColumn("page", F.last(F.when((F.col("kind") == "start") & _turns(), F.col("doc")), ignorenulls=True).over(line))
    flatly = F.trim(F.regexp_replace("text", _BLANKS, " "))
    head = F.when((F.col("kind") == "start") & (F.col("tag") == "p"), "\n").otherwise("")
    first = F.when((F.col("kind") == "start") & F.col("text").isNotNull(), F.concat(F.lit(" "), flatly, F.lit(" "))).otherwise("")
    tail = F.when((F.col("kind") == "end") & (F.col("text") != ""), flatly)
    piece = F.struct("at", F.concat(head, first).alias("add"), tail.alias("tail"), F.coalesce(F.col("parent") == "p", F.lit(False)).alias("inside"), (F.col("kind") == "end").alias("ends"))
    pages = rows.where("page is not null").groupBy("_file", "visit", "page").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    def grow(acc: Column, p: Column) -> Column:
        joins = p["inside"] & ((F.trim(acc, F.lit(" \n")) == "") | (p["tail"] == "") | F.contains(F.lit(string.punctuation), F.left(p["tail"], F.lit(1))))
        space = F.when(p["tail"].isNotNull() & ~joins, " ").otherwise("")
        added = F.concat(acc, p["add"], space, F.coalesce(F.concat(p["tail"], F.lit(" ")), F.lit("")))
        return F.when(p["ends"], F.trim(added, F.lit(" \n"))).otherwise(added)

    pages = pages.select(F.col("page").alias("doc"), F.struct("_file", "visit").alias("order"), F.aggregate("pieces", F.lit(""), grow).alias("text"))
    return pages.groupBy("doc").agg(F.max_by("text", "order").alias("text"))


def _in_records(events: DataFrame, tag: str, prefix: str | None) -> DataFrame:
    """The events inside records, with record_ix. An element of ``tag`` whose id begins with ``prefix`` (None: any) that lies
    in no other such element is a record; its end belongs to it."""
    line = Window.partitionBy("_file").orderBy("at")
    start, end = (F.col("kind") == "start") & (F.col("tag") == tag), (F.col("kind") == "end") & (F.col("tag") == tag)
    wanted = start & (F.lit(True) if prefix is None else F.coalesce(F.startswith("id", F.lit(prefix)), F.lit(False)))
    rows = events.withColumn("step", F.when(start, 1).when(end, -1).otherwise(0))
    # at one level starts and ends take turns, so an end closes the start before it on its level
    rows = rows.withColumn("level", F.sum("step").over(line) + F.when(end, 1).otherwise(0))
    level = Window.partitionBy("_file", "level", F.col("step") != 0).orderBy("at")
    rows = rows.withColumn("wanted", wanted).withColumn("closes", end & F.coalesce(F.lag("wanted").over(level), F.lit(False)))
    opened = F.sum(F.when(F.col("wanted"), 1).when(F.col("closes"), -1).otherwise(0)).over(line)
    rows = rows.withColumn("open", opened)
    begins = F.col("wanted") & (F.col("open") == 1)
    rows = rows.withColumn("record_ix", F.sum(F.when(begins, 1).otherwise(0)).over(line) - 1)
    return rows.where("open > 0 or closes").drop("step", "level", "wanted", "closes", "open")


def tag_balance(files: DataFrame, key: str = "name", text: str = "html", tag: str = "div", prefix: str | None = "tab-opinion-") -> DataFrame:
    """(key, tag, open): of each counted tag in a file's records, how many more are opened than closed, where that isn't 0."""
    rows = _in_records(html_events(files, key, text), tag, prefix).where(F.col("tag").isin(*COUNTED))
    open_ = F.sum(F.when(F.col("kind") == "start", 1).otherwise(-1))
    return rows.groupBy(F.col("_file").alias(key), "tag").agg(open_.alias("open")).where("open <> 0")


def html_errors(files: DataFrame, key: str = "name", text: str = "html", tag: str = "div", prefix: str | None = "tab-opinion-") -> DataFrame:
    """(key, error): tags in records that are neither known nor passed over, tags that must be closed and aren't, and
    paragraphs that end, inside more open ones than there are open anchors, while a page number is still awaited."""
    rows = _in_records(html_events(files, key, text), tag, prefix)
    known = F.col("tag").isin(*COUNTED, *PASSED) | F.startswith("tag", F.lit(SLIP)) | ((F.col("kind") == "start") & F.col("tag").isin(*LITERAL))
    strange = rows.where((F.col("kind") != "text") & ~known).select(F.col("_file").alias(key), F.concat(F.lit("a tag that is not known: "), "tag").alias("error")).distinct()
    left = tag_balance(files, key, text, tag, prefix).where(~F.col("tag").isin(*SLOPPY))
    line = Window.partitionBy("_file").orderBy("at")
    is_start, is_end = (F.col("kind") == k for k in ("start", "end"))
    count = lambda t: F.sum(F.when(F.col("tag") != t, 0).when(is_start, 1).when(is_end, -1).otherwise(0)).over(line)
    asks = is_start & (F.col("tag") == "a") & F.coalesce(F.col("class") == PAGE_ANCHOR, F.lit(False)) & F.col("name").isNull()
    bare = F.replace("text", F.lit(" "), F.lit(""))
    answers = (F.col("kind") == "text") & (F.contains(bare, F.lit(NUMBER_MARKS[0])) | F.contains(bare, F.lit(NUMBER_MARKS[1])))
    rows = rows.withColumns({"open_p": count("p"), "open_a": count("a"), "waits": F.last(F.when(asks, True).when(answers, False), ignorenulls=True).over(line)})
    rows = rows.withColumn("level", F.last(F.when(asks, F.col("open_a")), ignorenulls=True).over(line))
    late = rows.where(is_end & (F.col("tag") == "p") & F.col("waits") & (F.col("level") < F.col("open_p")))
    strange = strange.union(late.select(F.col("_file").alias(key), F.lit("a page number was expected").alias("error")).distinct())
    return strange.union(left.select(key, F.concat_ws(" ", F.lit("a tag that is not balanced:"), "tag", F.col("open").cast("string")).alias("error")))


def html_pages(files: DataFrame, key: str = "name", text: str = "html", tag: str = "div", prefix: str | None = "tab-opinion-", first_page: Column | None = None, records: int | None = None) -> DataFrame:
    """(key, record_ix, page, text): the paragraphs of each record, by page; with ``records``, a file must have that many
    and its last one counts. Keys are the files' own.

    first_page: the page on which a file's records begin, by default 1. Anchors of class page-number turn the page: by
    their name, or else by what stands behind the mark in the text that follows; until such a text comes, text is left out,
    as is the anchor's own. A page that is opened again starts anew. After a list has ended footnotes follow, in which a text that
    begins with a bracket counts from the closing one. Tags of ``LITERAL`` were meant as text.
    """
    page_of = files.select(F.col(key).alias("_key"), (F.lit("1") if first_page is None else first_page).cast("string").alias("_first"))
    rows = _in_records(_dealt(files, text, html_events(files, key, text)), tag, prefix)
    record = Window.partitionBy("_file", "record_ix")
    line = record.orderBy("at")
    is_start, is_end, is_text = (F.col("kind") == k for k in ("start", "end", "text"))
    turner = is_start & (F.col("tag") == "a") & F.coalesce(F.col("class") == PAGE_ANCHOR, F.lit(False))
    state = lambda on, off: F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(line), F.lit(False))
    flag = lambda c: F.when(c, 1).otherwise(0)

    # page turns: by name at the anchor, by number at the first text that has a mark
    bare = F.replace("text", F.lit(" "), F.lit(""))
    mark = F.when(F.contains(bare, F.lit(NUMBER_MARKS[0])), NUMBER_MARKS[0]).when(F.contains(bare, F.lit(NUMBER_MARKS[1])), NUMBER_MARKS[1])
    number = F.when(is_text, F.get(F.split(bare, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")), -1), F.lit(1)))
    rows = rows.withColumn("asked", F.sum(flag(turner & F.col("name").isNull())).over(line)).withColumn("number", number)
    group = Window.partitionBy("_file", "record_ix", "asked")
    found = F.min(F.when((F.col("asked") > 0) & F.col("number").isNotNull(), F.col("at"))).over(group)
    rows = rows.withColumn("found", found)
    rows = rows.withColumn("turn", F.when(turner & F.col("name").isNotNull(), F.col("name")).when(F.col("at") == F.col("found"), F.col("number")))
    rows = rows.withColumns({"visit": F.sum(flag(F.col("turn").isNotNull())).over(line), "page": F.last("turn", ignorenulls=True).over(line)})

    waits = (F.col("asked") > 0) & (F.col("found").isNull() | (F.col("at") <= F.col("found")))
    rows = rows.withColumns({"paragraph": F.sum(flag(is_start & (F.col("tag") == "p"))).over(line), "in_p": state(is_start & (F.col("tag") == "p"), is_end & (F.col("tag") == "p")), "in_a": state(turner, is_end & (F.col("tag") == "a")), "notes": state(is_end & (F.col("tag") == "ul"), F.lit(False))})
    plain = F.replace("text", F.lit("\r"), F.lit(""))
    written = is_text & F.col("in_p") & ~F.col("in_a") & ~waits & (plain != "")
    kept = F.when(F.col("notes") & F.startswith(plain, F.lit("[")), F.when(F.contains(plain, F.lit("]")), F.substr(plain, F.position(F.lit("]"), plain))).otherwise("")).otherwise(plain)
    rows = rows.withColumn("written", written)
    rows = rows.withColumn("piece", F.when(F.col("written"), kept).when(is_start & F.col("tag").isin(*LITERAL), F.concat(F.lit("<"), "tag", F.lit(">"))).otherwise(""))
    visit = Window.partitionBy("_file", "record_ix", "visit").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.row_number().over(Window.partitionBy("_file", "record_ix", "paragraph", "written").orderBy("at")) == 1
    breaks = F.col("written") & fresh & (F.coalesce(F.max(flag(F.col("piece") != "")).over(visit), F.lit(0)) == 1)
    rows = rows.withColumn("piece", F.concat(F.when(breaks, "\n").otherwise(""), "piece"))
    pages = rows.groupBy("_file", "record_ix", "visit").agg(F.first("page", ignorenulls=True).alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("text"))
    pages = pages.join(page_of, F.col("_file").eqNullSafe(F.col("_key"))).withColumn("page", F.coalesce("page", "_first"))
    # the first page exists also where the record turns at once
    pages = pages.groupBy("_file", "record_ix", "page").agg(F.max_by("text", "visit").alias("text"))
    if records is None:
        return pages.withColumnRenamed("_file", key)
    rows = pages.withColumn("_last", F.max("record_ix").over(Window.partitionBy("_file")))
    right = F.when(F.col("_last") == records - 1, F.col("_last")).otherwise(F.raise_error(F.concat(F.lit("unexpected number of records in "), F.col("_file").cast("string"))))
    return rows.where(F.col("record_ix") == right).drop("_last").withColumnRenamed("_file", key)


def page_file_name(key: str = "name", page: str = "page") -> Column:
    """volus<case>-NNN: the place of a page after the case's first, for files named vol + us + page + .html."""
    vol, start = F.split_part(F.col(key), F.lit("us"), F.lit(1)), F.regexp_extract(F.split_part(F.col(key), F.lit("us"), F.lit(2)), r"^([0-9]+)", 1)
    return F.format_string("%sus%s-%03d", vol, start, (F.col(page).cast("int") - start.cast("int")))
