"""Synthetic providers over ``documents``: what four recognisers would have answered.

A document is a file whose lines are its pages. Each provider misreads in its own way and fails on pages with
a certain character; failed pages have no row. For converters, five lines are a printed page with word boxes,
written as each provider's payload.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from json.encoder import encode_basestring as quoted

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.text import page_pointer

PROVIDERS = ["aws", "azu", "azuR", "gcp"]
LINES_A_PAGE = 5
#: Pixels of a printed page, both ways.
SIZE = 100_000
#: Bytes of text whose payloads are written at once and make a batch, about; they have up to some 31 times as many.
TEXT = 1 << 16
#: Bytes of text that a task has at most, about.
DEALT = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` dealt out by id: what follows costs far more time than bytes, and files are cut by bytes. Tasks grow in number with
    the texts: a batch of 10,000 answers, as Spark hands them to Python, has hundreds of megabytes."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // DEALT)), "doc_id")


def truth(docs: DataFrame) -> DataFrame:
    """(doc_id, page, ptr, truth): a page for each line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.select("doc_id", F.size(lines).alias("pages"), F.posexplode(lines).alias("page", "truth"))
    return rows.select("doc_id", "page", page_pointer(F.col("doc_id"), F.col("page"), F.col("pages")).alias("ptr"), "truth")


def page_text(docs: DataFrame, with_truth: bool = False) -> DataFrame:
    """(ptr, provider, txt, millis): what each provider read; with_truth: the file's own text too, as provider "". Narrow."""
    t, t0 = truth(docs), F.col("truth")
    millis = lambda f: (F.col("doc_id") * f + F.col("page") * 101 + F.length(t0)) % 12000
    cell = lambda p, txt, f, works: F.struct(F.lit(p).alias("provider"), txt.alias("txt"), millis(f).alias("millis"), works.alias("works"))
    own = [F.struct(F.lit("").alias("provider"), t0.alias("txt"), F.lit(0).cast("long").alias("millis"), F.lit(True).alias("works"))] if with_truth else []
    every = F.array(
        *own,
        cell("aws", F.replace(t0, F.lit("rn"), F.lit("m")), 37, ~F.contains(t0, F.lit("@"))),
        cell("azu", F.translate(t0, "lo", "10"), 53, ~F.contains(t0, F.lit("#"))),
        cell("azuR", F.replace(t0, F.lit(" the "), F.lit(" tbe ")), 71, ~F.contains(t0, F.lit("$"))),
        cell("gcp", F.replace(t0, F.lit("ee"), F.lit("e")), 97, t0 != ""),
    )
    return t.select("ptr", F.inline(every)).where("works").drop("works")


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, line_ix, word_ix, word, x, y, w, h) of every word. Narrow."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_ix", "line"))
    rows = lines.select("doc_id", "line_ix", F.posexplode(F.filter(F.split("line", " ", -1), lambda w: w != "")).alias("word_ix", "word"))
    n = F.length("word")
    return rows.select("doc_id", "line_ix", "word_ix", "word", (F.col("word_ix") * 60).cast("long").alias("x"), (F.col("line_ix") * 24 + n % 5).cast("long").alias("y"), (n * 9).cast("long").alias("w"), (n % 7 + 10).cast("long").alias("h"))


def printed(docs: DataFrame) -> DataFrame:
    """(doc_id, page, lines): five lines a page; a line is struct(x, y, w, h, words) with words alike."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    first = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(LINES_A_PAGE))
    pages = docs.select("doc_id", lines.alias("ls"), F.explode(first).alias("first"))
    size = lambda w: F.length(w)

    def line(text: Column, i: Column) -> Column:
        top = ((F.col("first") + i) * 24).cast("long")
        every = F.filter(F.split(text, " ", -1), lambda w: w != "")
        word = lambda w, j: F.struct((j * 60).cast("long").alias("x"), (top + size(w) % 5).alias("y"), (size(w) * 9).cast("long").alias("w"), (size(w) % 7 + 10).cast("long").alias("h"), w.alias("text"))
        return F.struct(F.lit(0).cast("long").alias("x"), top.alias("y"), (F.size(every) * 60).cast("long").alias("w"), F.lit(24).cast("long").alias("h"), F.transform(every, word).alias("words"))

    made = F.transform(F.slice("ls", F.col("first") + 1, LINES_A_PAGE), line)
    return pages.select("doc_id", F.expr(f"first div {LINES_A_PAGE}").cast("int").alias("page"), made.alias("lines"))


def printed_text(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text): the words of ``printed``, joined by blanks and line feeds, without their boxes. A text is cut into lines once."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    line = lambda t: F.array_join(F.filter(F.split(t, " ", -1), lambda w: w != ""), " ")
    page = lambda ls, first: F.array_join(F.transform(F.slice(ls, first + 1, LINES_A_PAGE), line), "\n")
    pages = lambda ls: F.transform(F.sequence(F.lit(0), F.size(ls) - 1, F.lit(LINES_A_PAGE)), lambda first: page(ls, first))
    return docs.select("doc_id", F.posexplode(F.get(F.transform(F.array(lines), pages), F.lit(0))).alias("page", "text"))


def _cat(*parts: str | np.ndarray | pa.Array) -> pa.Array:
    """Numbers and texts of each row put together."""
    return pc.binary_join_element_wise(*[pa.array(p).cast(pa.string()) if isinstance(p, np.ndarray) else p for p in parts], "")


def _lists(at: np.ndarray, items: pa.Array, between: str) -> pa.Array:
    """Texts of each list put together; ``at`` is where lists begin and the last ends."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), items), between)


def _made(keys: pa.Array, make: Callable) -> pa.Array:
    """``make`` of each key, worked out once for equal ones."""
    each = keys.dictionary_encode()
    return pa.array([make(k) for k in each.dictionary.to_pylist()], pa.string()).take(each.indices)


#: Which bytes JSON escapes.
_ESCAPED = np.array([b < 32 or chr(b) in '"\\' for b in range(256)])


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and the last ends, and the bytes of all."""
    _, at, data = texts.buffers()
    return np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1] if at else np.zeros(1, np.int32), np.frombuffer(data or b"", np.uint8)


def _inner(texts: pa.Array) -> pa.Array:
    """Texts as JSON, without quotes."""
    at, data = _utf8(texts)
    odd = at[0] + np.flatnonzero(_ESCAPED[data[at[0] : at[-1]]])
    if not odd.size:
        return texts
    odd = np.unique(np.searchsorted(at, odd, "right") - 1)
    mask = np.zeros(len(texts), bool)
    mask[odd] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array([quoted(t)[1:-1] for t in texts.take(pa.array(odd)).to_pylist()], pa.string()))


class _Printed:
    """Printed pages as columns: ``of_lines`` and ``of_words`` say where each page's lines and each line's words begin; ``line`` and
    ``word`` are their boxes (x, y, w, h), ``texts`` the words' readings, ``inner`` the same as JSON without quotes."""

    def __init__(self, of_lines: np.ndarray, line_ix: np.ndarray, of_words: np.ndarray, size: np.ndarray, texts: pa.Array):
        n = np.diff(of_words)
        self.of_lines, self.of_words, self.texts, self.inner = of_lines, of_words, texts, _inner(texts)
        self.line_at, self.at = line_ix % LINES_A_PAGE, np.arange(len(size)) - np.repeat(of_words[:-1], n)
        self.word_line = np.repeat(self.line_at, n)
        self.line = 0 * n, 24 * line_ix, 60 * n, 0 * n + 24
        self.word = 60 * self.at, 24 * np.repeat(line_ix, n) + size % 5, 9 * size, size % 7 + 10
        self.line_text = _lists(of_words, self.inner, " ")


def _azure(p: _Printed) -> pa.Array:
    box = lambda x, y, w, h: ('{"boundingBox":"', x, ",", y, ",", w, ",", h)
    words = _lists(p.of_words, _cat(*box(*p.word), '","text":"', p.inner, '"}'), ",")
    lines = _lists(p.of_lines, _cat(*box(*p.line), '","words":[', words, "]}"), ",")
    return _cat(f'{{"language":"unk","regions":[{{"boundingBox":"0,0,{SIZE},{SIZE}","lines":[', lines, "]}]}")


def _azure_read(p: _Printed) -> pa.Array:
    def box(x, y, w, h):
        left, top, right, bottom = [_cat(v) for v in (x, y, x + w, y + h)]
        return '{"boundingBox":[', left, ",", top, ",", right, ",", top, ",", right, ",", bottom, ",", left, ",", bottom, '],"text":"'

    words = _lists(p.of_words, _cat(*box(*p.word), p.inner, '","confidence":0.5}'), ",")
    lines = _lists(p.of_lines, _cat(*box(*p.line), p.line_text, '","words":[', words, "]}"), ",")
    return _cat(f'{{"status":"succeeded","analyzeResult":{{"version":"3.1","readResults":[{{"page":1,"width":{SIZE},"height":{SIZE},"lines":[', lines, "]}]}}")


def _poly(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple:
    """Zeros are left out."""
    unless = lambda zero, text: pc.if_else(pa.array(zero), "", text) if zero.any() else text
    side = lambda name, v: unless(v == 0, _cat(f'"{name}":', v))
    comma = lambda x, y: unless((x == 0) | (y == 0), ",")
    xs, ys = [(v, side("x", v)) for v in (x, x + w)], [(v, side("y", v)) for v in (y, y + h)]
    corner = lambda i, j: (xs[i][1], comma(xs[i][0], ys[j][0]), ys[j][1])
    return '{"bounding_box":{"vertices":[{', *corner(0, 0), "},{", *corner(1, 0), "},{", *corner(1, 1), "},{", *corner(0, 1), "}]},"


def _symbols(texts: pa.Array) -> pa.Array:
    """An object for each character, with commas between."""
    at, data = _utf8(texts)
    first = (data[: at[-1]] & 0xC0) != 0x80
    starts = np.append(np.flatnonzero(first), at[-1]).astype(np.int32)
    characters = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), texts.buffers()[2])
    of_texts = np.concatenate([[0], np.cumsum(first)])[at]
    made = _cat('{"text":"', _lists(of_texts, _inner(characters), '"},{"text":"'), '"}')
    return pc.if_else(pa.array(np.diff(at) == 0), "", made)


def _gcp(p: _Printed) -> pa.Array:
    words = _lists(p.of_words, _cat(*_poly(*p.word), '"symbols":[', _symbols(p.texts), "]}"), ",")
    lines = _lists(p.of_lines, _cat(*_poly(*p.line), '"words":[', words, "]}"), ",")
    n = np.array([0])
    block = _cat(*_poly(n, n, n + SIZE, n + SIZE))[0].as_py()
    return _cat(f'{{"pages":[{{"blocks":[{block}"paragraphs":[', lines, ']}]}],"text":"', _lists(p.of_lines, p.line_text, "\\n"), '"}')


def _aws(p: _Printed) -> pa.Array:
    part = lambda v: _made(pa.array(v), lambda u: repr(u / SIZE))
    box = lambda x, y, w, h: ('"Geometry":{"BoundingBox":{"Left":', x, ',"Top":', y, ',"Width":', w, ',"Height":', h, "}}")
    child = lambda ids: (',"Relationships":[{"Type":"VALUE","Ids":["none"]},{"Type":"CHILD","Ids":[', ids, "]}]}")
    ids = _cat('"W', p.word_line, "_", p.at, '"')
    words = _cat('{"BlockType":"WORD","Id":', ids, ',"Text":"', p.inner, '",', *box(*[part(v) for v in p.word]), "}")
    lines = _cat('{"BlockType":"LINE","Id":"L', p.line_at, '","Text":"', p.line_text, '",', *box(*[part(v) for v in p.line]), *child(_lists(p.of_words, ids, ",")))
    page = '{"BlockType":"PAGE","Id":"P",', *box("0.0", "0.0", "1.0", "1.0"), *child(_lists(p.of_lines, _cat('"L', p.line_at, '"'), ","))
    of_words = p.of_words[p.of_lines]
    more = pc.if_else(pa.array(np.diff(of_words) > 0), ",", "")
    return _cat('{"Blocks":[', *page, ",", _lists(p.of_lines, lines, ","), more, _lists(of_words, words, ","), "]}")


_PAYLOAD: dict[str, Callable[[_Printed], pa.Array]] = {"AWS": _aws, "Azure": _azure, "AzureRead": _azure_read, "GCP": _gcp}


def _split(texts: pa.Array, by: str) -> tuple[np.ndarray, pa.Array]:
    found = pc.split_pattern(texts, by)
    at = found.offsets.to_numpy()
    return at - at[0], found.flatten()


def _pages(texts: pa.Array, reads: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, _Printed]]:
    """(row, page, what is printed) of the rows' pages, for so many that their texts have about ``most`` bytes."""
    (of_rows, lines), (_, readings) = _split(texts, "\n"), _split(reads, "\n")
    n = np.diff(of_rows)
    row, line_ix = np.repeat(np.arange(len(n)), n), np.arange(len(lines)) - np.repeat(of_rows[:-1], n)
    first = np.flatnonzero(line_ix % LINES_A_PAGE == 0)
    end = np.append(first[1:], len(lines))
    done = np.cumsum(pc.binary_length(lines).to_numpy())[end - 1] // most
    cuts = [0, *(np.flatnonzero(np.diff(done)) + 1), len(first)]
    for a, b in pairwise(cuts):
        begin, stop = first[a], end[b - 1]
        (at, words), (same, read) = [_split(x[begin:stop], " ") for x in (lines, readings)]
        if not (at == same).all():
            raise ValueError("a misreading changes where words begin")
        there = pc.not_equal(words, "")
        at = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[at]
        size = pc.utf8_length(words.filter(there)).to_numpy().astype(int)
        yield row[first[a:b]], line_ix[first[a:b]] // LINES_A_PAGE, _Printed(np.append(first[a:b], stop) - begin, line_ix[begin:stop], at, size, read.filter(there))


#: How each provider misreads a word.
MISREAD = {
    "aws": lambda w: F.replace(w, F.lit("rn"), F.lit("m")),
    "azu": lambda w: F.translate(w, "lo", "10"),
    "azuR": lambda w: F.replace(w, F.lit("the"), F.lit("tbe")),
    "gcp": lambda w: F.replace(w, F.lit("ee"), F.lit("e")),
}


def answers(docs: DataFrame, service: str, misread=lambda w: w) -> DataFrame:
    """(doc_id, page, envelope...) of every printed page, as one provider's JSON. Narrow.

    Misreadings are of characters within words, so the whole text is misread at once. The JSON is put together by Arrow, column by
    column, of ``TEXT`` bytes of text at a time: of many documents, or of some of one's pages.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("raw", pa.binary())])

    def write(batches):
        for b in batches:
            doc, text, read = b.columns
            done = np.cumsum(pc.binary_length(text).to_numpy()) // TEXT
            for start, stop in pairwise([0, *(np.flatnonzero(np.diff(done)) + 1), b.num_rows] if b.num_rows else []):
                part = slice(start, stop)
                for row, page, printed in _pages(text[part], read[part], TEXT):
                    columns = doc[part].take(pa.array(row)), pa.array(page, pa.int32()), _PAYLOAD[service](printed).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    text = F.coalesce("text", F.lit(""))
    made = docs.select("doc_id", text.alias("text"), misread(text).alias("read")).mapInArrow(write, "doc_id bigint, page int, raw binary")
    return made.select("doc_id", "page", F.lit(service).alias("service"), F.lit("V 1.0").alias("version"), F.lit("").alias("text"), (F.col("doc_id") * 37 + 5_000_000_000).alias("milliseconds"), F.lit("2020-01-02 03:04:05 UTC").alias("date"), "raw")


def damaged(answers: DataFrame) -> DataFrame:
    """Some answers spoilt, by document and page: cut off, refused, of an unknown service, or with blocks that don't fit."""
    raw, k = F.col("raw").cast("string"), (F.col("doc_id") * 7 + F.col("page")) % 10
    of = lambda service: F.col("service") == service
    spoilt = (
        F.when(k == 1, F.left(raw, F.length(raw) - 2))
        .when((k == 2) & of("AWS"), F.replace(raw, F.lit('"BlockType":"PAGE"'), F.lit('"BlockType":"CELL"')))
        .when((k == 2) & of("Azure"), F.replace(raw, F.lit('{"language"'), F.lit('{"code":"Busy","language"')))
        .when((k == 2) & of("GCP"), F.replace(raw, F.lit('"vertices":[{'), F.lit('"vertices":[{},{')))
        .when((k == 3) & of("AWS"), F.replace(raw, F.lit('"Id":"L0"'), F.lit('"Id":"LX"')))
        .when((k == 4) & of("AWS"), F.replace(raw, F.lit('"Id":"W0_0"'), F.lit('"Id":"WX"')))
        .when((k == 6) & of("AWS"), F.replace(raw, F.lit('"Type":"VALUE"'), F.lit('"Type":"ODD"')))
        .otherwise(raw)
    )
    return answers.withColumns({"raw": spoilt.cast("binary"), "provider": F.col("service"), "service": F.when(k == 5, "Other").otherwise(F.col("service"))})
