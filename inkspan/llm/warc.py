"""Web archives (WARC 1.1) without repeated payloads: revisit records point to one original response.

Headers alone are shuffled by payload digest: counts and the greatest page of each digest are added up before the
shuffle, and revisits join their original by a join that Spark can split. Payloads stay in the tasks that read
them, but for those of more than two million revisits, which are told apart by a shuffle of rows. Records are
strings that Spark's text writer ends with an empty line, as the format wants, so archives are committed as any
table is and may lie in any store that Spark knows; they are compressed files.

Reading goes by the same separator, the empty line with the next record's version. A payload may hold it too: the
record's length tells, and the pieces are put together again. So archives are read as they come, one record in
memory; compressed files aren't split, which keeps a file's pieces in order and in one task.

Defined cases: a null payload is empty; a null id or address is a header left out and null again when read; control
characters of an address are left out and spaces are written %20; of rows with equal payloads the one with the
greatest id, then address, is the response, null being the least; rows that repeat id, address and payload are one
response and revisits of it; payloads below ``least`` bytes are all responses; an empty table gives an archive
without records; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, once, row_key, without

#: Fixed values of the format.
END, VERSION = "\r\n\r\n", "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: What lies between two records, up to the minor version, which differs among archives.
BETWEEN = END + VERSION[:-1]
#: The header that carries a row's id.
PAGE = "X-Page-Id"
FIELDS = "kind string, record string, page string, url string, date string, digest string, refers string, payload binary"


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; those whose value is null are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")), F.lit("")) for name, v in pairs])


def _urn(*parts: Column) -> Column:
    """A record's name out of what makes it up."""
    known = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    h = F.md5(F.concat_ws("\n", *known).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _address(url: Column) -> Column:
    return F.replace(F.regexp_replace(url, r"[\x00-\x1F\x7F]", ""), F.lit(" "), F.lit("%20"))


def _response(least: int, date: str) -> Column:
    size = F.octet_length("payload")
    name = F.when(size >= least, _urn(F.lit("response"), F.col("page"), F.col("url"), F.col("digest"))).otherwise(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    http = F.concat(F.lit(HTTP_HEAD), size.cast("string"), F.lit(END))
    head = _lines(("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _address(F.col("url"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), (PAGE, F.col("page").cast("string")), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", (F.octet_length(http) + size).cast("string")))
    return F.concat(F.lit(VERSION + "\r\n"), head, F.lit("\r\n"), http, F.col("payload"))


def _revisit(date: str) -> Column:
    name = _urn(F.lit("revisit"), F.col("page"), F.col("url"), F.col("digest"), F.col("copy"))
    of = F.col("o.page"), F.col("o.url")
    refers = F.when(F.col("named"), _urn(F.lit("response"), *of, F.col("digest")))
    head = _lines(("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _address(F.col("url"))), ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", _address(of[1])), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), (PAGE, F.col("page").cast("string")), ("Content-Length", "0"))
    return F.concat(F.lit(VERSION + "\r\n"), head, F.lit("\r\n"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page, url, digest, size, payload) of pages, for ``write_archives``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"), payload.alias("payload"))


def write_archives(rows: DataFrame, path: str, least: int = 1000, date: str | None = None) -> None:
    """Archives of ``rows`` (page, url, digest, size, payload) in the folder ``path``.

    Of rows whose payloads are equal and have ``least`` bytes or more, one is a response and the others revisit it. A
    row without a payload is a revisit already, of whatever row has its digest.
    """
    scratch = Scratch(rows.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    full = F.col("payload").isNotNull()
    heads = rows.groupBy("page", "url", "digest", full.alias("full")).agg(F.max("size").alias("size"), F.count("*").alias("n"))
    heads = scratch.save(heads, "heads")
    o = heads.groupBy("digest").agg(F.max(F.when(F.col("full"), F.struct("page", "url"))).alias("o"), F.max("size").alias("bytes"), F.sum("n").alias("rows"), F.bool_or(~F.col("full")).alias("bare"))
    o = scratch.save(o.where((F.col("rows") > 1) & (F.col("bytes") >= least) | F.col("bare")).withColumn("named", F.col("o").isNotNull() & (F.col("bytes") >= least)), "originals")
    first = F.col("page").eqNullSafe(F.col("o.page")) & F.col("url").eqNullSafe(F.col("o.url"))
    more = F.when(~F.col("full"), F.col("n")).when(F.col("bytes") < least, 0).otherwise(F.col("n") - F.when(first, 1).otherwise(0))
    again = scratch.save(heads.join(o, "digest").withColumn("first", F.col("full") & first).withColumn("more", more), "again")
    revisits = again.where("more > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("more"))))

    k0, k1 = row_key(F.col("page"), F.col("url"), F.col("digest"))
    keyed = again.select("more", "first", "full", k0.alias("k0"), k1.alias("k1"))
    gone = scratch.save(keyed.where("full and more > 0 and not first").select("k0", "k1"), "gone")
    twice = scratch.save(keyed.where("first and more > 0").select("k0", "k1"), "twice")
    key = lambda d: row_key(d["page"], d["url"], d["digest"])
    kept = rows.where(full)
    kept = without(kept, key(kept), gone)
    if twice.limit(1).count():  # the response of rows that repeat
        kept = without(kept, key(kept), twice).unionByName(once(without(kept, key(kept), twice, how="left_semi"), row_key(F.col("page"), F.col("url"), F.col("digest"))))
    records = kept.select(_response(least, date).alias("value")).union(revisits.select(_revisit(date)))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)
    scratch.drop("heads", "originals", "again", "gone", "twice")


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by name in small letters; of names that repeat the last counts."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}


def _hex(digest: str | None) -> str | None:
    """A labelled digest's value in hex digits; archives may give it in base 32."""
    value = (digest or "").rpartition(":")[2]
    return (base64.b32decode(value).hex() if len(value) == 32 else value.lower()) or None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type")
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(END.encode())[2]
    payload = block if kind == "response" else None
    return kind, fields.get("warc-record-id"), fields.get(PAGE.lower()), fields.get("warc-target-uri"), fields.get("warc-date"), _hex(fields.get("warc-payload-digest")), fields.get("warc-refers-to"), payload


def parsed(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """The records in a file's pieces, which lie between the separators, from (file, piece) in order."""
    end, between = END.encode(), BETWEEN.encode()
    at, parts, fields, start, size, need = None, [], {}, 0, 0, -1
    for path, piece in pieces:
        if path != at and parts:
            raise ValueError(f"{at} ends inside a record")
        at = path
        if parts:  # the separator before this piece is part of a record
            parts.append(between)
            size += len(between)
        parts.append(piece)
        size += len(piece)
        if need < 0:
            held = b"".join(parts)
            parts, start = [held], held.find(end)
            if start < 0:
                continue
            fields, start = _fields(held[:start]), start + len(end)
            need = start + int(fields["content-length"])
        if size >= need:
            held = b"".join(parts)
            if held[need:] not in (b"", end):
                raise ValueError(f"a record of {at} is longer than its header says")
            yield _row(fields, held[start:need])
            parts, size, need = [], 0, -1
    if parts:
        raise ValueError(f"{at} ends inside a record")


def _records(batches):
    def pieces():
        for b in batches:
            for path, piece in zip(b.column(0), b.column(1), strict=True):
                yield path.as_py(), piece.as_py()

    rows, held = [], 0

    def batch():
        kinds = [pa.string()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=[f.split()[0] for f in FIELDS.split(", ")])

    for row in parsed(pieces()):
        rows.append(row)
        held += len(row[-1] or b"") + 500
        if held > 1 << 20:
            yield batch()
            rows, held = [], 0
    yield batch()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(kind, record, page, url, date, digest, refers, payload) of every record in a folder of compressed archives.

    A response's payload is what follows its HTTP header; digest is what the header says, in hex digits.
    """
    pieces = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_records, FIELDS)


def headers(records: DataFrame) -> DataFrame:
    """Records without payloads, with ``size`` and ``measured``: the payload's bytes and SHA-1."""
    return records.select(*[c for c in records.columns if c != "payload"], F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("measured"))


def resolved(heads: DataFrame) -> DataFrame:
    """(page, url, kind, payload_bytes, payload_digest, refers_to, intact) of every response and revisit.

    Revisits join the response that has their digest (of several the one with the greatest page): what they say is
    that response's payload, and refers_to its page; without one, all three are null but the digest. intact: the
    payload has the digest that the record says.
    """
    full = heads.where("kind = 'response'").select("page", "url", "kind", F.col("size").alias("payload_bytes"), F.col("measured").alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"), F.coalesce(F.col("measured") == F.col("digest"), F.lit(True)).alias("intact"))
    wanted = heads.where("kind = 'revisit'").select("digest").distinct()
    by_number = F.struct(F.length("page"), "page", "size")  # ids are digits here; longer ones are greater
    one = heads.where("kind = 'response'").withColumn("digest", F.col("measured")).join(wanted, "digest", "left_semi").groupBy("digest").agg(F.max(by_number).alias("o"))
    back = heads.where("kind = 'revisit'").join(one, "digest", "left")
    back = back.select("page", "url", "kind", F.col("o.size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("o.page").alias("refers_to"), F.col("o").isNotNull().alias("intact"))
    return full.unionByName(back)


def round_trip(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``, from archives that were written and read again: id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(pages.sparkSession)
    write_archives(responses(pages, id_col, url_col, payload_col), f"{scratch.root}/archives", least)
    heads = scratch.save(headers(read_archives(pages.sparkSession, f"{scratch.root}/archives")), "heads")
    scratch.drop("archives")
    kind = pages.schema[id_col].dataType
    return resolved(heads).select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "intact")
