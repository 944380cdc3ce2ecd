"""Columns over page text: byte distances, error rates, normalised names, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands tried before the whole edit matrix, as parts of the text's bytes; most readings differ in few.
BANDS = (1 / 64, 1 / 8)


def latin1(text: Column) -> Column:
    """A string with one character for each UTF-8 byte, so that character functions count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a: Column, b: Column, bands: tuple[float, ...] = BANDS) -> Column:
    """Edit distance in bytes, unit costs; null if either side is.

    Equal texts cost nothing, and bands of the matrix are tried before the whole; a distance within a band is
    exact, so the result is that of the whole matrix.
    """
    x, y = latin1(a), latin1(b)
    out = F.levenshtein(x, y)
    for part in reversed(bands):
        width = F.greatest(F.octet_length(a) * part, F.lit(8)).cast("int")
        within = F.get(F.array_remove(F.array(F.call_function("levenshtein", x, y, width)), -1), F.lit(0))
        out = F.coalesce(within, out)
    return F.when(a == b, F.lit(0)).otherwise(out)


def byte_levenshtein_within(a: Column, b: Column, most: int) -> Column:
    """The distance if it is at most ``most``, else -1; lengths are compared first."""
    far = F.abs(F.octet_length(a) - F.octet_length(b)) > most
    return F.when(far, F.lit(-1)).otherwise(F.levenshtein(latin1(a), latin1(b), most))


def error_rate(wrong: Column, total: Column) -> Column:
    """wrong / total as a double: 0 if nothing is wrong, 1 if something is wrong out of nothing."""
    return F.when(wrong == 0, F.lit(0.0)).when(total == 0, F.lit(1.0)).otherwise(wrong.cast("double") / total)


def cer(distance: Column, truth: Column) -> Column:
    """Character error rate against the truth's bytes; it may exceed 1."""
    return error_rate(distance, F.octet_length(truth))


def sanitized(text: Column) -> Column:
    """Lower case, every character but letters A-Z, digits and hyphens an underscore."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9-]", "_"))


def algorithm_id(service: Column, version: Column) -> Column:
    """The service's first three letters (AzureRead: all) and the version, sanitized."""
    short = F.when(service == "AzureRead", service).otherwise(F.substring(service, 1, 3))
    return sanitized(F.concat(short, F.lit("-"), version))


def colour_of(algorithm: Column) -> Column:
    """The colour that marks a provider's boxes; the first name that occurs decides."""
    low = F.lower(algorithm)
    return F.when(low.contains("aws"), "orange").when(low.contains("azu"), "blue").when(low.contains("gcp"), "red").otherwise("black")


def word_count(text: Column) -> Column:
    """Words between runs of Unicode white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_suffix(name: Column, suffix: str, legacy: bool = False) -> Column:
    """``name`` without ``.suffix``; legacy: trims any of these characters, and so may trim more."""
    if legacy:
        return F.call_function("rtrim", F.lit("." + suffix), name)
    return F.when(F.endswith(name, F.lit("." + suffix)), F.left(name, F.length(name) - len(suffix) - 1)).otherwise(name)


def page_pointer(name: Column, page: Column, pages: Column) -> Column:
    """name-NN: the page from 0, padded to the digits of the last page."""
    width = F.length((pages - 1).cast("string"))
    return F.concat(name.cast("string"), F.lit("-"), F.lpad(page.cast("string"), width, F.lit("0")))


def spelling_words(text: Column) -> Column:
    """The distinct words that a spelling check sees: long s as s, other non-ASCII dropped, marks as
    spaces, numbers left out."""
    plain = F.regexp_replace(F.translate(text, "ſ", "s"), r"[^\x00-\x7F]", "")
    words = F.split(F.regexp_replace(plain, r"\p{Punct}", " "), r"[\x09-\x0D ]+")
    return F.array_distinct(F.filter(words, lambda w: ~w.rlike("^[0-9]*$")))


def label_name(label: Column) -> Column:
    """The first word of a metric's label."""
    return F.split_part(label, F.lit(" "), F.lit(1))


def label_has(label: Column, metric: str) -> Column:
    return F.contains(F.lower(label), F.lit(metric.lower()))


#: The ranges that plots show.
LIMITS = {"cer": (0.0, 1.0), "seconds": (0.0, 12.0)}


def clamped(value: Column, metric: str) -> Column:
    low, high = LIMITS[metric]
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def utc_text(ts: Column) -> Column:
    """The time as the envelope writes it, for sessions in UTC."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss z")


def elapsed_millis(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def unsigned32(x: Column) -> Column:
    """The low 32 bits, without sign."""
    return x.cast("long").bitwiseAND(F.lit(4294967295))
