"""Fill-in-the-middle forms of texts, cut between lines.

A Split pre-tokenizer of the tokenizers library, which needs no training, isolates the matches of ``UNIT``; the
spans that it reports count code points. Their number is n, and the ends of the spans, with a 0 before them,
are where a text may be cut: the cut of rank r ends the first r units. Two draws from a hash of the document's
id choose two ranks, a third whether the text is changed at all, a fourth the order of the parts.

Only the cuts come from Python, one text at a time; the parts, the output and what is rebuilt from it are string
expressions, and nothing is shuffled.

Defined cases: null and empty texts have no unit and stay as they are (form plain), as do texts that hold one of the
marks; a null id draws as if it were empty; equal ids draw alike; rows that repeat each give a row; an empty table
gives an empty result; other columns of the table, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from inkspan.llm.words import portions

#: The marks before the parts, the unit between whose matches texts are cut, and the hash's salt.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
SALT = "7"


def cuts(splitter: Split, text: str) -> np.ndarray:
    """Where a text may be cut, in code points: 0 and the end of every unit."""
    spans = [span for _, span in splitter.pre_tokenize_str(text)] if text else []
    ends = np.zeros(len(spans) + 1, dtype=np.int64)
    ends[1:] = [stop for _, stop in spans]
    return ends


def _placed(unit: str):
    """(n, first, second): the number of units and the two cuts, lower one first, for the draws h1 and h2."""

    def make(batches):
        splitter = Split(Regex(unit), behavior="isolated")
        for batch in batches:
            for b in portions([batch], 1):
                n, first, second = [], [], []
                for text, h1, h2 in zip(b.column(1), b.column(2), b.column(3), strict=True):
                    ends = cuts(splitter, text.as_py())
                    n.append(len(ends) - 1)
                    low, high = sorted((h1.as_py() % len(ends), h2.as_py() % len(ends)))
                    first.append(int(ends[low]))
                    second.append(int(ends[high]))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in (n, first, second))], names=[*b.schema.names, "n", "first", "second"])

    return make


def draws(id_: Column, salt: str = SALT) -> list[Column]:
    """Four numbers of 32 bits from the id."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text of an output: what lies between the marks, in the text's order; marks can't be inside the parts."""

    def between(left: str, right: str) -> Column:
        start = F.instr(output, left) + len(left)
        return F.substring(output, start, F.instr(output, right) - start)

    after = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, salt: str = SALT) -> DataFrame:
    """One row for each row of ``docs``: id, n, form, prefix_chars, middle_chars and output.

    ``percent`` of the texts are changed, ``spm_percent`` of these with the suffix first. n counts units; the
    lengths count code points and are null for form plain.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = dict(zip(("h1", "h2", "h3", "h4"), draws(F.col(id_col), salt), strict=True))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[c.alias(name) for name, c in h.items()])
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(_placed(unit), f"id {kind}, text string, h1 long, h2 long, h3 long, h4 long, n long, first long, second long")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    first, second = (F.col(c).cast("int") for c in ("first", "second"))
    prefix, middle, suffix = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first), F.substring("text", second + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    changed = lambda c: F.when(F.col("form") != "plain", c)
    rows = rows.withColumn("form", form)
    return rows.select(F.col("id").alias(id_col), "n", "form", changed(F.col("first")).alias("prefix_chars"), changed(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))
