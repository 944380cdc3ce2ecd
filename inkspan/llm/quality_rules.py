"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source.

One Arrow pass counts what the rules need. Four ratios, as whole numbers, go into log-linear histograms
(32 buckets to a doubling, so a value is known to about 3 per cent). Histograms merge by adding counts:
each group of language and source is joined with its language's histogram, scaled to ``prior_docs`` documents,
so a small group leans on its language and a large one speaks for itself. A group's bound is a quantile of that
histogram, widened by a part of itself; for counts it is the histogram's mean at least, which speaks where most
documents have none and the quantile is 0. A count is outside when it is above what the bound allows for the
text's length by more than ``NOISE`` of its own standard deviations (Poisson), so short texts aren't
rejected for a single event. Ratios are whole numbers, so a bound stands for all rates below the next number: what is
allowed grows with the text in every group. A mean length of words is outside when it is beyond a bound.

Defined cases: null and empty texts have zero counts and fail the base; null languages and sources are
groups of their own; rows that repeat count each time; an empty table gives an empty result. Ids are cast to long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, row_key, without
from inkspan.llm.words import flat, portions, runs, words

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Ratio: (numerator, factor, denominator, per cent below the lower bound's quantile or None, the same for
#: the upper bound, per cent by which bounds are widened). The quantile must lie inside the good part of a
#: group; symbols mark a kind of junk that may make up a fifth of a group, so theirs is the lowest. Where it is 0,
#: the mean decides, which that fifth pulls up to a fifth of its own rates.
RATIOS = {
    "word_length": ("word_chars", 100, "n_words", 5, 95, 15),
    "symbols": ("n_symbols", 1000, "n_words", None, 75, 100),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", None, 95, 100),
    "repeats": ("n_repeat_words", 1000, "n_words", None, 95, 100),
}
NOISE = 3.0
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_BLANK = b" \t\n\x0b\x0c\r"


def _count(batches):
    for b in portions(batches, 0):
        data, ends = flat(b.column(0))
        h, start, stop, at = words(data, ends, lower=False)
        three = runs(h, 3)
        lead = (data & 0xC0) != 0x80
        lead[data == 0x20] = False
        lead[(data >= 0x09) & (data <= 0x0D)] = False
        symbol = _SYMBOL[data]
        rows = np.zeros((6, len(ends) - 1), dtype=np.int64)
        for d in range(len(ends) - 1):
            i, j, p, q = ends[d], ends[d + 1], at[d], at[d + 1]
            lines = [x for x in data[i:j].tobytes().split(b"\n") if x.strip(_BLANK)]
            repeat = 0
            if q - p > 3:
                _, inverse, n = np.unique(three[p : q - 2], return_inverse=True, return_counts=True)
                twice = n[inverse] > 1
                hit = np.zeros(q - p, dtype=bool)
                for o in range(3):
                    hit[o : o + len(twice)] |= twice
                repeat = int(hit.sum())
            rows[:, d] = q - p, np.count_nonzero(lead[i:j]), np.count_nonzero(symbol[i:j]), len(lines) - len(set(lines)), repeat, len(lines)
        names = [*b.schema.names[1:], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, rows)], names=names)


def counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The counts of every text, its ratios, whether it fails the base, and the row's key (k0, k1)."""
    group = lambda c: F.coalesce(F.concat(F.lit("0"), F.col(c).cast("string")), F.lit("1"))
    key = row_key(*(F.col(c) for c in (id_col, text_col, lang_col, source_col)))
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), group(lang_col).alias("lang"), group(source_col).alias("src"), key[0].alias("k0"), key[1].alias("k1"))
    names = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"
    rows = rows.mapInArrow(_count, "id long, lang string, src string, k0 long, k1 long, " + ", ".join(f"{x} long" for x in names))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    ratio = {m: F.when(F.col(below) > 0, F.expr(f"{times} * {above} div {below}")).otherwise(F.lit(0)).cast("long") for m, (above, times, below, *_) in RATIOS.items()}
    return rows.withColumns(ratio)


def bucket(x: Column) -> Column:
    """The log-linear bucket of a whole number from 0: exact below 64, then 32 to a doubling."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", x, shift)).cast("int")


def value(b: Column) -> Column:
    """The largest number in a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - shift * 32 + 1).cast("long"), shift) - 1


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, src, ratio, bucket, n): a mergeable histogram of each ratio in each group."""
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("ratio"), bucket(F.col(m)).alias("bucket")) for m in RATIOS]))
    return rows.where("not base_failed").select("lang", "src", each).groupBy("lang", "src", "ratio", "bucket").agg(F.count("*").alias("n"))


def blended(hist: DataFrame, prior_docs: int) -> DataFrame:
    """(lang, src, ratio, bucket, weight): each group's histogram in thousandths of a document, with its
    language's scaled to ``prior_docs`` documents."""
    langs = hist.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    sizes = langs.groupBy("lang", "ratio").agg(F.sum("n").alias("all"))
    prior = langs.join(sizes, ["lang", "ratio"]).select("lang", "ratio", "bucket", F.expr(f"n * {1000 * prior_docs}L div all").alias("weight"))
    groups = hist.select("lang", "src").distinct()
    rows = hist.select("lang", "src", "ratio", "bucket", (1000 * F.col("n")).alias("weight")).unionByName(groups.join(prior, "lang"))
    return rows.groupBy("lang", "src", "ratio", "bucket").agg(F.sum("weight").alias("weight"))


def fences(hist: DataFrame) -> DataFrame:
    """(lang, src, <ratio>_hi, <ratio>_lo) of each group from a blended histogram."""
    group = Window.partitionBy("lang", "src", "ratio")
    line = hist.withColumn("upto", F.sum("weight").over(group.orderBy("bucket"))).withColumn("all", F.sum("weight").over(group))
    at = lambda m, percent: F.min(F.when((F.col("ratio") == m) & (100 * F.col("upto") >= percent * F.col("all")), value(F.col("bucket"))))
    wide = lambda q, percent: F.floor(q * percent / 100).cast("long")
    mine = lambda m, x: F.when(F.col("ratio") == m, x)
    mean = lambda m: F.call_function("div", F.sum(mine(m, F.col("weight") * value(F.col("bucket")))), F.max(mine(m, F.col("all"))))
    cols = []
    for m, (*_, low, high, margin) in RATIOS.items():
        upper = wide(at(m, high), 100 + margin)
        cols.append((upper if low is not None else F.greatest(upper, mean(m))).alias(f"{m}_hi"))
        if low is not None:
            cols.append(wide(at(m, low), 100 - margin).alias(f"{m}_lo"))
    return line.groupBy("lang", "src").agg(*cols)


def _outside(m: str) -> Column:
    """Whether a row is beyond its group's bounds; false where it has none."""
    above, times, below, low, *_ = RATIOS[m]
    if low is not None:
        beyond = (F.col(m) > F.col(f"{m}_hi")) | (F.col(m) < F.col(f"{m}_lo"))
    else:
        allowed = ((F.col(f"{m}_hi") + 1) * F.col(below)).cast("double") / F.lit(float(times))
        beyond = F.col(above) > allowed + NOISE * F.sqrt(allowed + 1.0)
    return F.coalesce(beyond, F.lit(False))


def _judged(docs: DataFrame, prior_docs: int, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(counts(docs, id_col, text_col, lang_col, source_col), "counts")
    hist = scratch.save(sketch(rows), "hist")
    bounds = scratch.save(fences(blended(hist, prior_docs)), "bounds")
    rows = rows.join(bounds, ["lang", "src"], "left")
    rows = rows.withColumn("outside", F.concat_ws(",", *[F.when(_outside(m), F.lit(m)) for m in RATIOS]))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("outside") == ""))


def judge(docs: DataFrame, prior_docs: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: id, counts, base_failed, kept, and the ratios that lie outside."""
    rows = _judged(docs, prior_docs, id_col, text_col, lang_col, source_col)
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "outside")


def keep_good(docs: DataFrame, prior_docs: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rows that the rules reject, each by its own text, language and source, whatever other
    rows its id has."""
    columns = id_col, text_col, lang_col, source_col
    bad = _judged(docs, prior_docs, *columns).where("not kept").select("k0", "k1").distinct()
    return without(docs, row_key(*(docs[c] for c in columns)), Scratch(docs.sparkSession).save(bad, "rejected"))
