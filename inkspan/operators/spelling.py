"""Spelling error rate of pages: unique words against a stop list and a dictionary table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import error_rate, spelling_words


def unique_words(pages: DataFrame, keys: list[str], text: str = "txt") -> DataFrame:
    """(keys, word): each page's distinct words. Narrow: a page is one row."""
    return pages.select(*keys, F.explode(spelling_words(F.col(text))).alias("word"))


def misspelled(words: DataFrame, dictionary: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """The words that neither list (word) holds."""
    out = words.join(dictionary, "word", "left_anti")
    return out.join(stop, "word", "left_anti") if stop is not None else out


def stems(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(word, stem): what each distinct word comes from by each rule that fits it.

    rules (affix, strip, prefix): a word that ends in ``affix`` (prefix: begins with it) comes from the word with ``strip`` in its
    place; something must be left of the word. Words send each of their endings that may be an affix to the rules, so the
    rules may be as many as a dictionary has.
    """
    rules = rules.select("affix", F.coalesce("strip", F.lit("")).alias("strip"), "prefix").where("affix <> ''").distinct()
    longest = rules.agg(F.max(F.length("affix"))).first()[0] or 0
    n = F.length("word")
    ends = words.select("word").distinct().where(n > 1).select("word", F.explode(F.sequence(F.lit(1), F.least(n - 1, F.lit(longest)))).alias("k")) if longest else words.select("word", F.lit(0).alias("k")).where(F.lit(False))
    both = ends.select("word", "k", F.inline(F.array(F.struct(F.lit(False).alias("prefix"), F.right("word", F.col("k")).alias("affix")), F.struct(F.lit(True).alias("prefix"), F.left("word", F.col("k")).alias("affix")))))
    found = both.join(rules, ["affix", "prefix"])
    stem = F.when(F.col("prefix"), F.concat("strip", F.substring("word", F.col("k") + 1, n))).otherwise(F.concat(F.left("word", n - F.col("k")), "strip"))
    return found.select("word", stem.alias("stem")).distinct()


def with_derived(words: DataFrame, dictionary: DataFrame, rules: DataFrame) -> DataFrame:
    """(word): the dictionary and those of ``words`` that a rule derives from one of its words."""
    unknown = words.select("word").distinct().join(dictionary, "word", "left_anti")
    known = dictionary.select(F.col("word").alias("stem")).distinct()
    return dictionary.select("word").union(stems(unknown, rules).join(known, "stem", "left_semi").select("word")).distinct()


def spelling_error_rate(pages: DataFrame, keys: list[str], dictionary: DataFrame, stop: DataFrame | None = None, text: str = "txt") -> DataFrame:
    """(keys, n_words, n_wrong, ser) of every page, also of one without words (rate 0).

    Pages are split into words once: pages without words send one row without a word, so that all are counted. The lists
    are put together to one table of known words; a word is looked up once for each page that has it.
    """
    lists = dictionary.select("word") if stop is None else dictionary.select("word").union(stop.select("word"))
    known = lists.distinct().withColumn("_known", F.lit(True))
    words = pages.select(*keys, F.explode_outer(spelling_words(F.coalesce(text, F.lit("")))).alias("word"))
    rows = words.join(known, "word", "left")
    wrong = F.col("word").isNotNull() & F.col("_known").isNull()
    out = rows.groupBy(*keys).agg(F.count("word").alias("n_words"), F.count_if(wrong).alias("n_wrong"))
    return out.withColumn("ser", error_rate(F.col("n_wrong"), F.col("n_words")))
