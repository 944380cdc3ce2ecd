"""The operators' queries, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import oracles, ordinal
from inkspan.llm.chat import rotate
from inkspan.llm.common import table
from inkspan.llm.decontamination import overlaps
from inkspan.llm.fill_middle import fill_middle, restored
from inkspan.llm.hash_tree import shards
from inkspan.llm.merkle import leaf, manifest
from inkspan.llm.mixing import takes
from inkspan.llm.ngram_jaccard import jaccard_classes
from inkspan.llm.quality_rules import judge
from inkspan.llm.secret_scan import scan
from inkspan.llm.substring_dedup import dedup
from inkspan.llm.suffix_tree import score
from inkspan.llm.warc import round_trip


def op1_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of repeated runs of three or more sentences and twenty or more words."""
    return dedup(table(spark, sf_dir, "documents"), run=3, min_words=20, whole=True)


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold text of a benchmark item, by document and item."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a tree that learns from four fifths of them."""
    return score(table(spark, sf_dir, "documents"), depth=3, min_count=5)


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of all documents; grades: toxic 0, poor 1, good 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return ordinal.score(docs, ordinal.train(docs, labels, grade, grades=3), top=2, least=0.5)


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the side of every participant, a row for each turn."""
    return rotate(table(spark, sf_dir, "conversations"))


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards (two regions of two racks of two), and where rows go with a ninth."""
    return shards(table(spark, sf_dir, "documents"), n_shards=8)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 0.85 or more on 4-word shingles; the component of every document."""
    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 over the sources, none repeated more than three times."""
    return takes(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_epochs=3.0)


def op9_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text, and the verdict of thresholds per language and source."""
    return judge(table(spark, sf_dir, "documents"), prior_docs=50)


def op10_automaton_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all rules in every document."""
    return scan(table(spark, sf_dir, "documents"))


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives without repeated payloads of 1,000 bytes or more, read back."""
    return round_trip(table(spark, sf_dir, "pages"), least=1000)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; a fifth of the documents are shown with their text in lower case."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    shown = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    text = F.when(shown, F.translate("text", oracles.UPPER, oracles.LOWER)).otherwise(F.col("text"))
    return manifest(docs, fields, leaf(*(F.col(c) for c in fields[:-1]), text)).drop("source", "pos")


def op13_split_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as prefix, suffix and middle, and the digests of the output and of the text rebuilt from it."""
    made = fill_middle(table(spark, sf_dir, "documents"), percent=100, spm_percent=50)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_span_dedup": op1_sentence_span_dedup,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_suffix_tree_scores": op3_suffix_tree_scores,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_hash_tree_shards": op6_hash_tree_shards,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_source_mix": op8_source_mix,
    "op9_adaptive_quality_rules": op9_adaptive_quality_rules,
    "op10_automaton_secret_scan": op10_automaton_secret_scan,
    "op11_warc_revisits": op11_warc_revisits,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_split_fill_middle": op13_split_fill_middle,
}
ORACLES: dict[str, str] = oracles.SQL
