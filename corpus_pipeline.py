"""From raw documents to shards of a training mix, in five stages.

Each stage works on all that the stage before it kept and is written as Parquet before the next one reads
it, so a lost executor costs one stage's tasks at most.

Defined cases of all stages: they decide by rows, so rows with null or repeated ids are documents of their own; null
and empty texts fail the quality rules; null languages and sources are values of their own; extra columns pass
through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from inkspan.llm import decontamination, hash_tree, mixing, ngram_jaccard, quality_rules  # noqa: E402
from inkspan.llm.common import Scratch, fresh, table  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the adaptive rules keep."""
    return quality_rules.keep_good(docs, prior_docs=50)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity 0.8 or more."""
    return ngram_jaccard.drop_near_copies(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3; a document of a repeated source comes up to three times."""
    return mixing.mix(docs, weights=(1, 2, 3), max_epochs=3.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of eight, as column shard (_shard if there is one of that name)."""
    return hash_tree.with_shard(docs, F.col("doc_id"), hash_tree.topology(8), fresh(docs, "shard"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage-{i}")
            if i:
                scratch.drop(f"stage-{i - 1}")
    return docs


#: Spaced seeds have no SQL form; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
