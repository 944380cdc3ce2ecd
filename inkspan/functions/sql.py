"""Names for SQL: the library's scalar functions as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name: (parameters, type, body). Bodies are SQL, so Catalyst inlines them.
FUNCTIONS = {
    "byte_levenshtein": ("a STRING, b STRING", "INT", "levenshtein(decode(encode(a, 'UTF-8'), 'ISO-8859-1'), decode(encode(b, 'UTF-8'), 'ISO-8859-1'))"),
    "cer": ("distance INT, truth STRING", "DOUBLE", "CASE WHEN distance = 0 THEN 0D WHEN octet_length(truth) = 0 THEN 1D ELSE distance / octet_length(truth) END"),
    "sanitized": ("a STRING", "STRING", "lower(regexp_replace(a, '[^A-Za-z0-9-]', '_'))"),
    "interval_overlap": ("l0 BIGINT, r0 BIGINT, l1 BIGINT, r1 BIGINT", "BIGINT", "greatest(0L, least(r0, r1) - greatest(l0, l1))"),
    "blw_text": (
        "blocks ARRAY<STRUCT<xywh: STRING, lines: ARRAY<STRUCT<xywh: STRING, words: ARRAY<STRUCT<xywh: STRING, text: STRING>>>>>>", "STRING",
        "array_join(transform(blocks, b -> array_join(transform(b.lines, l -> array_join(transform(l.words, w -> w.text), ' ')), '\\n')), '\\n')",
    ),
}


def register(spark: SparkSession) -> None:
    """Creates the functions for this session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
