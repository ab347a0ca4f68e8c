"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compression, kneser_ney, lines, mixing, packing, pairwise, records, simhash, sketch, warc
from .shared import ship


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return query


def _labelled(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

    return query


def _tokenized(operator: Callable[[DataFrame, str], DataFrame], file: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        import public_tokenizers

        ship(spark)
        return operator(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(file))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": _over("documents", functools.partial(kneser_ney.op1_kneser_ney, order=kneser_ney.ORDER)),
    "op2_simhash": _over("documents", simhash.op2_simhash),
    "op3_warc": _over("pages", warc.op3_warc),
    "op4_lines": _over("documents", lines.op4_lines),
    "op5_records": _tokenized(records.op5_records, "byte_bpe_50k.json"),
    "op6_packing": _tokenized(packing.op6_packing, "word_bpe_49k.json"),
    "op7_mixing": _over("documents", mixing.op7_mixing),
    "op8_sketch": _over("documents", sketch.op8_sketch),
    "op9_pairwise": _labelled(pairwise.op9_pairwise),
    "op10_compression": _over("documents", compression.op10_compression),
}



def _columns(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).selectExpr(*columns)


# What SQL can express of a query, so that it is compared value by value: the columns that a contract defines.
QUERIES["compression_base"] = _columns("op10_compression", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
QUERIES["mixing_targets"] = _columns("op7_mixing", "doc_id", "size", "source_size", "round(target, 4) AS target")
QUERIES["sketch_edits"] = _columns("op8_sketch", "doc_id", "n_chars", "edited_sha256")

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
each AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
five AS (SELECT doc_id, i, lead(x, 4) OVER o AS last, concat_ws(chr(10), x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS k FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM five WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
inside AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM again) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
       len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
FROM d JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)
"""
_TARGETS = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, ((sum(n) OVER ())::DOUBLE - 3.0 * coalesce(sum(n) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM s
      WINDOW b AS (ORDER BY 3.0 * n / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level * weight >= 3.0 * n AS whole FROM r),
t AS (SELECT *, max(CASE WHEN NOT whole THEN level END) OVER () AS rest FROM f)
SELECT doc_id, size, n AS source_size, round(CASE WHEN whole OR rest IS NULL THEN 3.0 * n ELSE rest * weight END, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
_EDITS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, length(t) AS n, length(t) // 3 AS k, coalesce(lead(t) OVER o, first_value(t) OVER o) AS next FROM d WINDOW o AS (ORDER BY doc_id DESC))
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - k) || substr(next, 1, k)) AS edited_sha256 FROM p
"""
ORACLES: dict[str, str] = {"op3_warc": warc.ORACLE, "compression_base": _BASE, "mixing_targets": _TARGETS, "sketch_edits": _EDITS}
