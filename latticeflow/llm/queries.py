"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, licenses, line_dedup, packing, pii, quality, simhash, token_counts, warc
from ._common import Scratch
from .vocab import ModelFile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> ModelFile:
    return ModelFile(public_tokenizers.path("piece_bpe_32k.model"))


def word_model() -> ModelFile:
    return ModelFile(public_tokenizers.path("word_bpe_49k.json"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, which starts empty."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_model(), f"{Scratch(spark, 'counts').root}/cache")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), piece_model())


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a test item, with the item."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records of all pages, with their blocks (text, or source headers and links) and headers as JSON."""
    return warc.derive(warc.responses_from_pages(table(spark, sf_dir, "pages"))).withColumn("headers", F.to_json("headers"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_model())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document, by its digest, and the lines that went."""
    kept = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="removed_lines")
    return kept.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality_rules,
        op3_benchmark_leaks,
        op4_language_id,
        op5_license_scan,
        op6_warc_derivatives,
        op7_simhash_near_duplicates,
        op8_personal_data,
        op9_best_fit_packing,
        op10_line_dedup,
    )
}
#: Words as ``words.words_of`` has them, in a list; texts without a word have an empty one.
_WORDS = r"list_filter(string_split(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SHINGLES = "array_to_string(w[i + 1 : i + size], ' ') AS s FROM (SELECT *, unnest(range(len(w) - size + 1)) AS i FROM"

_LEAKS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, row_number() OVER () AS k, least(len(w), 5) AS size FROM (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
bs AS (SELECT DISTINCT k, item_id, {_SHINGLES} b)),
n AS (SELECT k, count(*) AS n_shingles FROM bs GROUP BY k),
ds AS (SELECT DISTINCT r, doc_id, {_SHINGLES} (SELECT * FROM d, (SELECT DISTINCT size FROM b) WHERE len(w) >= size)))
SELECT doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment
FROM (SELECT r, doc_id, k, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL) JOIN n USING (k) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""

#: The least runs of 50 words from each line and up to each line; equal runs but the first lose their lines.
_LINES = r"""
WITH own AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS d, string_split(text, chr(10)) AS parts FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT *, len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) AS w FROM (SELECT d, unnest(parts) AS part, unnest(range(len(parts))) AS line FROM own)),
a AS (SELECT d, line, part, row_number() OVER x AS seq, sum(w) OVER x AS upto, sum(w) OVER x - w AS before FROM l WHERE w > 0 WINDOW x AS (PARTITION BY d ORDER BY line)),
runs AS (SELECT p.d, p.seq AS s, q.seq AS e FROM a p ASOF JOIN a q ON p.d = q.d AND p.before + 50 <= q.upto UNION SELECT q.d, p.seq, q.seq FROM a q ASOF JOIN a p ON p.d = q.d AND q.upto - 50 >= p.before),
texts AS (SELECT d, list(part ORDER BY seq) AS parts FROM a GROUP BY d),
later AS (SELECT d, s, e FROM (SELECT d, s, e, row_number() OVER (PARTITION BY array_to_string(parts[s:e], chr(10)) ORDER BY d, s) AS k FROM runs JOIN texts USING (d)) WHERE k > 1),
gone AS (SELECT d, list(line ORDER BY line) AS went FROM (SELECT DISTINCT d, unnest(range(s, e + 1)) AS seq FROM later) JOIN a USING (d, seq) GROUP BY d),
kept AS (SELECT doc_id, text AS old, coalesce(went, []) AS went, CASE WHEN went IS NULL THEN text ELSE coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(went, i - 1)), chr(10)), '') END AS text FROM own LEFT JOIN gone USING (d))
SELECT o.doc_id, len(coalesce(went, []))::BIGINT AS n_removed, coalesce(array_to_string(went, ','), '') AS removed_lines, strlen(k.text)::BIGINT AS n_bytes, sha256(k.text) AS text_sha256
FROM documents o LEFT JOIN kept k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text IS NOT DISTINCT FROM k.old
"""

#: The others need a tokenizer, hash, parser, alignment or iteration that SQL lacks; the tests hold them against plain versions.
ORACLES: dict[str, str] = {"op3_benchmark_leaks": _LEAKS, "op10_line_dedup": _LINES}
