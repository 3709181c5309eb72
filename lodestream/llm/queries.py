"""The operators' queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, cuckoo, fertility, html, licences, mixing, packing, passages, suffixes, weaklabels
from .common import table


def op1_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.with_fertility(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.with_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_groups(table(spark, sf_dir, "documents"))


def op5_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_cuckoo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_groups(table(spark, sf_dir, "documents"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabels.classified(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op9_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


# Columns of the operators above that SQL can express, each through its operator.
def llm_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_tokenizer_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_splitting_tree(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def llm_licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_rare_token_index(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tokenizer_fertility, op2_block_rules, op3_splitting_tree, op4_bag_minhash, op5_rare_token_index, op6_cuckoo_index, op7_compact_windows, op8_weak_labels, op9_suffix_sort, op10_best_fit,
        llm_base_rules, llm_mix_targets, llm_licence_phrases,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op6_cuckoo_index": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "llm_base_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
             w AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS p FROM d),
             t AS (SELECT doc_id, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
             n AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
             r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM n WHERE n > 1) GROUP BY doc_id),
             l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
             f AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                          coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
    """,
    "llm_mix_targets": rf"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w FROM d GROUP BY source),
             -- Sources reach twice their size in the order of size by weight; what is left goes by weight.
             k AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                          sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s WHERE source_size > 0 WINDOW o AS (ORDER BY 2 * source_size / w, source)),
             m AS (SELECT arg_min(rest / weights, 2 * source_size / w) FILTER (WHERE rest / weights * w <= 2 * source_size) AS level FROM k)
        SELECT doc_id, size, source_size, round(least(2.0 * source_size, w * level)::DOUBLE, 3) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, m
    """,
    "llm_licence_phrases": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
             w AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) - 1 AS p FROM d),
             t AS (SELECT doc_id, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
             h AS (SELECT doc_id, p, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM t),
             g AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(p)::BIGINT AS first_word, max(p)::BIGINT AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM h WHERE label IS NOT NULL GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
    """,
}
