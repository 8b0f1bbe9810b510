"""Queries and SQL of the large-corpus operators, as `__spark_entry__` registers them."""

from __future__ import annotations

from . import decontaminate, fingerprints, html_extract, language_id, packing, sharding, simhash_dedup, substring_dedup, toxicity, url_filter
from .common import table


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labelled_pages(pages, table(spark, sf_dir, "labels")))


def op6_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints_and_neighbours(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_toxicity, op3_language_id, op4_packing, op5_url_filter, op6_decontamination, op7_simhash_near_dedup, op8_html_extraction, op9_fingerprints, op10_sharding)
}
#: The models, components and plans of these queries are not expressible in SQL; tests/llm compares them with brute force. See ORACLES for those that are.
ORACLES: dict[str, str] = {}
