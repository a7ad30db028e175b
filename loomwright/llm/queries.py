"""One query for each training-data operator, over its whole table, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from loomwright.llm import (
    decontaminate, exact_dedup, filter_audit, html_extract, jaccard_join, packing, resampling, sharding, sstable, substring_dedup, token_counts, toxicity, url_filter,
)
from loomwright.sources.tables import table


def op1_url_model(spark, sf_dir):
    """Every page's URL judged by rules, else by the character models."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_hash_tree(spark, sf_dir):
    """All documents in 24 shards of a hash tree."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_spaced_seeds(spark, sf_dir):
    """Documents that overlap benchmark items: one row for each pair."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_automata(spark, sf_dir):
    """Every document without the passages that a smaller doc_id has."""
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op5_site_templates(spark, sf_dir):
    """Every page's main text."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark, sf_dir):
    """Groups of equal texts; the largest doc_id stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_count_rtree(spark, sf_dir):
    """Components of documents whose shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    """Every document's toxicity."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_sstable_ids(spark, sf_dir):
    """All documents' ids written to sorted-string-table shards and read back."""
    return sstable.round_trip(table(spark, sf_dir, "documents"))


def op11_first_failures(spark, sf_dir):
    """What five filters remove at every step of every order, for each language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_heap_counts(spark, sf_dir):
    """Every document's tokens, counted."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_sort_count(spark, sf_dir):
    """A quarter of the documents, drawn towards the benchmark's words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    """The corpus pipeline from documents to packed sequences."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_url_model, op2_hash_tree, op3_spaced_seeds, op4_suffix_automata, op5_site_templates, op6_exact_dedup, op7_best_fit_packing, op8_count_rtree, op9_toxicity, op10_sstable_ids, op11_first_failures, op12_heap_counts, op13_sort_count, pipeline)
}
ORACLE_SQL: dict[str, str] = {"op1_url_model": url_filter.oracle_sql(), "op6_exact_dedup": exact_dedup.ORACLE_SQL, "op11_first_failures": filter_audit.ORACLE_SQL}
