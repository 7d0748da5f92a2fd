"""Facet counts of the documents of a term, counted when the index is built.

A phrase of one frequent term hits a large part of all documents, and its facet counts would read the facet columns
of each. The counts of such terms are kept as rows, so they are looked up; rare terms have few documents and are counted
from these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.config import IndexConfig
from prismdex.operators.dictionary import facet_values
from prismdex.operators.query_terms import phrase_terms, probe_terms
from prismdex.operators.search import with_frequencies
from prismdex.operators.sizing import PUSHED_VALUES, Size, lookup_join, settle

MIN_DOCS = 64


@dataclass(frozen=True)
class KeptCounts:
    """(term, field, value, hit_count) of every term that at least `min_docs` documents have."""

    counts: DataFrame
    min_docs: int


def term_facets(postings: DataFrame, docs: DataFrame, frequencies: DataFrame, cfg: IndexConfig = IndexConfig(),
                min_docs: int = MIN_DOCS) -> DataFrame:
    """(term, field, value, hit_count) of the terms that at least `min_docs` documents have.

    Postings and facet columns meet by document, no key of which is hot; the counts are summed in each task before
    they move, so a term of a third of all documents sends its few values from each.
    """
    frequent = frequencies.where(F.col("doc_freq") >= min_docs).select("term")
    rows = lookup_join(postings.select("term", cfg.key), frequent, "term", "left_semi", cfg.key)
    faceted = rows.join(docs.select(cfg.key, *cfg.facets), cfg.key)
    return facet_values(faceted, cfg, ("term",)).groupBy("term", "field", "value").agg(F.count("*").alias("hit_count"))


def broad_queries(queries: DataFrame, frequencies: DataFrame, min_docs: int) -> tuple[DataFrame, Size]:
    """(query_id, term) of the phrases that ask for one term of at least `min_docs` documents, however often they name it."""
    asked = with_frequencies(probe_terms(phrase_terms(queries)), frequencies)
    single = asked.groupBy("query_id").agg(
        F.min("term").alias("term"), F.max("term").alias("other"), F.max("clause_size").alias("longest"),
        F.max("doc_freq").alias("doc_freq"))
    return settle(single.where((F.col("term") == F.col("other")) & (F.col("longest") == 1) & (F.col("doc_freq") >= min_docs))
                  .select("query_id", "term"))


def kept_counts(kept: KeptCounts, broad: DataFrame, size: Size) -> DataFrame:
    """(query_id, field, value, hit_count) of broad queries; few terms are pushed into the scan of the counts."""
    counts = kept.counts
    if size.rows <= PUSHED_VALUES:
        counts = counts.where(F.col("term").isin([row.term for row in broad.select("term").distinct().collect()]))
    return lookup_join(counts, broad, "term", "inner", ["field", "value"], size).select(
        "query_id", "field", "value", "hit_count")
