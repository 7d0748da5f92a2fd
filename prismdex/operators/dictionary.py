"""Postings, term dictionary, document frequencies, document lengths, facet vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismdex.config import MIN_SUGGEST_CHARS, IndexConfig
from prismdex.operators.analysis import KEYWORD, STANDARD, SYNONYM, analyze
from prismdex.operators.sizing import Size, lookup_join, measure


def doc_terms(docs: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """(key, pos, term): the analysed text column of every document, synonyms not yet added."""
    return analyze(docs, cfg.text, STANDARD, cfg.key)


def occurrences(docs: DataFrame, cfg: IndexConfig = IndexConfig(), synonyms: DataFrame | None = None,
                field: str | None = None, size: Size | None = None) -> DataFrame:
    """(key, pos, term): every term of the text column, or of a facet column kept whole."""
    if field is not None and field != cfg.text:
        cfg.check_fields([field])
        return analyze(docs, field, KEYWORD, cfg.key)
    return analyze(docs, cfg.text, SYNONYM, cfg.key, synonyms, size)


def build_postings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per term and document: (term, key, tf, positions in order)."""
    return (
        rows.groupBy("term", key)
        .agg(F.expr("sort_array(collect_list(pos)) AS positions"))
        .selectExpr("term", key, "size(positions) AS tf", "positions")
    )


def ranged_postings(rows: DataFrame, key: str = "doc_id", files: int | None = None) -> DataFrame:
    """The same rows ranged and sorted by (term, key): a range holds all rows of a posting, and one sort does for both."""
    ranged = rows.repartitionByRange(files, "term", key) if files else rows.repartitionByRange("term", key)
    by_pos = W.partitionBy("term", key).orderBy("pos")
    whole = by_pos.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        ranged.withColumn("nth", F.row_number().over(by_pos)).withColumn("positions", F.collect_list("pos").over(whole))
        .where("nth = 1").selectExpr("term", key, "size(positions) AS tf", "positions").sortWithinPartitions("term", key)
    )


def term_dictionary(postings: DataFrame) -> DataFrame:
    """Distinct terms; ordered only where the caller sorts."""
    return postings.select("term").distinct()


def doc_freq(postings: DataFrame) -> DataFrame:
    """(term, doc_freq). A posting is one document, so a plain count with partial sums does."""
    return postings.groupBy("term").agg(F.count("*").alias("doc_freq"))


def suggestable(dictionary: DataFrame, min_len: int = MIN_SUGGEST_CHARS) -> DataFrame:
    """Terms long enough to be suggested; blanks inside a term count."""
    return dictionary.where(F.length("term") >= min_len)


def doc_lengths(rows: DataFrame, synonyms: DataFrame | None = None, key: str = "doc_id",
                size: Size | None = None) -> DataFrame:
    """(key, n_terms, n_positions) per document, from its (key, pos, term) rows before synonyms.

    Synonyms stack on the position of their term: they add to n_terms only. The rows of a
    document are made in one task, so partial sums leave one row per document to shuffle.
    """
    if synonyms is None:
        return rows.groupBy(key).agg(F.expr("count(*) AS n_terms"), F.expr("count(*) AS n_positions"))
    listed = synonyms.where("synonym <> term").groupBy("term").agg(F.expr("count(DISTINCT synonym) AS extra"))
    joined = lookup_join(rows, listed, "term", "left", [key, "pos"], size or measure(synonyms))
    return joined.groupBy(key).agg(
        F.expr("sum(1 + coalesce(extra, 0)) AS n_terms"), F.expr("count(*) AS n_positions"))


def facet_values(docs: DataFrame, cfg: IndexConfig = IndexConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, field, value): the facet columns as rows, nulls left out."""
    return (
        docs.select(cfg.key, *carry, *cfg.facets)
        .unpivot([cfg.key, *carry], list(cfg.facets), "field", "value")
        .where("value IS NOT NULL")
    )


def facet_vocabulary(docs: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """(field, value): every value of every facet column over all documents."""
    return facet_values(docs, cfg).select("field", "value").distinct()
