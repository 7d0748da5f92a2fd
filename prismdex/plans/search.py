"""The search jobs: browse a phrase, refine by selections, suggest, answer a query log."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.config import PAGE_OFFSET, PAGE_SIZE
from prismdex.operators import facets as E
from prismdex.operators.broad import KeptCounts, broad_queries, kept_counts
from prismdex.operators import rank as R
from prismdex.operators.query_terms import clauses_sql, phrase_terms
from prismdex.operators.search import Cost
from prismdex.operators.sizing import lookup_join, settle
from prismdex.plans.index import Index
from prismdex.sources.store import write_once


class Result:
    """hits(query_id, rank, key, score, text) and facets(query_id, field, value, hit_count).

    Each part is planned when it is first asked for: a caller of one does not pay for both.
    """

    def __init__(self, hits: Callable[[], DataFrame], facets: Callable[[], DataFrame]):
        self._hits, self._facets = hits, facets

    @cached_property
    def hits(self) -> DataFrame:
        return self._hits()

    @cached_property
    def facets(self) -> DataFrame:
        return self._facets()


def scored_hits(index: Index, queries: DataFrame) -> tuple[DataFrame, Cost]:
    """(query_id, key, score) of every document that matches all clauses of its query."""
    return R.score_bounded(index.postings, phrase_terms(queries), index.frequencies, index.lengths, index.totals,
                           key=index.cfg.key)


def _page(index: Index, scored: DataFrame, offset: int, count: int, cost: Cost) -> DataFrame:
    """One page per query with the stored text, which is joined only after paging."""
    top = R.top_hits(scored, offset, count, index.cfg.key)
    max_hits = min(cost.hits, cost.n_queries * count)
    return R.fetch(top, index.docs, [index.cfg.text], max_hits, index.cfg.key).select(
        "query_id", "rank", index.cfg.key, "score", index.cfg.text)


def browse(index: Index, queries: DataFrame, offset: int = PAGE_OFFSET, count: int = PAGE_SIZE,
           keep: bool = False, kept: KeptCounts | None = None) -> Result:
    """Answer (query_id, phrase): a page of hits, and the facet values that have hits.

    With `keep` the scored hits are written once, for callers that read both parts. With the `kept` counts of the
    build the facets of frequent one-term phrases are looked up; no document is read for them.
    """
    if kept is not None:
        return Result(lambda: browse(index, queries, offset, count, keep).hits, lambda: _facets_kept(index, queries, kept))
    scored, cost = scored_hits(index, queries)
    if keep:
        scored = write_once(scored, "hits")
    faceted = E.with_facets(scored.select("query_id", index.cfg.key), index.docs, index.cfg, cost.hits)
    return Result(lambda: _page(index, scored, offset, count, cost), lambda: E.facet_counts(faceted, index.cfg))


def _facets_kept(index: Index, queries: DataFrame, kept: KeptCounts) -> DataFrame:
    broad, size = broad_queries(queries, index.frequencies, kept.min_docs)
    rest, others = settle(lookup_join(queries, broad, "query_id", "left_anti", "phrase", size))
    looked_up = kept_counts(kept, broad, size)
    return looked_up if not others.rows else looked_up.unionByName(browse(index, rest).facets)


def refine(index: Index, queries: DataFrame, selections: DataFrame, offset: int = PAGE_OFFSET,
           count: int = PAGE_SIZE, keep: bool = False) -> Result:
    """Answer (query_id, phrase) narrowed by (query_id, field, value).

    The facets list the whole vocabulary, zeros included, for every query, with or
    without selections and hits.
    """
    scored, cost = scored_hits(index, queries)
    faceted = E.refine_hits(E.with_facets(scored, index.docs, index.cfg, cost.hits), selections, index.cfg)
    if keep:
        faceted = write_once(faceted, "hits")

    def facets() -> DataFrame:
        counts = E.facet_counts_zero_filled(faceted, queries, index.vocabulary, index.cfg)
        return E.facet_state(counts, selections, index.cfg)

    return Result(
        lambda: _page(index, faceted.select("query_id", index.cfg.key, "score"), offset, count, cost), facets)


def answer_log(index: Index, log: DataFrame, offset: int = PAGE_OFFSET, count: int = PAGE_SIZE) -> Result:
    """Browse a log of phrases: phrases of the same clauses are searched once.

    With a `boost` column, phrases share an answer only at the same boost. However often a phrase was typed, it costs one search; its page and facets are then
    handed to every row of the log that has it.
    """
    boost = F.col("boost").cast("double") if "boost" in log.columns else F.lit(1.0)
    signed = log.select("query_id", "phrase", boost.alias("boost"), F.expr(f"to_json({clauses_sql('phrase')}) AS clauses")
                        ).where("clauses <> '[]'").withColumn("clauses", F.concat_ws(" ", "boost", "clauses"))
    distinct = signed.groupBy("clauses").agg(
        F.min("query_id").alias("asked"), F.min_by(F.struct("phrase", "boost"), "query_id").alias("first"))
    found = browse(index, distinct.select(F.col("asked").alias("query_id"), "first.*"), offset, count, keep=True)
    copies = lookup_join(signed.select("query_id", "clauses"), distinct.select("clauses", "asked"), "clauses", "inner",
                         "query_id").select("query_id", "asked")

    def handed(part: DataFrame, name: str) -> DataFrame:
        answers = write_once(part, name).withColumnRenamed("query_id", "asked")
        return lookup_join(copies, answers, "asked", "inner", "query_id").drop("asked")

    return Result(lambda: handed(found.hits, "page"), lambda: handed(found.facets, "facets"))
