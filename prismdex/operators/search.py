"""Matching of query terms against postings, and composition of result sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismdex.config import IndexConfig
from prismdex.operators.dictionary import doc_freq, facet_values
from prismdex.operators.query_terms import MUST, MUST_NOT, SHOULD, TermProbe, probe_terms
from prismdex.operators.sizing import broadcast_if, lookup_join, salted_join, settle
from prismdex.sources.store import write_once

# Up to this many postings of all query terms are simply joined and grouped.
DIRECT_ROWS = 1_000_000


def restrict(postings: DataFrame, probe: TermProbe) -> DataFrame:
    """Postings of the query terms only, where these are few.

    The terms become a literal filter that the sorted postings files are pruned by; it
    also moves below the grouping of postings that are still to be built.
    """
    return postings if probe.terms is None else postings.where(F.col("term").isin(*probe.terms))


def match_term(postings: DataFrame, term: str, key: str = "doc_id") -> DataFrame:
    """Documents with one exact term."""
    return postings.where(F.col("term") == term).select(key, "tf")


def clauses_met(found: DataFrame, probe: TermProbe, key: str) -> DataFrame:
    """(query_id, occur, clause, key, freq, + other query columns) from query terms joined to their postings.

    A clause of one term is a posting already. For a clause of several terms the postings
    of one document come together, at most one per term of the clause; a start position
    (position in the text less position in the clause) that all of them share is one
    occurrence. No self join of postings, no pairs of positions.
    """
    own = {"query_id", "occur", "clause", "term", "q_pos", "clause_size", key, "tf", "positions"}
    about = [c for c in found.columns if c not in own]
    single = found.where("clause_size = 1").selectExpr("query_id", "occur", "clause", key, *about, "bigint(tf) AS freq")
    if not probe.has_phrases:
        return single
    starts = found.where("clause_size > 1").withColumn("starts", F.expr("transform(positions, p -> p - q_pos)"))
    together = (
        starts.groupBy("query_id", "occur", "clause", key)
        .agg(*[F.expr(f"any_value({c}) AS {c}") for c in (*about, "clause_size")],
             F.expr("collect_list(struct(size(starts) AS n, starts)) AS lists"))
        .where("size(lists) = clause_size")
    )
    # Rarest term first: what is left to compare only shrinks from there.
    shared = "aggregate(sort_array(lists), CAST(NULL AS array<int>), (s, l) -> coalesce(array_intersect(s, l.starts), l.starts))"
    whole = (
        together.selectExpr("query_id", "occur", "clause", key, *about, f"bigint(size({shared})) AS freq")
        .where("freq > 0")
    )
    return single.unionByName(whole) if probe.has_words else whole


def match_clauses(postings: DataFrame, probe: TermProbe, terms: DataFrame | None = None,
                  key: str = "doc_id") -> DataFrame:
    """Every clause of a query that a document matches, with its frequency there.

    `terms` are the rows of the probe with further columns, if any.
    """
    asked = probe.table if terms is None else terms
    wanted = restrict(postings, probe)
    if probe.terms is None and probe.size.small:
        # A semi join moves below the grouping of postings that are still to be built: only those of asked terms are grouped.
        wanted = wanted.join(F.broadcast(probe.table.select("term").distinct()), "term", "left_semi")
    found = lookup_join(wanted, asked, "term", "inner", key, probe.size)
    return clauses_met(found, probe, key)


@dataclass(frozen=True)
class Cost:
    """What a set of queries touches, from the document frequencies of its terms."""

    n_queries: int
    all_rows: int  # postings of all terms, counted per query that names them
    hits: int  # most documents that can match, if every clause is required
    lookups: int  # postings to look up for these documents


def cost_of(terms: DataFrame) -> Cost:
    """The cost of query terms that carry `doc_freq`; works on the query terms alone."""
    per_query = terms.groupBy("query_id").agg(
        F.expr("sum(doc_freq) AS all_rows"), F.expr("min(doc_freq) AS hits"), F.expr("count(*) AS n"))
    total = per_query.agg(F.expr("count(*)"), *[
        F.expr(f"coalesce(sum({c}), 0)") for c in ("all_rows", "hits", "hits * n")]).collect()[0]
    return Cost(*total)


def match_required(postings: DataFrame, probe: TermProbe, terms: DataFrame, cost: Cost,
                   key: str = "doc_id") -> DataFrame:
    """The same where every clause is required; `terms` carry `doc_freq`.

    Where the terms have many postings, the search starts from the rarest term of each
    query: only its documents can match, and the other terms are looked up for them by
    (term, key). While these lookups fit a broadcast, the postings of a frequent term do
    not move at all; beyond that they move once, not once per query that names the term.
    """
    if cost.all_rows <= DIRECT_ROWS:
        return match_clauses(postings, probe, terms.drop("doc_freq"), key)
    restricted = restrict(postings, probe)
    by_rarity = W.partitionBy("query_id").orderBy("doc_freq", "term", "occur", "clause", "q_pos")
    rarest = terms.withColumn("nth", F.row_number().over(by_rarity)).where("nth = 1").select("query_id", "term")
    seeds = lookup_join(restricted.select("term", key), rarest, "term", "inner", key, probe.size).select("query_id", key)
    needed = lookup_join(seeds, terms.drop("doc_freq"), "query_id", "inner", key, probe.size)
    return clauses_met(restricted.join(broadcast_if(needed, cost.lookups), ["term", key]), probe, key)


def with_frequencies(probe: TermProbe, frequencies: DataFrame) -> DataFrame:
    """Query terms with the `doc_freq` of their term, 0 for a term no document has."""
    known = restrict(frequencies, probe)
    if probe.terms is None:
        known = lookup_join(known, probe.table.select("term").distinct(), "term", "left_semi", "term", probe.size)
    if probe.size.small:  # one row per distinct query term
        joined = probe.table.join(F.broadcast(known), "term", "left")
    else:
        joined = salted_join(probe.table, known, ["term"], "left", ["query_id"])
    return joined.withColumn("doc_freq", F.expr("coalesce(doc_freq, 0)"))


def fix_terms(terms: DataFrame, probe: TermProbe) -> DataFrame:
    """Query terms with looked-up columns, worked out once: as local rows, or as a written table."""
    return settle(terms)[0] if probe.size.small else write_once(terms, "terms")


def _match_whole(postings: DataFrame, probe: TermProbe, key: str) -> DataFrame:
    """`match_required` of phrases on postings without frequencies; those of other terms are left out before grouping.

    A search by rarest term meets queries and documents by their ids: rows without one, and queries that share an
    id, are matched directly.
    """
    wanted = lookup_join(postings, probe.table.select("term").distinct(), "term", "left_semi", key, probe.size)
    written = write_once(wanted.select("term", key, "tf", "positions"), "postings")
    in_clause = F.count("*").over(W.partitionBy("query_id", "occur", "clause"))
    shared = F.max(F.col("_n") != F.col("clause_size")).over(W.partitionBy("query_id"))
    known = fix_terms(with_frequencies(probe, doc_freq(written)).withColumn("_n", in_clause).withColumn(
        "_direct", F.col("query_id").isNull() | shared).drop("_n"), probe)
    asked, direct = (known.where(which).drop("_direct") for which in ("NOT _direct", "_direct"))
    return (
        match_required(written.where(F.col(key).isNotNull()), probe, asked, cost_of(asked), key)
        .unionByName(match_clauses(written.where(F.col(key).isNull()), probe, asked.drop("doc_freq"), key))
        .unionByName(match_clauses(written, probe, direct.drop("doc_freq"), key))
    )


def search_all(postings: DataFrame, terms: DataFrame, frequencies: DataFrame | None = None,
               key: str = "doc_id") -> DataFrame:
    """(query_id, key): documents that match every clause of the query.

    With the (term, doc_freq) table at hand the search starts from each query's rarest term; without it, the
    postings of phrases of many terms are written once, and their frequencies are counted there.
    """
    probe = probe_terms(terms)
    if frequencies is None and probe.terms is None and probe.has_phrases:
        matched = _match_whole(postings, probe, key)
    elif frequencies is None:
        matched = match_clauses(postings, probe, key=key)
    else:
        known = fix_terms(with_frequencies(probe, frequencies), probe)
        matched = match_required(postings, probe, known, cost_of(known), key)
    return (
        matched.groupBy("query_id", key)
        .agg(F.expr("count(*) AS n"), F.expr("any_value(n_clauses) AS n_clauses"))
        .where("n = n_clauses").select("query_id", key)
    )


def search_any(postings: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key): documents that match at least one clause of the query."""
    return match_clauses(postings, probe_terms(terms), key=key).select("query_id", key).distinct()


def search_bool(postings: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key): all `must` clauses, no `must_not` clause, and a `should` clause if there is no `must`.

    One aggregate decides all three. A query of prohibited clauses only matches nothing.
    """
    kinds = [F.count_if(F.col("occur") == kind).alias(f"n_{kind}_met") for kind in (MUST, SHOULD, MUST_NOT)]
    return (
        match_clauses(postings, probe_terms(terms), key=key).groupBy("query_id", key).agg(*kinds, F.first("n_must").alias("n_must"))
        .where("n_must_not_met = 0 AND n_must_met = n_must AND n_must_met + n_should_met > 0")
        .select("query_id", key)
    )


def search_phrase(postings: DataFrame, terms: DataFrame, frequencies: DataFrame | None = None,
                  key: str = "doc_id") -> DataFrame:
    """(query_id, key): documents with the whole phrase; `terms` come from phrase_terms(whole=True)."""
    return search_all(postings, terms, frequencies, key)


def hits_and(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    return left.join(right.select("query_id", key), ["query_id", key], "left_semi")


def hits_or(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    return left.select("query_id", key).union(right.select("query_id", key)).distinct()


def hits_not(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    return left.join(right.select("query_id", key), ["query_id", key], "left_anti")


def match_field(docs: DataFrame, queries: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """(query_id, key) for (query_id, field, value) on facet columns.

    The asked value is lower-cased as all query text is; the column is not, so a
    capitalised value is found by selections only.
    """
    asked = queries.select("query_id", "field", F.lower("value").alias("value"))
    return lookup_join(facet_values(docs, cfg), asked, ["field", "value"], "inner", cfg.key).select("query_id", cfg.key)


def match_all(docs: DataFrame, query_id: int, key: str = "doc_id") -> DataFrame:
    """(query_id, key): every document, for one query."""
    return docs.select(F.lit(query_id).cast("long").alias("query_id"), key)


def hit_count(hits: DataFrame) -> DataFrame:
    """(query_id, hit_count)."""
    return hits.groupBy("query_id").agg(F.count("*").alias("hit_count"))
