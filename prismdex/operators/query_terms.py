"""Typed phrases as rows of query terms.

A query is a list of clauses. A clause is one term, or several terms that must stand
in the text at the same distances as in the query. The rows are
(query_id, occur, clause, clause_size, q_pos, term, n_clauses, n_must, boost): n_clauses
counts the clauses that score, n_must those a document has to match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.operators.analysis import STANDARD, Chain
from prismdex.operators.sizing import BROADCAST_ROWS, PUSHED_VALUES, Size, settle

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"


def clauses_sql(phrase: str, chain: Chain = STANDARD, whole: bool = False) -> str:
    """array<array<struct<pos, term>>>: the clauses of a phrase.

    Words apart by white space are separate clauses; a word that analyses to several
    terms (mid-america) is one clause, and so is the phrase if taken `whole`.
    Stop words leave gaps; clauses of nothing but stop words vanish.
    """
    chunks = f"array({phrase})" if whole else rf"split({phrase}, r'[\s\p{{Z}}]+')"
    return f"filter(transform({chunks}, c -> {chain.tokens_sql('c')}), c -> size(c) > 0)"


def _boost(queries: DataFrame) -> str:
    return "CAST(boost AS double) AS boost" if "boost" in queries.columns else "CAST(1 AS double) AS boost"


def bool_terms(queries: DataFrame, whole: bool = False, chain: Chain = STANDARD) -> DataFrame:
    """Query terms of (query_id [, must] [, should] [, must_not] [, boost]); each a phrase or null.

    All counts are taken within the row of the query: no shuffle.
    """
    kinds = [kind for kind in (MUST, SHOULD, MUST_NOT) if kind in queries.columns]
    analysed = queries.selectExpr("query_id", _boost(queries), *[
        f"coalesce({clauses_sql(kind, chain, whole)}, array()) AS {kind}" for kind in kinds])
    parts = ", ".join(f"named_struct('occur', '{kind}', 'clauses', {kind})" for kind in kinds)
    n_must = f"size({MUST})" if MUST in kinds else "0"
    n_should = f"size({SHOULD})" if SHOULD in kinds else "0"
    return (
        analysed.selectExpr("query_id", "boost", f"{n_must} AS n_must", f"{n_must} + {n_should} AS n_clauses",
                            f"inline(array({parts}))")
        .selectExpr("query_id", "boost", "n_must", "n_clauses", "occur", "posexplode(clauses) AS (clause, tokens)")
        .selectExpr("query_id", "occur", "clause", "size(tokens) AS clause_size", "n_clauses", "n_must", "boost",
                    "inline(tokens) AS (q_pos, term)")
    )


def phrase_terms(queries: DataFrame, occur: str = MUST, whole: bool = False, chain: Chain = STANDARD) -> DataFrame:
    """Query terms of (query_id, phrase [, boost]): all clauses required, or all optional."""
    return bool_terms(queries.withColumnRenamed("phrase", occur), whole, chain)


def clause_terms(clauses: DataFrame, chain: Chain = STANDARD) -> DataFrame:
    """Query terms of (query_id, clause, text, occur [, boost]): one clause per row.

    The text of a row is taken whole, so a text of several words is a phrase clause.
    """
    rows = clauses.selectExpr(
        "query_id", "clause", "occur", _boost(clauses), f"{chain.tokens_sql('text')} AS tokens").where("size(tokens) > 0")
    totals = rows.groupBy("query_id").agg(
        F.expr(f"int(count_if(occur <> '{MUST_NOT}')) AS n_clauses"), F.expr(f"int(count_if(occur = '{MUST}')) AS n_must"))
    return rows.join(totals, "query_id").selectExpr(
        "query_id", "occur", "clause", "size(tokens) AS clause_size", "n_clauses", "n_must", "boost",
        "inline(tokens) AS (q_pos, term)")


@dataclass(frozen=True)
class TermProbe:
    """A table of query terms, and what is known of it before it meets the postings."""

    table: DataFrame
    size: Size
    has_words: bool  # clauses of one term
    has_phrases: bool  # clauses of several terms
    terms: tuple[str, ...] | None  # the distinct terms, if few enough to push into the scan


def probe_terms(terms: DataFrame) -> TermProbe:
    """Settle a table of query terms, and look at it up to the broadcast bound."""
    table, size = settle(terms)
    found = table.select("term", "clause_size").limit(BROADCAST_ROWS + 1).agg(
        F.expr("coalesce(min(clause_size), 1) AS shortest"),
        F.expr("coalesce(max(clause_size), 1) AS longest"),
        F.expr(f"slice(collect_set(term), 1, {PUSHED_VALUES + 1}) AS terms"),
    ).collect()[0]
    seen_all = size.rows <= BROADCAST_ROWS
    few = size.small and len(found.terms) <= PUSHED_VALUES
    return TermProbe(table, size, found.shortest == 1 or not seen_all, found.longest > 1 or not seen_all,
                     tuple(found.terms) if few else None)
