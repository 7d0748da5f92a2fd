"""TF-IDF scores, ranking, paging and fetch of stored columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismdex.config import PAGE_OFFSET, PAGE_SIZE
from prismdex.operators.query_terms import MUST_NOT, probe_terms
from prismdex.operators.search import Cost, cost_of, fix_terms, match_clauses, match_required, search_bool, with_frequencies
from prismdex.operators.sizing import LOCAL_ROWS, PUSHED_VALUES, broadcast_if, settle


def length_norm(n_terms: Column) -> Column:
    """1 / sqrt(length), cut to a power of two and two binary digits."""
    x = 1.0 / F.sqrt(n_terms)
    power = F.pow(F.lit(2.0), F.floor(F.log2(x)))
    return power * (1.0 + F.floor((x / power - 1.0) * 4.0) / 4.0)


def weigh_terms(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Query terms with `weight` = boost times the squared sum of the idfs of the clause.

    `terms` carry `doc_freq`; `n_docs` is a one-row, one-column table.
    """
    idf = 1.0 + F.log(n_docs.scalar() / (F.col("doc_freq") + 1.0))
    clause = W.partitionBy("query_id", "occur", "clause")
    return (
        terms.withColumn("idf", idf)
        .withColumn("weight", F.col("boost") * F.pow(F.sum("idf").over(clause), 2.0))
        .drop("idf")
    )


def score_bounded(postings: DataFrame, terms: DataFrame, frequencies: DataFrame, lengths: DataFrame, n_docs: DataFrame,
                  require_all: bool = True, length: str = "n_terms", key: str = "doc_id") -> tuple[DataFrame, Cost]:
    """`score`, with the cost of the queries; it bounds the rows of the result."""
    probe = probe_terms(terms.where(F.col("occur") != MUST_NOT))
    weighted = fix_terms(weigh_terms(with_frequencies(probe, frequencies), n_docs), probe)
    cost = cost_of(weighted)
    if require_all:
        matched = match_required(postings, probe, weighted, cost, key)
    else:
        matched = match_clauses(postings, probe, weighted.drop("doc_freq"), key)
    summed = matched.groupBy("query_id", key).agg(
        F.expr("count(*) AS n"), F.expr("any_value(n_clauses) AS n_clauses"), F.expr("sum(sqrt(freq) * weight) AS raw"))
    if require_all:
        summed = summed.where("n = n_clauses")
    max_hits = cost.hits if require_all else cost.all_rows
    value = F.col("raw") * length_norm(F.col(length)) * (F.col("n") / F.col("n_clauses"))
    scored = lengths.select(key, length).join(broadcast_if(summed, max_hits), key).select(
        "query_id", key, F.round(value * 1e6).cast("long").alias("score"))
    return scored, cost


def score(postings: DataFrame, terms: DataFrame, frequencies: DataFrame, lengths: DataFrame, n_docs: DataFrame,
          require_all: bool = True, length: str = "n_terms", key: str = "doc_id") -> DataFrame:
    """(query_id, key, score): sum over clauses of sqrt(freq) * weight, times norm and coord.

    The score is in whole millionths. With `require_all` only documents that match every
    clause are kept, so coord is 1; otherwise it is matched clauses / all clauses.
    """
    return score_bounded(postings, terms, frequencies, lengths, n_docs, require_all, length, key)[0]


def score_bool(postings: DataFrame, terms: DataFrame, frequencies: DataFrame, lengths: DataFrame, n_docs: DataFrame,
               length: str = "n_terms", key: str = "doc_id") -> DataFrame:
    """(query_id, key, score) of the documents `search_bool` finds.

    Required and optional clauses that match add to the score; coord is matched clauses / all
    clauses that are not prohibited.
    """
    found = search_bool(postings, terms, key)
    return score(postings, terms, frequencies, lengths, n_docs, False, length, key).join(
        found, ["query_id", key], "left_semi")


def top_hits(scored: DataFrame, offset: int = PAGE_OFFSET, count: int = PAGE_SIZE, key: str = "doc_id") -> DataFrame:
    """(query_id, rank, key, score): one page per query, best first, ties by document order.

    The rank filter sits directly on the window, so each input task keeps only its own
    best rows before the shuffle: a query that matches a third of all documents sends
    one page per task.
    """
    page = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return (
        scored.withColumn("rank", F.row_number().over(page))
        .where(F.col("rank") <= offset + count).where(F.col("rank") > offset)
        .select("query_id", "rank", key, "score")
    )


def top_hits_single(scored: DataFrame, offset: int = PAGE_OFFSET, count: int = PAGE_SIZE,
                    key: str = "doc_id") -> DataFrame:
    """The page of a table that holds one query only: a plain top-k."""
    return scored.orderBy(F.col("score").desc(), key).offset(offset).limit(count)


def fetch(hits: DataFrame, docs: DataFrame, columns: list[str], max_hits: int | None = None,
          key: str = "doc_id") -> DataFrame:
    """Stored columns of a page of hits. `max_hits` is a bound on the rows of `hits`, if known.

    Few hits are worked out first, and their keys are pushed into the scan of the stored
    columns; the files of a table in key order are pruned by them.
    """
    stored = docs.select(key, *columns)
    if max_hits is not None and max_hits <= LOCAL_ROWS:
        hits, size = settle(hits)
        if size.rows <= PUSHED_VALUES:
            stored = stored.where(F.col(key).isin(*{r[0] for r in hits.select(key).collect()}))
    return stored.join(broadcast_if(hits, max_hits), key)
