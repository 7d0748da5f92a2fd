"""Facet counts, selections and the states and groupings built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismdex.config import IndexConfig
from prismdex.operators.dictionary import facet_values
from prismdex.operators.sizing import broadcast_if, lookup_join, settle
from prismdex.sources.store import write_once


def known_selections(selections: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Selections (query_id, field, value); an unknown field name raises when the rows are read."""
    known = F.col("field").isin(*cfg.facets)
    unknown = F.raise_error(F.concat(F.lit("unknown facet field: "), F.col("field")))
    return selections.select("query_id", F.when(known, F.col("field")).otherwise(unknown).alias("field"), "value")


def group_selections(boxes: DataFrame) -> DataFrame:
    """(query_id, field, value) of the checked boxes; a field without one is left out."""
    return boxes.where("checked").select("query_id", "field", "value")


def nest_selections(boxes: DataFrame) -> DataFrame:
    """(query_id, field, selections): the checked values of each field of a query."""
    return group_selections(boxes).groupBy("query_id", "field").agg(
        F.sort_array(F.collect_set("value")).alias("selections"))


def select_facets(docs: DataFrame, selections: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """(query_id, key): any selected value within a field, every selected field of the query.

    An equality join on (field, value); nothing is compared that does not match.
    """
    wanted, size = settle(known_selections(selections, cfg).distinct())
    fields = wanted.groupBy("query_id").agg(F.count_distinct("field").alias("n_fields"))
    met = lookup_join(facet_values(docs, cfg), wanted, ["field", "value"], "inner", cfg.key, size)
    counted = met.groupBy("query_id", cfg.key).agg(F.count("*").alias("n"))
    return lookup_join(counted, fields, "query_id", "inner", cfg.key, size).where("n = n_fields").select(
        "query_id", cfg.key)


def with_facets(hits: DataFrame, docs: DataFrame, cfg: IndexConfig = IndexConfig(),
                max_hits: int | None = None) -> DataFrame:
    """Hits with the facet columns of their documents; no other column of docs is read.

    With a small bound on the hits the documents are filtered where they are read;
    otherwise both sides meet by key.
    """
    return docs.select(cfg.key, *cfg.facets).join(broadcast_if(hits, max_hits), cfg.key)


def refine_hits(faceted: DataFrame, selections: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Hits with facet columns that pass the selections of their query.

    The selections of a query become one row of value arrays (as long as its list of
    checked boxes), so the hits are tested in place. A query without any passes whole.
    """
    arrays = [F.collect_set(F.when(F.col("field") == f, F.col("value"))).alias(f"_selected_{f}") for f in cfg.facets]
    wanted = known_selections(selections, cfg).groupBy("query_id").agg(*arrays)
    joined = lookup_join(faceted, wanted, "query_id", "left", cfg.key)
    for f in cfg.facets:
        chosen = F.col(f"_selected_{f}")
        passes = chosen.isNull() | (F.size(chosen) == 0) | F.array_contains(chosen, F.col(f))
        joined = joined.where(passes)
    return joined.drop(*[f"_selected_{f}" for f in cfg.facets])


def facet_counts(faceted: DataFrame, cfg: IndexConfig = IndexConfig(), min_hits: int = 1,
                 prefix: str | None = None) -> DataFrame:
    """(query_id, field, value, hit_count) over hits with facet columns: all fields in one pass."""
    rows = facet_values(faceted, cfg, ("query_id",))
    if prefix is not None:
        rows = rows.where(F.startswith(F.col("value"), F.lit(prefix)))
    counts = rows.groupBy("query_id", "field", "value").agg(F.count("*").alias("hit_count"))
    return counts.where(F.col("hit_count") >= min_hits) if min_hits > 1 else counts


def facet_counts_zero_filled(faceted: DataFrame, queries: DataFrame, vocabulary: DataFrame,
                             cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Facet counts with every vocabulary value of every query, zero if no hit has it.

    Each hit adds one to its values and each vocabulary value adds zero, in one aggregate.
    """
    ones = facet_values(faceted, cfg, ("query_id",)).select("query_id", "field", "value", F.lit(1).alias("n"))
    asked = queries.select("query_id", F.explode(F.array(*[F.lit(f) for f in cfg.facets])).alias("field"))
    zeros = lookup_join(vocabulary, asked, "field", "inner", "value").select(
        "query_id", "field", "value", F.lit(0).alias("n"))
    return ones.unionByName(zeros).groupBy("query_id", "field", "value").agg(F.sum("n").alias("hit_count"))


def multi_value_counts(hits: DataFrame, postings: DataFrame, prefix: str | None = None, field: str = "title",
                       key: str = "doc_id", max_hits: int | None = None) -> DataFrame:
    """(query_id, field, value, hit_count) of the terms of a text column.

    A posting is one term of one document, so a document counts once per term. A prefix is
    pushed into the scan of the postings; with a small bound on the hits these do not move.
    """
    terms = postings.select("term", key)
    if prefix is not None:
        terms = terms.where(F.startswith(F.col("term"), F.lit(prefix)))
    return (
        terms.join(broadcast_if(hits.select("query_id", key), max_hits), key)
        .groupBy("query_id", F.lit(field).alias("field"), F.col("term").alias("value"))
        .agg(F.count("*").alias("hit_count"))
    )


def facet_suggest(hits: DataFrame, postings: DataFrame, prefix: str, k: int = 8, field: str = "title",
                  key: str = "doc_id", max_hits: int | None = None) -> DataFrame:
    """The k terms with the prefix that most hits hold: (query_id, field, rank, value, hit_count)."""
    return top_facets(multi_value_counts(hits, postings, prefix, field, key, max_hits), k, "hits")


def _order(order: str) -> list[Column]:
    if order == "value":
        return [F.col("value")]
    if order == "hits":
        return [F.col("hit_count").desc(), F.col("value")]
    raise ValueError("order must be 'value' or 'hits'")


def top_facets(counts: DataFrame, k: int, order: str = "value") -> DataFrame:
    """The first k values of each field, with their rank; each task sends k rows per field."""
    within = W.partitionBy("query_id", "field").orderBy(*_order(order))
    return counts.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k)


def rank_facets(counts: DataFrame, order: str = "value", parts: int | None = None) -> DataFrame:
    """Every value of each field with its rank.

    A field may have more values than one task should sort, and all of them may begin alike. The rows are
    ranged by the full order, so a field is spread over as many parts as its rows fill; the table is written once with each
    row's place in its part. A rank is that place, less the place of the field's first value in the part, plus the
    number of its values in earlier parts: a table of one row per field and part.
    """
    by = ["query_id", "field", *_order(order)]
    ranged = counts.repartitionByRange(parts, *by) if parts else counts.repartitionByRange(*by)
    placed = write_once(ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at") - F.shiftleft("_part", 33))
    before = W.partitionBy("query_id", "field").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("query_id", "field", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).drop("_first", "_n")
    )
    shifts, size = settle(shifts)
    # No key of this join is hot: it has the rows of one part at most.
    return (
        placed.join(F.broadcast(shifts) if size.small else shifts, ["query_id", "field", "_part"])
        .withColumn("rank", F.col("_place") + F.col("_shift")).drop("_at", "_part", "_place", "_shift")
    )


def sort_facets(counts: DataFrame, order: str = "value") -> DataFrame:
    """Counts sorted by query, field and the order asked for."""
    return counts.orderBy("query_id", "field", *_order(order))


def facet_state(counts: DataFrame, selections: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Counts with `enabled`: a value is disabled when it has no hit and its field no selection."""
    chosen = known_selections(selections, cfg).select("query_id", "field", F.lit(True).alias("chosen")).distinct()
    return (
        lookup_join(counts, chosen, ["query_id", "field"], "left", "value")
        .withColumn("enabled", (F.col("hit_count") > 0) | F.coalesce("chosen", F.lit(False)))
        .drop("chosen")
    )


def facet_combinations(faceted: DataFrame, fields: list[str], k: int = 50, key: str = "doc_id") -> DataFrame:
    """Hits per combination of facet values: the count, and the first k documents of each."""
    counts = faceted.groupBy("query_id", *fields).agg(F.count("*").alias("hit_count"))
    order = W.partitionBy("query_id", *fields).orderBy(key)
    first = (
        faceted.select("query_id", *fields, key).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ["query_id", *fields]]
    return first.alias("h").join(counts.alias("c"), same).select(
        *[F.col(f"h.{c}") for c in ["query_id", *fields]], "c.hit_count", "h.rank", f"h.{key}")
