"""Nested and JSON forms of a result, for the few rows that are left after paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.config import IndexConfig
from prismdex.functions.words import is_blank


def assemble(queries: DataFrame, titles: DataFrame, facets: DataFrame, title: str = "title",
             fields: tuple[str, ...] = IndexConfig.facets) -> DataFrame:
    """One row per query (query_id, phrase), also without hits: Phrase (cleared), SelectionGroups (cleared), Results, FacetGroups.

    A phrase that was searched has a group for each of `fields`, without facets where there are no
    hits; a blank one has no group. `titles` is one page of (query_id, rank, title), `facets` are counts per value;
    both are bounded by the page size and the facet vocabulary.
    """
    listed = titles.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(title).alias("text")))), lambda r: r.text)
        .alias("Results"))
    counted = facets.groupBy("query_id", "field").agg(
        F.sort_array(F.collect_list(F.struct(F.col("value").alias("Name"), F.col("hit_count").alias("Count"))))
        .alias("Facets"))
    asked = queries.groupBy("query_id").agg(F.max(~is_blank("phrase")).alias("searched"))
    groups = asked.where("searched").select("query_id", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    no_facets = F.array().cast("array<struct<Name:string,Count:bigint>>")
    nested = groups.join(counted, ["query_id", "field"], "left").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("field").alias("Name"), F.coalesce("Facets", no_facets).alias("Facets"))))
        .alias("FacetGroups"))
    empty_groups = F.array().cast("array<struct<Name:string,Selections:array<string>>>")
    return asked.join(listed, "query_id", "left").join(nested, "query_id", "left").select(
        "query_id",
        F.lit("").alias("Phrase"),
        empty_groups.alias("SelectionGroups"),
        F.coalesce("Results", F.array().cast("array<string>")).alias("Results"),
        F.coalesce("FacetGroups", F.array().cast(
            "array<struct<Name:string,Facets:array<struct<Name:string,Count:bigint>>>>")).alias("FacetGroups"),
    )


def flatten_groups(assembled: DataFrame) -> DataFrame:
    """(query_id, field, value, hit_count): the facet groups as rows; a group without facets is one row without a value."""
    return assembled.select("query_id", F.explode("FacetGroups").alias("g")).select(
        "query_id", F.col("g.Name").alias("field"), F.explode_outer("g.Facets").alias("f")).select(
        "query_id", "field", F.col("f.Name").alias("value"), F.coalesce("f.Count", F.lit(0)).alias("hit_count"))


def to_response_json(assembled: DataFrame) -> DataFrame:
    """(query_id, response): the whole result of a query as one JSON text."""
    return assembled.select(
        "query_id", F.to_json(F.struct("Phrase", "SelectionGroups", "Results", "FacetGroups")).alias("response"))


def suggestions_json(inputs: DataFrame, suggested: DataFrame) -> DataFrame:
    """(input_id, response): the suggested words of every input as a JSON array, best first."""
    words = suggested.groupBy("input_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda r: r.word).alias("words"))
    return inputs.select("input_id").join(words, "input_id", "left").select(
        "input_id", F.to_json(F.coalesce("words", F.array().cast("array<string>"))).alias("response"))
