"""The test tables seen as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismdex.config import IndexConfig
from prismdex.plans.index import Index, index_of
from prismdex.registry import inputs
from prismdex.sources.documents import to_documents

PRODUCTS = IndexConfig()
ARTICLES = IndexConfig(facets=("lang", "source"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def products(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as products: the title is type and name."""
    return to_documents(table(spark, sf, "part"), {
        "doc_id": "p_partkey",
        "title": F.concat_ws(" ", "p_type", "p_name"),
        "Material": "p_type",
        "Style": F.split_part("p_name", F.lit(" "), F.lit(2)),
        "Mounting": F.when(F.col("p_size") <= 25, "Compact").otherwise("Full"),
        "Brand": "p_brand",
    }, PRODUCTS)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: long text in several languages."""
    return to_documents(table(spark, sf, "documents"), {
        "doc_id": "doc_id", "title": "text", "lang": "lang", "source": "source"}, ARTICLES)


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.sql(inputs.SYNONYMS_SQL)


def product_index(spark: SparkSession, sf: str) -> Index:
    return index_of(products(spark, sf), PRODUCTS, synonyms(spark))


def article_index(spark: SparkSession, sf: str, keep: bool = False) -> Index:
    return index_of(articles(spark, sf), ARTICLES, keep=keep)


def derived(spark: SparkSession, sf: str, name: str, sql: str) -> DataFrame:
    """The rows of `sql` over one test table."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf, name))


def name_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "part", inputs.NAME_PHRASES)


def swapped_names(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "part", inputs.SWAPPED_NAMES)


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "benchmark", inputs.PASSAGES)
