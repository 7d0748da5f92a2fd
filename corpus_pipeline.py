"""Documents to packed training sequences: quality, toxicity, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismdex.llm import packing, quality, simhash, toxicity, winnow
from prismdex.llm.common import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    scored = quality.score_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier accepts."""
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Repeated rows of an id and its text are one document. Different texts under one id are documents of their
    own, each in the group of its text; where they are in one group, the text of smallest hash stays. A document without an id
    stays.
    """
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row")
    named = docs.where("doc_id is not null").select(*COLUMNS, row)
    groups = simhash.near_duplicates(named.select(F.col("row").alias("doc_id"), "text"))
    member = groups.select(F.col("doc_id").alias("row"), "component_id").distinct()
    kept = named.select("doc_id", "row").distinct().join(member, "row").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "row")).alias("first")).select("first.*")
    stay = named.join(kept, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return stay.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    checked = winnow.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return checked.where(~F.col("contaminated")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op5_packing(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Classifiers and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
