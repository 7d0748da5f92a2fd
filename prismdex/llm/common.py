"""Small helpers shared by the operators: word splitting, folds, bounded labelled samples, written tables."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismdex.sources.store import write_once

#: Separators of the "letters and digits" words: every other ASCII character.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered (bytes methods touch ASCII alone)."""
    return encode(text).lower().split()


#: Table for bytes.translate: A-Z lowered, digits and letters kept, other ASCII a space, the rest kept.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered."""
    return encode(text).translate(_PLAIN).split()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold.

    The sample is bounded by `rows` and chosen by a hash of the id, so it is the same in every
    run. A repeated id gives one row, that of its text of smallest hash. Labels that are null or neither 0
    nor 1 are left out; of several labels the largest counts.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .where(fold("doc_id", folds) != held_out)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    known = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    chosen = (
        chosen.join(known, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return known.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text")).select("doc_id", "text", "label")


@lru_cache(maxsize=1)
def kept_in_worker(make: Callable, *args):
    """`make(*args)`, one for all operators of a Python worker: what it has learnt serves the worker's next tasks.

    Workers outlive an operator, so the first task of another one frees it; two never fill a worker together.
    """
    return make(*args)


def settle(df: DataFrame, name: str) -> DataFrame:
    return write_once(df, name)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
