"""Filter interaction audit: what each filter removes in every order of the filters.

A document's outcome under all 120 orders of five filters depends on its mask alone, the set of filters that it
fails. Every mask stands for one wide integer of 64-bit fields, which hold the outcomes of all 600 steps. The
integers of a part's documents are added up and the sum is unpacked into the counts of all orders at once. A
field of one document is 0 or 1, so a field of the sum is at most the part's number of rows, a long: no carry
leaves a field. Equal masks of a part are counted before they move, so a part of any size arrives at its sum as at
most 128 rows, each of which adds its integer as often as it was counted.

The text is read once, in place. What goes on is one narrow row per document, written once: the id, the part, the
text's SHA-256 and the mask of the filters that look at the text. A copy is a document whose id is not the smallest
of its digest; it is told by a join on digest and id, on which a large group of copies spreads evenly.

Null texts are empty, null parts the empty string. A document without an id is no copy and has no label; rows that
repeat an id and its text are no copies of each other, but each counts. Of several labels of an id one
that is set suffices. An empty table has no part and gives no row. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import settle

LETTERS = "ABCDE"
KINDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that start no code point.
FOLLOWING = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rules:
    """Bounds of the four filters that look at one text."""

    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2
    signs: bytes = b"#$%&*|"


def text_mask(text: bytes, rules: Rules = Rules()) -> int:
    """Bit i is set if the text fails filter i: few words, repeated words, capitals, signs."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, FOLLOWING))
    return (
        (len(words) < rules.least_words)
        | (100 * len(set(words)) < rules.distinct_percent * len(words)) << 1
        | (100 * capitals > rules.capital_percent * points) << 2
        | (len(text.translate(None, rules.signs)) < len(text)) << 3
    )


def text_masks(content: Column, rules: Rules = Rules()) -> Column:
    @F.pandas_udf("int")
    def masks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_mask(t, rules) for t in texts], dtype="int32")

    return masks(content)


def flagged(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(part, mask, good, toxic) of each row of docs; bit 4 of the mask tells copies."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = settle(docs.select(
        F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(content, 256)).alias("digest"), text_masks(content, rules).alias("mask")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left").select(
        "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(letters: str) -> list[str]:
    return ["".join(order) for order in permutations(letters)]


@lru_cache(maxsize=256)
def packed(mask: int, good: bool, toxic: bool, letters: str = LETTERS) -> int:
    """The outcomes of all steps of all orders, one field each, as one integer."""
    fields = np.zeros((len(KINDS), len(orders(letters)), len(letters)), "<u8")
    for o, order in enumerate(orders(letters)):
        gone = False
        for s, letter in enumerate(order):
            bit = 1 << letters.index(letter)
            removed = bool(mask & bit) and not gone
            redundant = bool(mask & bit) and gone
            gone = gone or removed
            fields[:, o, s] = not gone, removed, redundant, mask == bit, removed and good, removed and toxic
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, letters: str = LETTERS) -> np.ndarray:
    """(kind, order, step) counts of a sum of packed integers."""
    shape = (len(KINDS), len(orders(letters)), len(letters))
    return np.frombuffer(total.to_bytes(FIELD_BYTES * int(np.prod(shape)), "little"), "<u8").reshape(shape).astype("int64")


def audit(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts per part, order and step of rows (part, mask, good, toxic); bit i of a mask is the filter letters[i]."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(n * packed(mask, good, toxic, letters)
                    for mask, good, toxic, n in zip(*(rows[c].tolist() for c in ("mask", "good", "toxic", "n"))))
        counts = unpacked(total, letters)
        names = orders(letters)
        steps = pd.DataFrame({
            "part": key[0], "filter_order": np.repeat(names, len(letters)),
            "step": np.tile(np.arange(1, len(letters) + 1, dtype="int32"), len(names)),
        } | {kind: counts[k].ravel() for k, kind in enumerate(KINDS)})
        filters = pd.Series(list("".join(names)))
        return steps.assign(shapley=steps["removed"].groupby(filters).transform("sum"))

    kinds = ", ".join(f"{kind} long" for kind in KINDS)
    return (
        flags.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("part").applyInPandas(count, f"part string, filter_order string, step int, {kinds}, shapley long")
    )


def op11_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(flagged(docs, labels))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), failed AS (
  SELECT words.doc_id, part,
    concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
      CASE WHEN min(words.doc_id) OVER (PARTITION BY t) < words.doc_id THEN 'E' END) AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), outcomes AS (
  SELECT *, contains(fails, x) AS hit, earlier <> '' AND regexp_matches(fails, '[' || earlier || '0]') AS gone
  FROM counted, steps
), sums AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM sums
"""
