"""The packed counters against a count of every document under every order."""

from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from prismdex.llm import filter_audit as A

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, part string, digest string, mask int, good boolean"
LABELS = "doc_id long, quality int, toxic int, good string"


def failed(docs):
    """(id, part, letters failed) by the rules as they are worded."""
    first = {}
    for doc, text, *_ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, _, source, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield doc, source or "", "".join(
            letter for letter, fails in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                bool(re.search(r"[#$%&*|]", t)), doc is not None and first[t] < doc)) if fails)


def brute(docs, labels):
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x, *_ in labels if x == 1 and d is not None}
    rows = list(failed(docs))
    out = {}
    for part in {p for _, p, _ in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                out[part, order, step] = dict.fromkeys((*A.KINDS, "shapley"), 0)
    for doc, part, fails in rows:
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                c = out[part, order, step]
                hit = letter in fails
                c["redundant"] += gone and hit
                c["removed"] += hit and not gone
                c["good_lost"] += hit and not gone and doc in good
                c["toxic_lost"] += hit and not gone and doc in toxic
                gone = gone or hit
                c["kept"] += not gone
                c["unique_fails"] += fails == letter
    shares = {}
    for (part, order, step), c in out.items():
        shares[part, order[step - 1]] = shares.get((part, order[step - 1]), 0) + c["removed"]
    for (part, order, step), c in out.items():
        c["shapley"] = shares[part, order[step - 1]]
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): {k: r[k] for k in (*A.KINDS, "shapley")} for r in df.collect()}


long_text = " ".join(f"w{i}" for i in range(220))
ODD = [
    (1, long_text), (2, long_text), (2, long_text), (None, long_text), (3, None), (4, ""), (5, "A# " * 300), (6, "A# " * 300),
    (7, " \t\n"), (8, "É " + long_text), (9, long_text.upper()), (None, None), (10, long_text + " |"), (11, "w " * 40_000),
]
ODD_ROWS = [(d, t, "en", ["x", None, "", "y"][i % 4], "p", "q", 7, True) for i, (d, t) in enumerate(ODD)]
ODD_LABELS = [(1, 1, 0, "a"), (2, 0, 1, "a"), (2, 1, None, "b"), (3, None, None, None), (5, 1, 1, "c"), (None, 1, 1, "d"), (99, 1, 1, "e"), (9, 7, 1, "")]


def test_odd_rows_against_brute_force(spark):
    docs, labels = spark.createDataFrame(ODD_ROWS, DOCS), spark.createDataFrame(ODD_LABELS, LABELS)
    assert found(A.op11_filter_audit(docs.repartition(3), labels)) == brute(ODD_ROWS, ODD_LABELS)


def test_given_table_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in docs.collect()]
    marks = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()]
    got = found(A.op11_filter_audit(docs, labels))
    assert got == brute(rows, marks)
    assert len(got) == 600 * len({r[3] for r in rows})


def test_empty_table(spark):
    assert A.op11_filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    docs = spark.createDataFrame(ODD_ROWS, DOCS)
    assert found(A.op11_filter_audit(docs, spark.createDataFrame([], LABELS))) == brute(ODD_ROWS, [])


def test_counts_beyond_32_bits_do_not_carry(spark):
    """Sums are of rows, so a field near 2**63 must leave its neighbours alone."""
    most = 2 ** 62
    total = most * A.packed(3, True, False) + most * A.packed(0, False, True) + 5 * A.packed(2, True, True)
    counts = A.unpacked(total)
    first = A.orders(A.LETTERS).index("ABCDE")
    at = {k: counts[i, first].tolist() for i, k in enumerate(A.KINDS)}
    assert at["removed"] == [most, 5, 0, 0, 0] and at["redundant"] == [0, most, 0, 0, 0]
    assert at["kept"] == [most + 5, most, most, most, most]
    assert at["good_lost"] == [most, 5, 0, 0, 0] and at["toxic_lost"] == [0, 5, 0, 0, 0] and at["unique_fails"] == [0, 5, 0, 0, 0]


@pytest.mark.parametrize("letters", ["A", "XYZ"])
def test_other_numbers_of_filters(spark, letters):
    flags = spark.range(0, 64, 1, 4).select(
        F.lit("p").alias("part"), (F.col("id") % 2 ** len(letters)).cast("int").alias("mask"), F.lit(True).alias("good"), F.lit(False).alias("toxic"))
    rows = A.audit(flags, letters).collect()
    assert len(rows) == len(A.orders(letters)) * len(letters)
    assert all(r["kept"] == 64 >> r["step"] and r["removed"] == 64 >> r["step"] for r in rows)
