"""Tables of nested expressions against Python sets."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from conftest import PRODUCT_ROWS, pairs
from prismdex.operators import expressions as X
from prismdex.registry import inputs
from prismdex.sources import store

NODES = "query_id long, node int, parent int, op string, text string"
WORDS = ("custom", "wood", "vinyl", "louvered", "panel", "bahama", "mid-america", "board and batten", "the", "nothing", "Standard")
TITLES = {row[0]: f" {row[1].lower().replace('-', ' ')} " for row in PRODUCT_ROWS}


def holds(rows, node, doc):
    """True, False, or None for what vanishes."""
    _, _, _, op, text = next(r for r in rows if r[1] == node)
    if op == "term":
        return None if text == "the" else f" {text.lower().replace('-', ' ')} " in TITLES[doc]
    below = [h for r in rows if r[2] == node for h in [holds(rows, r[1], doc)] if h is not None]
    if not below:
        return None
    return all(below) if op == "and" else any(below) if op == "or" else not any(below)


def brute(rows):
    out = []
    for query in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == query]
        root = next(r[1] for r in own if r[2] is None)
        out += [(query, doc) for doc in TITLES if holds(own, root, doc)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, NODES)


def generated(count, depth, seed):
    return [(q, n, p or None, op, text) for q, n, p, op, text in inputs.expressions(count, depth, WORDS, seed)]


@pytest.mark.parametrize("depth, seed", [(2, 1), (4, 2), (6, 3)])
def test_generated_expressions(spark, index, depth, seed):
    rows = generated(40, depth, seed)
    assert pairs(X.search_expressions(index.postings, table(spark, rows).repartition(3), index.docs)) == brute(rows)


def test_salted_joins(spark, index, no_broadcast, monkeypatch):
    monkeypatch.setattr(X, "NEGATIVE_BLOCK", 2)
    rows = generated(25, 3, 9)
    assert pairs(X.search_expressions(index.postings, table(spark, rows), index.docs)) == brute(rows)


def test_leaves_negations_and_what_vanishes(spark, index):
    rows = [
        (1, 1, None, "term", "Bahama"), (2, 1, None, "not", ""), (2, 2, 1, "term", "custom"),
        (3, 1, None, "and", ""), (3, 2, 1, "term", "the"), (3, 5, 1, "term", "bahama"),  # stop word
        (4, 1, None, "not", ""), (4, 2, 1, "or", ""), (4, 3, 2, "term", "the"),  # nothing left
        (5, 1, None, "or", ""), (6, 7, None, "not", ""), (6, 8, 7, "term", "nothing"),
    ]
    got = pairs(X.search_expressions(index.postings, table(spark, rows), index.docs))
    assert got == brute(rows)
    assert {q for q, _ in got} == {1, 2, 3, 6} and sum(q == 6 for q, _ in got) == len(TITLES)


def test_no_expressions_and_no_documents(spark, index):
    assert pairs(X.search_expressions(index.postings, table(spark, []), index.docs)) == []
    rows = [(1, 1, None, "not", ""), (1, 2, 1, "term", "custom")]
    assert pairs(X.search_expressions(index.postings.limit(0), table(spark, rows), index.docs.limit(0))) == []


@pytest.mark.parametrize("rows", [
    [(1, 2, None, "or", ""), (1, 1, 2, "term", "wood")], [(1, 1, None, "xor", "")],
    [(1, 1, None, "term", "wood"), (1, 2, None, "term", "custom")], [(1, 2, 1, "term", "wood")],
])
def test_malformed_expressions(spark, index, rows):
    with pytest.raises(PySparkException):
        X.search_expressions(index.postings, table(spark, rows), index.docs).collect()


def test_one_aggregate_for_any_depth(spark, index):
    """Groups are decided on the row of a document: the plan of a deep table has no more joins than that of a flat one."""
    plans = []
    for depth in (1, 6):
        found = X.search_expressions(index.postings, table(spark, generated(5, depth, 4)), index.docs.where("false"))
        plans.append(found._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert plans[0] == plans[1] > 0


def test_an_expression_is_decided_once_for_each_set_of_leaves(spark, index, rows, monkeypatch):
    kept = {}
    monkeypatch.setattr(X, "write_once", lambda df, name: kept.setdefault(name, store.write_once(df, name)))
    nodes = rows("query_id long, node int, parent int, op string, text string", (1, 1, None, "or", ""), (1, 2, 1, "term", "wood"),
                 (1, 3, 1, "term", "hybrid"), (2, 1, None, "not", ""), (2, 2, 1, "term", "shutters"))
    found = X.search_expressions(index.postings, nodes, index.docs)
    assert pairs(found) == [(1, i) for i in (*range(4, 10), *range(14, 18))]
    assert kept["leaves"].count() == 28 and kept["leaves"].select("query_id", "matched").distinct().count() == 3
    # What was decided is joined to the documents; nothing is decided for each of them.
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
