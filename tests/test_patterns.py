"""Intervals pushed into the sorted dictionary, the written gram table, and the kept suggestions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import pairs
from prismdex.operators import patterns as P
from prismdex.operators import suggest as G
from prismdex.operators.analysis import SYNONYM, analyze
from prismdex.operators.dictionary import build_postings
from prismdex.plans import index as I
from prismdex.sources import store

WORDS = sorted({"a", "ab", "abc", "abd", "b", "ba", "zz", "é", "éa", "été", "z\U0010ffff", "z\U0010ffffa", "\ud7ff", "\ue000", "100%", "a_b", "a\\b",
                *("w" + "".join(random.Random(i).choices("abé漢", k=4)) for i in range(300))})


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("words") / "terms")
    rows = spark.createDataFrame([(w, 1 + i % 7) for i, w in enumerate(WORDS)], "term string, doc_freq long")
    store.write_table(rows, path, sort_by=["term"], files=3)
    return store.open_table(spark, path)


@pytest.fixture(params=["pushed", "blocks", "keys"])
def way(request, monkeypatch):
    if request.param == "blocks":
        monkeypatch.setattr(P, "_BLOCK", 2)
    if request.param == "keys":
        monkeypatch.setattr(P, "PUSHED_VALUES", 0)


def less(a, b):
    return a.encode() < b.encode()


def test_prefixes(spark, words, way):
    asked = ["a", "A", "w", "é", "z\U0010ffff", "\ud7ff", "zzz", "", None, "a_", "wab", "100%"]
    got = P.match_prefix(words, spark.createDataFrame(list(enumerate(asked)), "query_id long, prefix string"))
    assert pairs(got) == sorted((i, w) for i, p in enumerate(asked) if p for w in WORDS if w.startswith(p.lower()))


def test_ranges(spark, words, way):
    bounds = [("ab", "b"), ("a", None), (None, "abc"), (None, None), ("b", "a"), ("é", "é"), ("wa", "wb"), ("wab", "wé"), ("zzz", None), ("", "a")]
    asked = [(i * 2 + j, low, high, bool(j)) for i, (low, high) in enumerate(bounds) for j in (0, 1)]
    want = sorted(
        (q, w) for q, low, high, closed in asked for w in WORDS
        if (low is None or less(low, w) or closed and low == w) and (high is None or less(w, high) or closed and high == w)
        and not (low is not None and high is not None and less(high, low)))
    assert pairs(P.match_ranges(words, spark.createDataFrame(asked, "query_id long, low string, high string, inclusive boolean"))) == want


def test_wildcards(spark, words, way):
    import fnmatch

    asked = ["a*", "A?c", "w*é", "w?b?*", "100%*", "a_*", "a\\*", "zz", None, "wa*a"]
    got = P.match_pattern(words, spark.createDataFrame(list(enumerate(asked)), "query_id long, pattern string"))
    want = sorted((i, w) for i, p in enumerate(asked) if p for w in WORDS if fnmatch.fnmatchcase(w, p.lower().replace("[", "[[]")))
    assert pairs(got) == want


def test_no_patterns(spark, words, way):
    assert P.match_prefix(words, spark.createDataFrame([], "query_id long, prefix string")).collect() == []
    assert P.match_ranges(words, spark.createDataFrame([], "query_id long, low string, high string, inclusive boolean")).collect() == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_intervals_reach_the_scan(spark, words):
    asked = spark.createDataFrame([(1, "ab*"), (2, "w*")], "query_id long, pattern string")
    text = plan(P.match_pattern(words, asked))
    assert "And(GreaterThanOrEqual(term,w)" in text and "LessThanOrEqual(term,ac)" in text and "Join" not in text
    ranges = spark.createDataFrame([(1, "b", None, True), (2, None, "a", True)], "query_id long, low string, high string, inclusive boolean")
    assert "GreaterThanOrEqual(term,b)" in plan(P.match_ranges(words, ranges))


def test_pieces_are_distinct_before_they_are_made(rows):
    twice = rows("term string, doc_freq long", ("aab", 1), ("aab", 2), ("", 1), ("é", 1), (None, 1))
    grams = P.fuzzy_grams(twice)
    assert sorted(map(tuple, grams.collect())) == [
        ("a", 0, "aab"), ("a", 1, "aab"), ("aa", 0, "aab"), ("ab", 1, "aab"), ("b", 2, "aab"), ("é", 0, "é")]
    plan = grams._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the pieces themselves are not shuffled


@pytest.mark.parametrize("min_sim", [0.0, 0.5, 0.7])
def test_fuzzy_by_the_written_grams(spark, words, tmp_path, min_sim, monkeypatch):
    path = str(tmp_path / "grams")
    store.write_table(P.fuzzy_grams(words), path, sort_by=["piece", "at", "term"], files=3)
    grams = store.open_table(spark, path)
    asked = spark.createDataFrame([(1, "abd"), (2, "wabéa"), (3, "ÉTÉ"), (4, ""), (5, "w漢"), (6, "q")], "query_id long, word string")
    plain = pairs(P.match_fuzzy(words, asked, min_sim))
    found = P.match_fuzzy(words.where("false"), asked, min_sim, grams)  # the dictionary is not read
    assert pairs(found) == plain and plain
    assert "In(piece" in plan(found)
    monkeypatch.setattr(P, "PUSHED_VALUES", 0)
    assert pairs(P.match_fuzzy(words, asked, min_sim, grams)) == plain
    assert P.match_fuzzy(words, asked.limit(0), min_sim, grams).collect() == []


@pytest.mark.parametrize("order", G.ORDERS)
@pytest.mark.parametrize("k", [1, 8, 9, 40])
def test_kept_suggestions(spark, words, order, k):
    suggestions = G.build_suggestions(words.select("term", "doc_freq"))
    best = G.best_suggestions(suggestions)
    asked = spark.createDataFrame([(1, "a"), (2, "new W"), (3, "wa"), (4, "é"), (5, " "), (6, None), (7, "q"), (8, "w")], "input_id long, text string")
    want = pairs(G.suggest(suggestions, asked, k, order))
    assert pairs(G.suggest(suggestions, asked, k, order, best=best)) == want and want
    if k <= 8:  # the full table is not read
        assert pairs(G.suggest(suggestions.where("false"), asked, k, order, best=best)) == want
    rows = best.groupBy("order", "gram").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert all(r.n == r.last <= 8 for r in rows)


def test_kept_suggestions_without_broadcast(spark, words, no_broadcast):
    suggestions = G.build_suggestions(words.select("term", "doc_freq"))
    asked = spark.createDataFrame([(i, "w" if i % 2 else "é") for i in range(20)], "input_id long, text string")
    assert pairs(G.suggest(suggestions, asked, best=G.best_suggestions(suggestions))) == pairs(G.suggest(suggestions, asked))


def test_built_tables(spark, docs, index, tmp_path):
    path = str(tmp_path / "index")
    I.build_index(spark, docs, path, synonyms=I.default_synonyms(spark), files=2)
    built = I.open_index(spark, path)
    assert pairs(built.best) == pairs(index.best) and pairs(built.grams) == pairs(index.grams)


def test_a_word_is_normalised_once_however_many_tests_its_term_meets(spark, rows):
    terms = analyze(rows("doc_id long, title string", (1, "Than that's this")), "title", SYNONYM)
    plan = terms.where("term >= 'than' AND term <= 'thb' OR term LIKE 'x%'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert pairs(terms.where("term >= 'than' AND term <= 'thb'")) == [(1, 0, "than")]


def test_found_terms_are_worked_out_once(spark, rows, monkeypatch):
    postings = rows("term string, doc_id long", *[(t, d) for d in range(40) for t in ("a", "b")], ("c", 3), ("c", 3))
    found = rows("query_id long, term string", (1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "z"))
    want = [(1, d) for d in range(40)] + [(2, 3)]
    for rows_broadcast in (P.FOUND_ROWS, 0):
        monkeypatch.setattr(P, "FOUND_ROWS", rows_broadcast)
        monkeypatch.setattr(P, "PUSHED_VALUES", 0)
        written = []
        monkeypatch.setattr(P, "write_once", lambda df, name: written.append(name) or store.write_once(df, name))
        met = P.postings_of(postings, found)
        assert written == ["found"]
        assert pairs(met) == want
        assert ("BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()) == bool(rows_broadcast)


def test_only_postings_of_found_terms_are_shuffled(spark, rows, monkeypatch):
    docs = rows("doc_id long, title string", *[(i, "plate gear ring") for i in range(30)], (30, "gear"))
    postings = build_postings(analyze(docs, "title", SYNONYM))
    monkeypatch.setattr(P, "PUSHED_VALUES", 0)
    met = P.postings_of(postings, rows("query_id long, term string", (1, "ring"), (2, "gear"), (2, "ring")))
    assert pairs(met) == [(1, i) for i in range(30)] + [(2, i) for i in range(31)]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [term") < plan.index("LeftSemi")


@pytest.mark.parametrize("match, asked", [
    (P.match_prefix, "SELECT * FROM VALUES (1L, 'Wa') AS t(query_id, prefix)"), (P.match_pattern, "SELECT * FROM VALUES (1L, 'Wa*') AS t(query_id, pattern)"),
    (P.match_fuzzy, "SELECT * FROM VALUES (1L, 'Wabb') AS t(query_id, word)"),
    (P.match_ranges, "SELECT * FROM VALUES (1L, 'A', 'Ab', true) AS t(query_id, low, high, inclusive)"),
])
def test_literal_rows_are_lowered_by_tasks(spark, words, monkeypatch, capsys, match, asked):
    settled, settle = [], P.settle
    monkeypatch.setattr(P, "settle", lambda df: settled.append(df) or settle(df))
    assert match(words, spark.sql(asked)).count()
    capsys.readouterr()
    settled[0].explain()  # without a Generate the plan is a local table, worked out by the optimizer
    assert "lower(" in capsys.readouterr().out
