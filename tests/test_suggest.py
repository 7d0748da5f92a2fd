import pytest
from conftest import pairs

from prismdex.operators import response as J
from prismdex.operators import suggest as G
from prismdex.sources.store import open_table, write_table

INPUT = "input_id long, text string"
TYPED = {
    "sh": ("shutters", "shutters"),
    "s": ("standard southern suburban style_craft stylecraft shutters", "shutters style_craft stylecraft southern suburban standard"),
    "st": ("standard style_craft stylecraft", "style_craft stylecraft standard"),
    "cra": ("style_craft", "style_craft"),
    "c": ("composite style_craft custom", "custom style_craft composite"),
    "b": ("bahama batten board", "bahama batten board"),
    "foo RA": ("raised", "raised"),
    "and": ("", ""), "sh ": ("", ""), "  ": ("", ""), "style craft": ("style_craft", "style_craft"),
    "x" * 21: ("", ""),
}


def words(df):
    found = {}
    for r in df.orderBy("input_id", "rank").collect():
        found.setdefault(r.input_id, []).append(r.word.replace(" ", "_"))
    return found


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("column, order", list(enumerate(G.ORDERS)))
def test_typed_words(rows, index, column, order, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    inputs = rows(INPUT, *enumerate(TYPED), (100, None))
    want = {i: w[column].split() for i, w in enumerate(TYPED.values()) if w[column]}
    assert words(G.suggest(index.suggestions, inputs, order=order)) == want


def test_table(index):
    assert index.suggestions.count() == 153
    grams = {r.gram for r in index.suggestions.where("word = 'style craft'").collect()}
    assert grams == {"s", "st", "sty", "styl", "style", "c", "cr", "cra", "craf", "craft"}


def test_limit_and_gate(rows, index):
    inputs = rows(INPUT, (1, "s"), (2, "st"))
    assert words(G.suggest(index.suggestions, inputs, k=2)) == {1: ["standard", "southern"], 2: ["standard", "style_craft"]}
    assert set(words(G.suggest(index.suggestions, inputs, min_chars=2))) == {2}
    assert [r.input_id for r in G.passes_gate(inputs).collect()] == [2]
    with pytest.raises(ValueError):
        G.suggest(index.suggestions, inputs, order="alphabetical")


def test_grams_are_folded_but_typed_words_are_not(rows):
    table = G.build_suggestions(rows("term string, doc_freq long", ("schön", 3), ("ab", 9)))
    assert words(G.suggest(table, rows(INPUT, (1, "schön"), (2, "SCHON"), (3, "ab")))) == {2: ["schön"]}


def test_plain_terms_are_not_analysed_anew(rows):
    terms = ["the", "its", "a1b2", "x" * 255, "y" * 256, "abc\n", "mid-america", "rock'n'roll", "Abc", "schön", "abc abd"]
    analysed = f"flatten(transform({G.SUGGEST.tokens_sql('term')}, g -> {G.edge_ngrams_sql('g.term', *G.SUGGEST.grams)}))"
    asked = rows("term string, doc_freq long", *[(t, 1) for t in terms])
    want = asked.selectExpr(f"explode(array_distinct({analysed})) AS gram", "term AS word", "doc_freq")
    assert pairs(G.build_suggestions(asked)) == pairs(want)
    plain = G.build_suggestions(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(term" in plain and "{1,255}" in plain  # told by one test, before any word is looked for


def test_every_prefix_suggests_its_word(rows):
    terms = ["shutter", "a" * 30, "widget", "on1"]
    table = G.build_suggestions(rows("term string, doc_freq long", *[(t, 1) for t in terms])).cache()
    for t in terms:
        grams = sorted(r.gram for r in table.where(f"word = '{t}'").collect())
        assert grams == [t[:n] for n in range(1, min(len(t), 20) + 1)]


def test_json(rows, index):
    inputs = rows(INPUT, (1, "st"), (2, "zzz"))
    assert pairs(J.suggestions_json(inputs, G.suggest(index.suggestions, inputs))) == [
        (1, '["standard","style craft","stylecraft"]'), (2, "[]")]


def test_typed_words_reach_the_scan(rows, index, spark, tmp_path, capsys):
    path = str(tmp_path / "suggestions")
    write_table(index.suggestions, path, sort_by=["gram", "doc_freq", "word"], files=4)
    found = G.suggest(open_table(spark, path), rows(INPUT, (1, "sh"), (2, "ba")))
    found.explain("formatted")
    pushed = [line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line]
    assert any("In(gram" in line and "sh" in line and "ba" in line for line in pushed)
    assert words(found) == words(G.suggest(index.suggestions, rows(INPUT, (1, "sh"), (2, "ba"))))
