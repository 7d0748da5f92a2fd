import pytest
from pyspark.sql import functions as F

from prismdex.config import SUGGEST_STOP_WORDS, TEXT_STOP_WORDS
from prismdex.functions import folding, ngrams, stopwords, tokens, words


def one(spark, column, **values):
    names = ", ".join(f"{n} string" for n in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize("text, folded", [
    ("éóèñçüêäöí", "eoencueaoi"), ("straße", "strasse"), ("Æon œuf", "AEon oeuf"), ("ﬁn", "fin"), ("Łódź", "Lodz"),
    ("plain", "plain"), ("中文", "中文"), ("“it’s”", "\"it's\""),
])
def test_ascii_fold(spark, text, folded):
    assert one(spark, folding.ascii_fold("t"), t=text) == folded


def test_stop_words():
    assert len(TEXT_STOP_WORDS) == 33 and len(SUGGEST_STOP_WORDS) == 35
    assert set(SUGGEST_STOP_WORDS) - set(TEXT_STOP_WORDS) == {"i", "s", "t"}
    assert set(TEXT_STOP_WORDS) - set(SUGGEST_STOP_WORDS) == {"it"}


def test_remove_stops(spark):
    text = tokens.tokenize_sql("t")
    keep = one(spark, F.expr(stopwords.remove_stops_sql(text)), t="The board and it i batten")
    assert [(t.pos, t.term) for t in keep] == [(1, "board"), (4, "i"), (5, "batten")]
    close = one(spark, F.expr(stopwords.remove_stops_sql(text, SUGGEST_STOP_WORDS, gaps=False)), t="The board and it i batten")
    assert [(t.pos, t.term) for t in close] == [(0, "board"), (1, "it"), (2, "batten")]


def test_edge_ngrams(spark):
    assert one(spark, ngrams.edge_ngrams("t", "front", 1, 3), t="abcd") == ["a", "ab", "abc"]
    assert one(spark, ngrams.edge_ngrams("t", "back", 2, 9), t="abcd") == ["cd", "bcd", "abcd"]
    assert one(spark, ngrams.edge_ngrams("t"), t="abcd") == ["a"]
    assert one(spark, ngrams.edge_ngrams("t", "front", 3, 5), t="ab") == []
    assert one(spark, ngrams.edge_ngrams("t", "front", 1, 20), t="") == []


def test_edge_ngram_offsets(spark):
    grams = one(spark, ngrams.edge_ngrams_with_offsets("t", "10", "back", 1, 2), t="abc")
    assert [tuple(g) for g in grams] == [("c", 12, 13), ("bc", 11, 13)]
    grams = one(spark, ngrams.edge_ngrams_with_offsets("t", "10", "front", 2, 3), t="abc")
    assert [tuple(g) for g in grams] == [("ab", 10, 12), ("abc", 10, 13)]


@pytest.mark.parametrize("args", [("middle", 1, 2), (None, 1, 2), ("front", 0, 2), ("front", 3, 2)])
def test_bad_gram_sizes(args):
    with pytest.raises(ValueError):
        ngrams.edge_ngrams("t", *args)


@pytest.mark.parametrize("text, last", [("new eng", "eng"), ("one", "one"), ("one ", ""), ("a\tb", "b"), ("", "")])
def test_last_word(spark, text, last):
    assert one(spark, words.last_word("t"), t=text) == last


def test_slug_and_blank(spark):
    assert one(spark, words.slug("t"), t="Board and-Batten\tx") == "Board_and_Batten_x"
    assert [one(spark, words.is_blank("t"), t=t) for t in ("", "  \t", "a", None)] == [True, True, False, True]


@pytest.mark.parametrize("phrase, word, done", [
    ("new eng", " england ", "new england"), ("eng", "england", "england"), ("new  old x", "y", "new old y"),
    ("new ", "wood", "new wood"),
])
def test_complete_phrase(spark, phrase, word, done):
    assert one(spark, words.complete_phrase("p", "w"), p=phrase, w=word) == done
