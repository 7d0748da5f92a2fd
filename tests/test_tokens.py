import itertools
import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from prismdex.functions import tokens

SAMPLE = ("Mid-America O'Neil's I.B.M. AT&T joe.b@x-y.com www.a.com Brand#13 wi-fi2 3.14 1,000-2 the Board and Batten")
WORDS = ("mid america o'neil ibm at&t joe.b@x-y.com www.a.com brand 13 wi-fi2 3.14 1,000-2 the board and batten").split()


def tokenized(spark, texts, columns=("pos", "term")):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(tokens.tokenize_with_offsets("t").alias("x")).collect()
    return [[tuple(t[c] for c in columns) for t in row.x] for row in found]


def test_sample(spark):
    assert tokenized(spark, [SAMPLE]) == [list(enumerate(WORDS))]


def test_plain_and_located_tokens_agree(spark):
    df = spark.createDataFrame([(SAMPLE,), ("",), ("x",), (" a b's  c. ",)], "t string")
    both = df.select(tokens.tokenize("t").alias("a"), tokens.tokenize_with_offsets("t").alias("b")).collect()
    assert all([(t.pos, t.term) for t in r.a] == [(t.pos, t.term) for t in r.b] for r in both)


@pytest.mark.parametrize("text, terms", [
    ("e.g.something U.S.A. a.b.cd. I.B.M", ["e.g.something", "usa", "a.b.cd", "i.b.m"]),
    ("1-2-a-3-b 1.2-3 1.2.a.b.c-4 x.y-5", ["1-2-a-3-b", "1.2-3", "1.2.a.b.c", "4", "x.y", "5"]),
    ("www.a1.com.org.net a-1-b-c", ["www.a1.com.org.net", "a-1-b", "c"]),
    ("中文ab テ1 한국어", ["中", "文", "ab", "テ", "1", "한국어"]),
    ("joe@home O'NEIL'S a_b", ["joe@home", "o'neil", "a", "b"]),
    ("", []), ("  ...  ", []),
])
def test_words(spark, text, terms):
    assert [t for _, t in tokenized(spark, [text])[0]] == terms


def test_long_words_keep_their_position(spark):
    assert tokenized(spark, ["a " + "x" * 256 + " b " + "y" * 255]) == [[(0, "a"), (2, "b"), (3, "y" * 255)]]


def test_longest_match_of_the_word_grammar(spark):
    """The ordered pattern finds what a leftmost-longest matcher finds for the plain rules."""
    alnum, alpha, digit = r"[a-z0-9]+", r"[a-z]+", r"[a-z]*[0-9][a-z0-9]*"
    p = r"[_\-/.,]"
    rules = [
        alnum, f"{alpha}('{alpha})+", r"[a-z]\.([a-z]\.)+", f"{alpha}[&@]{alpha}",
        rf"{alnum}([._\-]{alnum})*@{alnum}([.\-]{alnum})+", rf"{alnum}(\.{alnum})+", rf"{alnum}\.({alnum}\.)+",
        f"{alnum}{p}{digit}", f"{digit}{p}{alnum}",
        f"{alnum}({p}{digit}{p}{alnum})+", f"{digit}({p}{alnum}{p}{digit})+",
        f"{alnum}{p}{digit}({p}{alnum}{p}{digit})+", f"{digit}{p}{alnum}({p}{digit}{p}{alnum})+",
    ]
    grammar = regex.compile("(?p)" + "|".join(rules))
    rng = random.Random(7)
    texts = ["".join(rng.choice("aab12..--_/,'&@ ") for _ in range(rng.randint(0, 18))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", tokens.raw_words("t").alias("w")).collect()
    wrong = [(r.t, r.w, want) for r in got if r.w != (want := [m.group() for m in grammar.finditer(r.t)])]
    assert wrong[:5] == []


def test_offsets_point_at_the_words(spark):
    text = "Ünï-2  foo,bar  3.14 x" + " word" * 400
    for pos, term, start, end in tokenized(spark, [text], ("pos", "term", "start", "end"))[0]:
        assert text[start:end].lower() == term


def test_very_long_runs(spark):
    texts = ["1," * 100_000 + "2", "a.b" * 50_000, "a'" * 50_000 + "b", "x" * 200_000, "ab " * 50_000, "a_" * 2_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.size(tokens.tokenize("t"))).collect()] == [0, 0, 0, 0, 50_000, 2_000]


def test_running_sums_cost_little_more_than_the_lengths(spark):
    from prismdex.functions.tokens import _running_sums

    def seconds(expression):
        best = float("inf")
        for _ in range(2):
            started = time.time()
            spark.sql(f"SELECT aggregate({expression}, 0L, (a, b) -> a + b) AS n FROM (SELECT transform(sequence(1, 2000000 + int(rand() * 2)), x -> x % 9) AS v)").collect()
            best = min(best, time.time() - started)
        return best

    for n in (0, 1, 31, 32, 33, 1024, 1025, 5000):
        row = spark.sql(f"SELECT transform(slice(sequence(0, {n}), 1, {n}), x -> x % 7) AS v").selectExpr("v", f"{_running_sums('v')} AS sums").first()
        assert row.sums == [sum(row.v[:i]) for i in range(n)] if n <= 33 else row.sums == list(itertools.accumulate(row.v[:-1], initial=0))
    # A sum over a slice for every element takes over sixty steps for each.
    assert seconds(_running_sums("v")) < 12 * seconds("transform(v, x -> x + 1)") + 0.2
