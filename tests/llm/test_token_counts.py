"""Token counts against the libraries, and what the cache spares."""

from __future__ import annotations

import os

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismdex.llm import token_counts as C
from prismdex.sources.store import workspace

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, digest string, n int, hot long"
TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "same text"), (5, "same text"), (5, "same text"), (None, "no id"), (6, "a  b   c \n d\t\te \n\n"),
    (7, "x <|endoftext|> y  <|endoftext|>z<|ENDOFTEXT|>"), (8, "word " * 50_000), (9, "漢字 é ß \x00 \x1c a \x85b  c"), (10, "a" * 70_000),
    (11, "it's  we'll 'tis 3.14 $%& ..."), (12, " " * 5_000 + "end"), (13, "  nbsp  x"),
]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return C.TokenizersCounter(C.Tokenizer.read(public_tokenizers.path("byte_bpe_50k.json")).data)


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in TEXTS], DOCS)


def plain(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def counts(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in df.collect()), key=repr)


def test_odd_texts_as_the_library_counts_them(spark, odd, library):
    want = sorted(((d, len((t or "").encode()), plain(library, t)) for d, t in TEXTS), key=repr)
    got = C.op12_token_counts(odd)
    assert counts(got) == want
    assert {(r["n_tokens"] > 1024) == r["over_limit"] for r in got.collect()} == {True}


def test_given_table_as_the_library_counts_it(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), plain(library, r["text"])) for r in docs.collect()), key=repr)
    assert counts(C.op12_token_counts(docs.repartition(4))) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(
    st.sampled_from([*" \n\t'a1.,é漢\x1c\x85\xa0\u2028", "  ", "<|endoftext|>", "'s", " x"]), st.characters(codec="utf-8")), max_size=30))
def test_pieces_add_up(library, counter, parts):
    text = "".join(parts)
    assert counter.count(text) == plain(library, text)


def test_forgetting_pieces_changes_nothing(library):
    small = C.TokenizersCounter(C.Tokenizer.read(C.default_tokenizer()).data, keep=10)
    for text in [t for _, t in TEXTS if t and len(t) < 1000] * 2:
        assert small.count(text) == plain(library, text)


def test_second_run_encodes_nothing(spark, odd, monkeypatch):
    cache = workspace(spark, "cache")
    first = counts(C.count_tokens(odd, cache=cache))
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in TEXTS})

    def refuse(*_):
        raise AssertionError("encoded again")

    monkeypatch.setattr(C, "encoded", refuse)
    assert counts(C.count_tokens(odd, cache=cache)) == first


def test_only_distinct_misses_are_encoded(spark, monkeypatch):
    cache, seen, encoded = workspace(spark, "cache"), [], C.encoded

    def spy(texts, tokenizer):
        seen.append(sorted(bytes(r["content"]).decode() for r in texts.collect()))
        return encoded(texts, tokenizer)

    monkeypatch.setattr(C, "encoded", spy)
    rows = [(i, t) for i, t in enumerate(["one", "two", "one", "three", "two"])]
    C.count_tokens(spark.createDataFrame(rows[:2], "doc_id long, text string"), cache=cache).collect()
    C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cache=cache).collect()
    assert seen == [["one", "two"], ["three"]]


def test_versions_are_kept_apart_and_repeated_entries_count_once(spark, library):
    cache, docs = workspace(spark, "cache"), spark.createDataFrame([(1, "Some Words here"), (2, "Some Words here")], "doc_id long, text string")
    by_bytes = counts(C.count_tokens(docs, cache=cache))
    piece = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    want = len(sentencepiece.SentencePieceProcessor(model_file=piece).encode("Some Words here"))
    assert [n for *_, n in counts(C.count_tokens(docs, piece, cache))] == [want, want]
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)  # a second writer
    assert counts(C.count_tokens(docs, cache=cache)) == by_bytes
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_tokenizers_of_other_kinds_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(t for _, t in TEXTS)), "doc_id long, text string")
    assert [n for *_, n in sorted(counts(C.count_tokens(docs, path)))] == want
    with pytest.raises(ValueError):
        C.Tokenizer.read("tokenizer.txt")


def test_hot_digests_and_many_misses(spark, library, monkeypatch):
    """The ways of large tables: copies beyond the bound, misses beyond what is broadcast, joins by salt."""
    from prismdex.operators.sizing import Size

    monkeypatch.setattr(C, "HOT_ROWS", 3)
    monkeypatch.setattr(C, "BROADCAST_ROWS", 4)
    monkeypatch.setattr(Size, "small", property(lambda self: False))
    docs = spark.range(0, 300, 1, 5).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the hot text")).otherwise(F.concat(F.lit("text "), F.col("id") % 150)).alias("text"))
    want = sorted(((r["doc_id"], len(r["text"]), plain(library, r["text"])) for r in docs.collect()), key=repr)
    assert counts(C.op12_token_counts(docs)) == want


def test_empty_table(spark):
    cache, none = workspace(spark, "cache"), spark.createDataFrame([], DOCS)
    assert C.count_tokens(none, cache=cache).collect() == [] and C.op12_token_counts(none).collect() == []
    assert [n for *_, n in counts(C.count_tokens(spark.createDataFrame([(1, "x")], "doc_id long, text string"), cache=cache))] == [1]
