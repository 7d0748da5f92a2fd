"""Suggestion table and completion of the last typed word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismdex.config import MAX_TOKEN_CHARS, MIN_INPUT_CHARS, SUGGEST_LIMIT
from prismdex.functions.ngrams import edge_ngrams_sql
from prismdex.functions.stopwords import stop_list
from prismdex.functions.words import is_blank, last_word
from prismdex.operators.analysis import SUGGEST
from prismdex.operators.dictionary import suggestable
from prismdex.operators.sizing import PUSHED_VALUES, lookup_join, salted_join, settle

ORDERS = ("count_asc", "count_desc")


def build_suggestions(frequencies: DataFrame) -> DataFrame:
    """(gram, word, doc_freq) from (term, doc_freq).

    The grams are the prefixes of every word inside a term after folding and stop word
    removal. Each term is expanded within its own row: no shuffle.
    """
    grams = f"flatten(transform({SUGGEST.tokens_sql('term')}, g -> {edge_ngrams_sql('g.term', *SUGGEST.grams)}))"
    # A term of small letters and digits is one word already, with prefixes of different lengths.
    plain = rf"term RLIKE r'^[a-z0-9]{{1,{MAX_TOKEN_CHARS}}}\z' AND term NOT IN {stop_list(SUGGEST.stop_words)}"
    return suggestable(frequencies).selectExpr(
        f"explode(if({plain}, {edge_ngrams_sql('term', *SUGGEST.grams)}, array_distinct({grams}))) AS gram", "term AS word", "doc_freq")


def best_suggestions(suggestions: DataFrame, k: int = SUGGEST_LIMIT) -> DataFrame:
    """(order, gram, rank, word, doc_freq): the first k words of every gram in each order.

    Kept beside the full table, so that a short gram, which a large part of the vocabulary has, costs a request k rows.
    """
    return reduce(DataFrame.unionByName, [best_in_order(suggestions, order, k) for order in ORDERS])


def best_in_order(suggestions: DataFrame, order: str, k: int = SUGGEST_LIMIT) -> DataFrame:
    """The rows of `best_suggestions` of one order."""
    freq = F.col("doc_freq") if order == "count_asc" else F.col("doc_freq").desc()
    return (
        suggestions.withColumn("rank", F.row_number().over(W.partitionBy("gram").orderBy(freq, "word"))).where(F.col("rank") <= k)
        .select(F.lit(order).alias("order"), "gram", "rank", "word", "doc_freq")
    )


def typed_words(inputs: DataFrame, min_chars: int = 0) -> DataFrame:
    """(input_id, gram): the lower-cased last word of every input that is not blank.

    `min_chars` is the request gate on the whole input.
    """
    return (
        inputs.where(~is_blank("text")).where(f"length(text) >= {min_chars}")
        .select("input_id", F.lower(last_word("text")).alias("gram"))
    )


def passes_gate(inputs: DataFrame, min_chars: int = MIN_INPUT_CHARS) -> DataFrame:
    """Inputs long enough to be sent at all."""
    return inputs.where(F.length("text") >= min_chars)


def suggest(suggestions: DataFrame, inputs: DataFrame, k: int = SUGGEST_LIMIT, order: str = "count_asc",
            min_chars: int = 0, best: DataFrame | None = None) -> DataFrame:
    """(input_id, rank, word, doc_freq): at most k words per input.

    With the table of `best_suggestions` at hand, up to `SUGGEST_LIMIT` words are read from it alone.

    The best k words are found once per distinct typed word and only then handed out
    to the inputs, so a word typed by many costs no more than one typed once. Few distinct
    typed words become a literal filter, which prunes the files sorted by gram.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    kept = best is not None and k <= SUGGEST_LIMIT
    if kept:
        suggestions = best.where((F.col("order") == order) & (F.col("rank") <= k))
    typed, size = settle(typed_words(inputs, min_chars))
    if size.small:
        grams = [r.gram for r in typed.select("gram").distinct().limit(PUSHED_VALUES + 1).collect()]
        if len(grams) <= PUSHED_VALUES:
            suggestions = suggestions.where(F.col("gram").isin(grams))
    wanted = lookup_join(suggestions, typed.select("gram").distinct(), "gram", "left_semi", spread="word", size=size)
    if not kept:
        freq = F.col("doc_freq") if order == "count_asc" else F.col("doc_freq").desc()
        wanted = (
            wanted.withColumn("rank", F.row_number().over(W.partitionBy("gram").orderBy(freq, "word")))
            .where(F.col("rank") <= k)
        )
    if size.small:
        handed = wanted.join(F.broadcast(typed), "gram")
    else:
        handed = salted_join(typed, wanted, ["gram"], "inner", ["input_id"])
    return handed.select("input_id", "rank", "word", "doc_freq")
