"""Analysis of a text column into term rows, and synonym expansion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.config import MAX_GRAM, MIN_GRAM, SUGGEST_STOP_WORDS, TEXT_STOP_WORDS
from prismdex.functions.folding import ascii_fold_sql
from prismdex.functions.ngrams import edge_ngrams_sql
from prismdex.functions.stopwords import remove_stops_sql, stop_list
from prismdex.functions.tokens import normalize_word_sql, raw_words_sql, tokenize_sql, word_fits_sql
from prismdex.operators.sizing import Size, lookup_join, measure


@dataclass(frozen=True)
class Chain:
    """Steps applied to a text, in this order."""

    tokenized: bool = True
    folded: bool = False
    stop_words: tuple[str, ...] = ()
    gaps: bool = True
    synonyms: bool = False
    grams: tuple[str, int, int] | None = None

    def tokens_sql(self, text: str) -> str:
        """array<struct<pos, term>> of one value, before synonyms and grams."""
        if not self.tokenized:
            return f"array(named_struct('pos', 0, 'term', {text}))"
        tokens = tokenize_sql(text)
        if self.folded:
            tokens = f"transform({tokens}, f -> named_struct('pos', f.pos, 'term', {ascii_fold_sql('f.term')}))"
        return remove_stops_sql(tokens, self.stop_words, self.gaps) if self.stop_words else tokens


KEYWORD = Chain(tokenized=False)
STANDARD = Chain(stop_words=TEXT_STOP_WORDS)
SYNONYM = Chain(stop_words=TEXT_STOP_WORDS, synonyms=True)
SUGGEST = Chain(folded=True, stop_words=SUGGEST_STOP_WORDS, gaps=False, grams=("front", MIN_GRAM, MAX_GRAM))


def analyze(docs: DataFrame, text: str, chain: Chain = STANDARD, key: str = "doc_id",
            synonyms: DataFrame | None = None, size: Size | None = None) -> DataFrame:
    """(key, pos, term) rows of a text column. No shuffle; `size` is that of `synonyms`."""
    if not chain.tokenized:
        rows = docs.where(F.col(text).isNotNull()).select(key, F.expr("0 AS pos"), F.col(text).alias("term"))
    elif chain.gaps:
        rows = (
            docs.selectExpr(key, f"posexplode({raw_words_sql(text)}) AS (pos, word)").where(word_fits_sql("word"))
            # Exploded, so that a filter on terms stays above: below, each of its comparisons would normalise the word anew.
            .selectExpr(key, "pos", f"explode(array({normalize_word_sql('word')})) AS term")
        )
        if chain.folded:
            rows = rows.selectExpr(key, "pos", f"{ascii_fold_sql('term')} AS term")
        if chain.stop_words:
            rows = rows.where(f"term NOT IN {stop_list(chain.stop_words)}")
    else:
        rows = docs.selectExpr(key, f"inline({chain.tokens_sql(text)})")
    if chain.synonyms and synonyms is not None:
        rows = expand_synonyms(rows, synonyms, key, size=size)
    if chain.grams:
        rows = rows.selectExpr(key, "pos", f"explode({edge_ngrams_sql('term', *chain.grams)}) AS term")
    return rows


def expand_synonyms(rows: DataFrame, synonyms: DataFrame, key: str = "doc_id", split_multiword: bool = False,
                    size: Size | None = None) -> DataFrame:
    """Add the synonyms (term, synonym) of every term at the position of the term.

    Synonyms are not looked up again. A synonym of several words stays one term with
    blanks unless `split_multiword` puts its words on following positions.
    """
    listed = synonyms.where("term IS NOT NULL AND synonym IS NOT NULL").groupBy("term").agg(
        F.expr("collect_set(synonym) AS synonyms"))
    joined = lookup_join(rows, listed, "term", "left", [key, "pos"], size or measure(synonyms))
    stacked = joined.selectExpr(
        key, "pos", "explode(array_distinct(concat(array(term), coalesce(synonyms, array())))) AS term")
    if not split_multiword:
        return stacked
    words = stacked.selectExpr(key, "pos", "posexplode(split(term, ' ')) AS (skip, term)")
    return words.selectExpr(key, "pos + skip AS pos", "term").distinct()
