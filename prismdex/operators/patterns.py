"""Prefix, wildcard, fuzzy and range terms, resolved on the term dictionary.

A prefix, a wildcard's literal start and a range are intervals of the sorted dictionary. Up to
`PUSHED_VALUES` of them are pushed into its scan as merged ranges, in blocks, and only terms inside are
looked at again. More patterns than that, and fuzzy words, meet the dictionary by equality on a key both sides
share; the exact test then runs on those candidates. The result of each is (query_id, term); `postings_of` turns it into
documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.functions.ngrams import edge_ngrams
from prismdex.operators.sizing import PUSHED_VALUES, in_tasks, lookup_join, salted_join, settle
from prismdex.sources.store import write_once

_KEY_CHARS = 8
_PIECE_CHARS = 2
#: Intervals that one scan is asked for.
_BLOCK = 200
#: Found terms that are broadcast to the postings, and the salts of a longer list.
FOUND_ROWS = 50_000
FOUND_SALTS = 8


@dataclass(frozen=True)
class Interval:
    """Terms between two bounds in binary order, a null one open; of these only such that are like `like`, if given."""

    query_id: int
    low: str | None
    high: str | None
    low_in: bool = True
    high_in: bool = False
    like: str | None = None


def _after(start: str) -> str | None:
    """The least text greater than every text with this start; none if there is no such text."""
    kept = start.rstrip("\U0010ffff")
    if not kept:
        return None
    code = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if code == 0xD800 else code)


def _merged(intervals: list[Interval]) -> Column:
    """Whether a term lies between the bounds of any interval; overlapping ones become one range."""
    ranges: list[tuple[str | None, str | None]] = []
    for i in sorted(intervals, key=lambda i: (i.low or "").encode()):
        if ranges and (ranges[-1][1] is None or (i.low or "").encode() <= ranges[-1][1].encode()):
            low, high = ranges.pop()
            longest = None if high is None or i.high is None else max(high, i.high, key=str.encode)
            ranges.append((low, longest))
        else:
            ranges.append((i.low, i.high))
    term, any_term = F.col("term"), F.col("term").isNotNull()
    return reduce(Column.__or__, [
        (any_term if low is None else term >= low) & (any_term if high is None else term <= high) for low, high in ranges])


def _within(dictionary: DataFrame, intervals: list[Interval]) -> DataFrame:
    """(query_id, term) of the terms inside each interval."""
    term, parts = F.col("term"), [dictionary.select(F.lit(0).cast("long").alias("query_id"), "term").where("false")]
    for at in range(0, len(intervals), _BLOCK):
        block = intervals[at:at + _BLOCK]
        asked = F.array(*[F.struct(
            F.lit(i.query_id).cast("long").alias("query_id"), F.lit(i.low).cast("string").alias("low"), F.lit(i.high).cast("string").alias("high"),
            F.lit(i.low_in).alias("low_in"), F.lit(i.high_in).alias("high_in"), F.lit(i.like).cast("string").alias("pattern")) for i in block])

        def inside(i: Column) -> Column:
            above = i["low"].isNull() | (term > i["low"]) | (i["low_in"] & (term == i["low"]))
            below = i["high"].isNull() | (term < i["high"]) | (i["high_in"] & (term == i["high"]))
            return above & below & (i["pattern"].isNull() | F.like(term, i["pattern"]))

        met = F.transform(F.filter(asked, inside), lambda i: i["query_id"])
        parts.append(dictionary.select("term").where(_merged(block)).select(F.explode(met).alias("query_id"), "term"))
    return reduce(DataFrame.unionByName, parts)


def _candidates(terms: DataFrame, keyed: DataFrame, on: list[str], test: Column) -> DataFrame:
    """(query_id, term) of terms and patterns that share a key, and pass the test."""
    return lookup_join(terms, keyed, on, "inner", "term").where(test).select("query_id", "term")


def _by_start(dictionary: DataFrame) -> DataFrame:
    """(term, key): every term under each of its first starts."""
    return dictionary.select("term", F.explode(edge_ngrams("term", "front", 1, _KEY_CHARS)).alias("key"))


def match_pattern(dictionary: DataFrame, patterns: DataFrame) -> DataFrame:
    """Terms for (query_id, pattern) with `*` for any run and `?` for one character.

    Patterns are lower-cased, not analysed, and must not start with a wildcard. The interval is that of the
    literal start; the key of many patterns is at most eight characters of it.
    """
    lowered = F.col("lowered")
    literal = F.regexp_extract(lowered, r"^[^*?]*", 0)
    checked = F.when(literal == "", F.raise_error(F.lit("a pattern must not start with a wildcard"))).otherwise(literal)
    escaped = F.regexp_replace(lowered, r"([%_\\])", r"\\$1")
    asked, size = settle(in_tasks(patterns, ["query_id"], lowered=F.lower("pattern")).select(
        "query_id", checked.alias("start"), F.translate(escaped, "*?", "%_").alias("like_pattern")).where("start IS NOT NULL"))
    if size.rows <= PUSHED_VALUES:
        return _within(dictionary, [Interval(r.query_id, r.start, _after(r.start), like=r.like_pattern) for r in asked.collect()])
    keyed = asked.select("query_id", F.substr("start", F.lit(1), F.lit(_KEY_CHARS)).alias("key"), "like_pattern")
    return _candidates(_by_start(dictionary), keyed, ["key"], F.expr("term LIKE like_pattern"))


def match_prefix(dictionary: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Terms that start with (query_id, prefix); wildcard characters stand for themselves."""
    asked, size = settle(in_tasks(prefixes, ["query_id"], prefix=F.lower("prefix")).where("prefix <> ''"))
    if size.rows <= PUSHED_VALUES:
        return _within(dictionary, [Interval(r.query_id, r.prefix, _after(r.prefix)) for r in asked.collect()])
    keyed = asked.withColumn("key", F.substr("prefix", F.lit(1), F.lit(_KEY_CHARS)))
    return _candidates(_by_start(dictionary), keyed, ["key"], F.startswith(F.col("term"), F.col("prefix")))


def fuzzy_grams(dictionary: DataFrame, distinct: bool = False) -> DataFrame:
    """(piece, at, term): every one- and two-character piece of a term and its place; in an index, ranged by piece and place.

    The last character of a term is one piece, not two. Terms are made distinct before they are cut up, not their pieces; terms that
    are `distinct` already are cut up as they come.
    """
    terms = dictionary.where("term <> ''").select("term")
    return (
        (terms if distinct else terms.distinct())
        .selectExpr("term", "explode(sequence(0, length(term) - 1)) AS at")
        .selectExpr("explode(if(at + 1 < length(term), array(substr(term, at + 1, 1), substr(term, at + 1, 2)), "
                    "array(substr(term, at + 1, 1)))) AS piece", "at", "term")
    )


def match_fuzzy(dictionary: DataFrame, words: DataFrame, min_sim: float = 0.5, grams: DataFrame | None = None) -> DataFrame:
    """Terms similar to (query_id, word): 1 - edit distance / shorter length > min_sim.

    With at most d edits allowed for a word, the word is cut into d + 1 pieces: a term
    within d edits holds at least one piece unchanged, moved by at most d. So a match
    always shares a (piece, position) key, and no other terms are compared. `grams` is the written table of
    `fuzzy_grams`; the pieces of few words are pushed into its scan, and the dictionary is not read.
    """
    if not 0.0 <= min_sim < 1.0:
        raise ValueError("min_sim must lie in [0, 1)")
    n = F.length("word")
    # Largest d with d < (1 - min_sim) * length; the small term guards against rounding down.
    allowed = (F.ceil(n * (1.0 - min_sim) - 1e-9) - 1).cast("int")
    pieces = (
        in_tasks(words, ["query_id"], word=F.lower("word")).where(F.length("word") > 0)
        .withColumn("edits", F.greatest(allowed, F.lit(0)))
        .select("query_id", "word", "edits", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("j"))
        .withColumn("start", F.floor(F.col("j") * n / (F.col("edits") + 1)).cast("int"))
        .withColumn("stop", F.floor((F.col("j") + 1) * n / (F.col("edits") + 1)).cast("int"))
        .withColumn("piece", F.substr("word", F.col("start") + 1,
                                      F.least(F.col("stop") - F.col("start"), F.lit(_PIECE_CHARS))))
        .select("query_id", "word", "edits", "piece",
                F.explode(F.sequence(F.greatest(F.col("start") - F.col("edits"), F.lit(0)),
                                     F.col("start") + F.col("edits"))).alias("at"))
    )
    pieces, size = settle(pieces)
    grams = fuzzy_grams(dictionary) if grams is None else grams
    if size.small:
        asked = [r.piece for r in pieces.select("piece").distinct().limit(PUSHED_VALUES + 1).collect()]
        if len(asked) <= PUSHED_VALUES:
            last = pieces.agg(F.max("at")).collect()[0][0]
            grams = grams.where(F.col("piece").isin(asked)).where(F.col("at") <= F.lit(-1 if last is None else last))
    shorter = F.least(F.length("word"), F.length("term"))
    distance = F.levenshtein("word", "term")
    close = (F.abs(F.length("word") - F.length("term")) <= F.col("edits")) & (
        1.0 - distance / shorter > min_sim)
    return _candidates(grams, pieces, ["at", "piece"], close).distinct()


def match_range(dictionary: DataFrame, low: str | None, high: str | None, inclusive: bool = True,
                query_id: int = 0) -> DataFrame:
    """Terms between two bounds in binary order: a filter the sorted files are pruned by."""
    term = F.col("term")
    kept = dictionary.select("term")
    if low is not None:
        kept = kept.where(term >= low.lower() if inclusive else term > low.lower())
    if high is not None:
        kept = kept.where(term <= high.lower() if inclusive else term < high.lower())
    return kept.select(F.lit(query_id).cast("long").alias("query_id"), "term")


def match_ranges(dictionary: DataFrame, ranges: DataFrame) -> DataFrame:
    """Terms for a table (query_id, low, high, inclusive); a null bound is open.

    For many ranges the key is the class of the first character; a range is repeated for the
    classes between its bounds.
    """

    def first_class(text: Column) -> Column:
        code = F.ascii(text)
        return F.when(code < 128, code).otherwise(128 + F.shiftright(code, 8))

    asked, size = settle(in_tasks(ranges, ["query_id", "inclusive"], low=F.lower("low"), high=F.lower("high")).where(
        F.coalesce(F.col("low") <= F.col("high"), F.lit(True))).select("query_id", "low", "high", "inclusive"))
    if size.rows <= PUSHED_VALUES:
        return _within(dictionary, [Interval(r.query_id, r.low, r.high, bool(r.inclusive), bool(r.inclusive)) for r in asked.collect()])
    last_class = F.lit(128 + (0x10FFFF >> 8))
    keyed = asked.withColumn("key", F.explode(F.sequence(
        F.coalesce(first_class(F.col("low")), F.lit(0)), F.coalesce(first_class(F.col("high")), last_class))))
    term, low, high = F.col("term"), F.col("low"), F.col("high")
    inside = F.when(
        F.col("inclusive"), F.coalesce(term >= low, F.lit(True)) & F.coalesce(term <= high, F.lit(True))).otherwise(
        F.coalesce(term > low, F.lit(True)) & F.coalesce(term < high, F.lit(True)))
    classed = dictionary.select("term", first_class(F.col("term")).alias("key"))
    return _candidates(classed, keyed, ["key"], inside)


def postings_of(postings: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key): documents with any of the found (query_id, term).

    A short list of terms is pushed into the scan of the sorted postings; a long one is written once. A list too
    long to broadcast meets the postings by a shuffle: no term has more of them than there are documents, so a few
    salts do.
    """
    found, size = settle(write_once(found, "found"))
    if size.rows <= PUSHED_VALUES:
        postings = postings.where(F.col("term").isin(*{r.term for r in found.collect()}))
    postings = postings.select("term", key)
    if size.rows <= FOUND_ROWS and size.small:
        # A semi join moves below the grouping of postings that are still to be built: only theirs are shuffled.
        few = F.broadcast(found.select("term").distinct())
        met = postings.join(few, "term", "left_semi").join(F.broadcast(found), "term")
    else:
        met = salted_join(postings, found.hint("merge"), ["term"], "inner", [key], FOUND_SALTS)
    return met.select("query_id", key).distinct()
