"""The tables of an index: lazily over documents, or built and opened as files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prismdex.config import DEFAULT_SYNONYMS, IndexConfig
from prismdex.operators import dictionary as D
from prismdex.operators.analysis import expand_synonyms
from prismdex.operators.blocks import doc_slots, ranged_bounds
from prismdex.operators.broad import MIN_DOCS, KeptCounts, term_facets
from prismdex.operators.sizing import key_ranges, measure
from prismdex.operators.patterns import fuzzy_grams
from prismdex.operators.suggest import ORDERS, best_in_order, best_suggestions, build_suggestions
from prismdex.sources.store import delete_table, open_or_empty, open_table, write_once, write_table

SUGGESTION_SCHEMA = "gram string, word string, doc_freq bigint"


@dataclass(frozen=True)
class Index:
    """docs(key, text, facets) · postings(term, key, tf, positions) · lengths(key, n_terms, n_positions)
    · frequencies(term, doc_freq) · suggestions(gram, word, doc_freq) · vocabulary(field, value)
    · totals(n_docs) · best(order, gram, rank, word, doc_freq) · grams(piece, at, term)."""

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    suggestions: DataFrame
    vocabulary: DataFrame
    totals: DataFrame
    cfg: IndexConfig
    best: DataFrame
    grams: DataFrame


def default_synonyms(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{term}', '{synonym}')" for term, synonym in DEFAULT_SYNONYMS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, synonym)")


def index_of(docs: DataFrame, cfg: IndexConfig = IndexConfig(), synonyms: DataFrame | None = None, keep: bool = False) -> Index:
    """The index of a documents table, worked out anew by every query that uses it.

    With `keep` the words are written once, for queries that read several of its tables.
    """
    size = measure(synonyms) if synonyms is not None else None
    plain = write_once(D.doc_terms(docs, cfg), "doc-terms") if keep else D.doc_terms(docs, cfg)
    rows = plain if synonyms is None else expand_synonyms(plain, synonyms, cfg.key, size=size)
    postings = D.build_postings(rows, cfg.key)
    frequencies = D.doc_freq(postings)
    suggestions = build_suggestions(frequencies)
    return Index(
        best=best_suggestions(suggestions), grams=fuzzy_grams(frequencies), docs=docs, postings=postings,
        lengths=D.doc_lengths(plain, synonyms, cfg.key, size),
        frequencies=frequencies, suggestions=suggestions,
        vocabulary=D.facet_vocabulary(docs, cfg),
        totals=docs.agg(F.count("*").alias("n_docs")), cfg=cfg)


def build_index(spark: SparkSession, source: DataFrame, path: str, cfg: IndexConfig = IndexConfig(),
                synonyms: DataFrame | None = None, suggest_field: str | None = None,
                files: int | None = None) -> dict:
    """Write every table of the index in a new folder under `path`; returns metrics.

    The folder is named in the log of builds last, in one commit: an index opened before or meanwhile goes on
    reading its own complete build, and one opened afterwards sees the new one.
    Documents are written first and read back, so that ids given at reading are fixed
    before anything refers to them. The text is tokenised once, into a forward table
    (key, pos, term) that postings and lengths are both made of; its files are sorted by term, so that what is shuffled
    for the postings compresses well and comes sorted. Postings are ranged on
    (term, key): a term that is in most documents is spread over many files. `files` is
    the number of files of the larger tables; left out, documents stay partitioned as
    the source is and Spark chooses for the others.
    """
    started, home = time.time(), path
    build = f"build-{uuid.uuid4().hex}"
    path = f"{home}/{build}"
    counted = Observation("documents")
    write_table(source.observe(counted, F.count("*").alias("n_docs")), f"{path}/docs", files=files)
    n_docs = counted.get["n_docs"]
    docs = open_table(spark, f"{path}/docs")

    write_table(D.doc_terms(docs, cfg).sortWithinPartitions("term"), f"{path}/doc_terms")
    rows = open_table(spark, f"{path}/doc_terms")
    size = measure(synonyms) if synonyms is not None else None
    stacked = rows if synonyms is None else expand_synonyms(rows, synonyms, cfg.key, size=size)
    ranges = key_ranges(stacked, "term") if synonyms is None else [F.lit(True)]  # each range would stack all words anew
    _write_ranges(f"{path}/postings", ranges, lambda part, n: D.ranged_postings(stacked.where(part), cfg.key, n), files)
    write_table(D.doc_lengths(rows, synonyms, cfg.key, size), f"{path}/lengths")

    postings = open_table(spark, f"{path}/postings")
    write_table(D.doc_freq(postings), f"{path}/frequencies", sort_by=["term"], files=files)
    frequencies = open_table(spark, f"{path}/frequencies")
    if suggest_field is not None and suggest_field != cfg.text:
        words = write_once(D.doc_freq(D.build_postings(D.occurrences(docs, cfg, field=suggest_field), cfg.key)), "words")
    else:
        words = frequencies

    def ranged(rows: DataFrame) -> DataFrame:  # the few rows of terms, dealt to all tasks before each becomes many
        return rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "term").sortWithinPartitions("term")

    _write_ranges(f"{path}/grams", key_ranges(frequencies, "term", "2 * length(term)"),
                  lambda part, _: fuzzy_grams(ranged(frequencies.where(part)), distinct=True), files, ["piece", "at", "term"])
    _write_ranges(f"{path}/suggestions", key_ranges(words, "term", "length(term)"),
                  lambda part, _: build_suggestions(ranged(words.where(part))), files, ["gram", "doc_freq", "word"])
    suggestions = open_table(spark, f"{path}/suggestions")
    grams = key_ranges(suggestions, "gram")
    for order in ORDERS:
        _write_ranges(f"{path}/best", grams, lambda part, _: best_in_order(suggestions.where(part), order), files,
                      ["order", "gram", "rank"], add=order != ORDERS[0])
    write_table(D.facet_vocabulary(docs, cfg), f"{path}/vocabulary")
    write_table(spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs")), f"{path}/totals")
    _log_build(spark, home, build)
    ended = time.time()
    return {"started": started, "ended": ended, "seconds": ended - started, "n_docs": n_docs}


def _write_ranges(path: str, ranges: list[Column], rows_of: Callable[[Column, int | None], DataFrame], files: int | None = None,
                  sort_by: list[str] | None = None, add: bool = False) -> None:
    """Write the rows of one range after the other, so that the disk never holds the shuffled rows of all.

    `rows_of` is given the condition of a range and its number of files, to deal out its rows where there is no `sort_by`.
    """
    each = files and -(-files // len(ranges))
    for n, part in enumerate(ranges):
        write_table(rows_of(part, each), path, sort_by, each if sort_by else None, add or n > 0)


def build_blocks(spark: SparkSession, path: str, cfg: IndexConfig = IndexConfig(), files: int | None = None) -> None:
    """Add the tables that `top_any` reads to the last build: `slots` of the documents, `bounds` of the terms."""
    index, build = open_index(spark, path, cfg), current_build(spark, path)
    write_table(doc_slots(index.lengths, key=cfg.key), f"{build}/slots", sort_by=["block", "slot"], files=files)
    slots = open_table(spark, f"{build}/slots")
    n_docs = slots.count()
    _write_ranges(f"{build}/bounds", key_ranges(index.frequencies, "term", "doc_freq"),
                  lambda part, n: ranged_bounds(index.postings.where(part), slots, n_docs, cfg.key, n), files)


def open_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(slots, bounds) of the last build."""
    build = current_build(spark, path)
    return open_table(spark, f"{build}/slots"), open_table(spark, f"{build}/bounds")


def build_facet_counts(spark: SparkSession, path: str, cfg: IndexConfig = IndexConfig(), min_docs: int = MIN_DOCS,
                       files: int | None = None) -> None:
    """Add the facet counts of frequent terms to the last build, for `browse(..., kept=...)`."""
    index, build = open_index(spark, path, cfg), current_build(spark, path)
    counts = term_facets(index.postings, index.docs, index.frequencies, cfg, min_docs)
    write_table(counts, f"{build}/term_facets", sort_by=["term", "field", "value"], files=files)
    write_table(spark.range(1).select(F.lit(min_docs).cast("long").alias("min_docs")), f"{build}/term_facets_from")


def open_facet_counts(spark: SparkSession, path: str) -> KeptCounts:
    """The facet counts kept with the last build."""
    build = current_build(spark, path)
    floor = open_table(spark, f"{build}/term_facets_from").first()["min_docs"]
    return KeptCounts(open_table(spark, f"{build}/term_facets"), floor)


def _builds(spark: SparkSession, path: str) -> DataFrame:
    return open_or_empty(spark, f"{path}/builds", StructType.fromDDL("number bigint, build string"))


def _log_build(spark: SparkSession, path: str, build: str) -> None:
    last = _builds(spark, path).agg(F.max("number")).collect()[0][0] or 0
    spark.range(last + 1, last + 2, 1, 1).select(F.col("id").alias("number"), F.lit(build).alias("build")).write.mode("append").parquet(f"{path}/builds")


def current_build(spark: SparkSession, path: str) -> str | None:
    """The folder of the last build that was finished, None while there is none."""
    last = _builds(spark, path).orderBy(F.desc("number"), F.desc("build")).limit(1).collect()
    return f"{path}/{last[0]['build']}" if last else None


def drop_old_builds(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the last `keep` builds; call it when no reader has an older one open."""
    numbered = _builds(spark, path).orderBy(F.desc("number"), F.desc("build")).collect()
    for row in numbered[max(keep, 1):]:
        delete_table(spark, f"{path}/{row['build']}")


def open_index(spark: SparkSession, path: str, cfg: IndexConfig = IndexConfig()) -> Index:
    """The last build of the index, read-only."""
    build = current_build(spark, path)
    if build is None:
        raise FileNotFoundError(f"no index was built at {path}")
    names = ("docs", "postings", "lengths", "frequencies", "suggestions", "vocabulary", "totals", "best", "grams")
    return Index(**{name: open_table(spark, f"{build}/{name}") for name in names}, cfg=cfg)


def open_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """The suggestion table of an index, empty while none is built."""
    return open_or_empty(spark, f"{current_build(spark, path) or path}/suggestions", StructType.fromDDL(SUGGESTION_SCHEMA))
