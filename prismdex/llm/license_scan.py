"""License scans by a positional index of rare words, in DataFrame functions alone.

The templates' words form an index word -> (template, position). One pass over all documents counts in how
many of them each template word stands (a result no longer than the templates). A second pass takes each
document's `anchors` rarest template words, shifts their places by the template positions and looks for a
common start: a template is found where at least `share` of its anchor weight agrees on one start and its
mandatory key phrase stands in the text. Base phrases are looked for in every place, beside the templates.

All work stays within the row: no document is shuffled, and a hot source or group of copies is no key.
Null and empty texts have no words, labels '' and score 0. Repeated rows stay; other columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import WORD_GAP, lower_ascii

# Phrases and labels of the base scan.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Label -> (template text, mandatory key phrase).
TEMPLATES = {
    "agpl": ("licensed under the gnu affero general public license", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": ("dedicated to the public domain under the cc0 universal dedication", "cc0"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "general public license version 3"),
    "lgpl": ("licensed under the gnu lesser general public license", "lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), WORD_GAP), lambda w: w != "")


def places(words: Column, phrase: str) -> Column:
    """Starts of the phrase's words among `words`, counted from 0."""
    parts = phrase.split(" ")
    first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    follow = lambda i: [F.get(words, i + k) == p for k, p in enumerate(parts) if k]

    def all_of(i: Column) -> Column:
        ok = F.lit(True)
        for test in follow(i):
            ok = ok & F.coalesce(test, F.lit(False))
        return ok

    return F.filter(first, all_of)


def word_weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all documents."""
    vocabulary = sorted({w for text, _ in TEMPLATES.values() for w in text.split(" ")})
    known = F.array(*map(F.lit, vocabulary))
    counts = (
        docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col("text")), known), F.lit("")))
                    .alias("word")).groupBy("word").count().collect()
    )  # at most one row per template word, and one for all documents
    found = {r["word"]: r["count"] for r in counts}
    total = found.get("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 0.01 for w in vocabulary}


def votes(spots: Column, word: str, place: int, idf: float) -> Column:
    """Starts a template would have, were these places of the word its `place`-th."""
    return F.transform(F.filter(spots, lambda s: s["w"] == word),
                       lambda s: F.struct((s["i"] - place).alias("at"), F.lit(idf).alias("idf")))


def scan(docs: DataFrame, anchors: int = 8, share: float = 0.6) -> DataFrame:
    """Rows of `docs` with words, base places, labels and score."""
    weight = word_weights(docs)
    rank = {w: i for i, w in enumerate(sorted(weight, key=lambda w: (-weight[w], w)))}
    known = F.array(*map(F.lit, sorted(rank, key=rank.get)))  # rarest first
    spot = "struct<w:string,i:int>"
    rows = docs.withColumn("_words", words_of(F.col("text")))
    rows = rows.withColumn("_rare", F.array_intersect(known, F.col("_words")))  # keeps the order of `known`
    rows = rows.withColumn("_spots", F.when(F.size("_rare") == 0, F.array().cast(f"array<{spot}>")).otherwise(F.filter(
        F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda s: F.array_contains(known, s["w"]))))
    scores = []
    for label, (text, key) in sorted(TEMPLATES.items()):
        parts = text.split(" ")
        # The template's own rarest words are its anchors; those present vote for a common start.
        own = sorted(set(parts), key=rank.get)[:anchors]
        postings = [(w, p) for p, w in enumerate(parts) if w in own]
        full = sum(weight[w] for w, _ in postings)
        starts = F.flatten(F.array(*[
            votes(F.col("_spots"), w, p, weight[w]) for w, p in postings]))
        ordered = F.array_sort(starts)
        # One walk over the sorted votes: the weight of the current start and the best so far.
        best = F.aggregate(
            ordered,
            F.struct(F.lit(-(2**31)).cast("int").alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")),
            lambda acc, v: F.struct(
                v["at"].cast("int").alias("at"),
                F.when(acc["at"] == v["at"], acc["sum"] + v["idf"]).otherwise(v["idf"]).alias("sum"),
                F.greatest(acc["best"], F.when(acc["at"] == v["at"], acc["sum"] + v["idf"]).otherwise(v["idf"])).alias("best")),
            lambda acc: F.least(acc["best"] / F.lit(full), F.lit(1.0)))
        # Any word of the mandatory phrase may gate, so the rarest does: it only saves work.
        gate = min(key.split(" "), key=rank.get)
        verified = F.array_contains("_rare", gate) & (F.size(places(F.col("_words"), key)) > 0)
        scores.append(F.when(verified, F.struct(F.lit(label).alias("label"), best.alias("score"))))
    rows = rows.withColumn("_found", F.filter(F.array(*scores), lambda s: s.isNotNull() & (s["score"] >= share)))
    base = {phrase: F.col(f"_at{i}") for i, phrase in enumerate(BASE)}
    for i, phrase in enumerate(BASE):
        rows = rows.withColumn(f"_at{i}", places(F.col("_words"), phrase))
    starts = F.concat(*base.values())
    base_labels = F.array_sort(F.filter(F.array(*[
        F.when(F.size(at) > 0, F.lit(BASE[phrase])) for phrase, at in base.items()]), lambda x: x.isNotNull()))
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("_found", lambda s: s["label"]))), ",").alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_found", lambda s: s["score"])), F.lit(0.0))).alias("score"),
    )


def op6_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"))
