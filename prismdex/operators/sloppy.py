"""Phrase match with slop: the terms of a phrase near each other, in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.operators.query_terms import probe_terms
from prismdex.operators.search import restrict
from prismdex.operators.sizing import lookup_join


def _fits_window_sql(points: str, start: str, slop: int, n_terms: str) -> str:
    """Whether one position per phrase term lies in the window [start, start + slop].

    `points` are structs (q_pos, term, shift) with shift = position - q_pos, sorted. A term
    the phrase repeats needs a position of its own each time: going through the phrase in
    order, each place takes the first position still behind those its term has taken.
    The windows of one term's places are equally wide and in order, so this misses none.
    """
    inside = f"filter({points}, p -> p.shift BETWEEN {start} AND {start} + {slop})"
    none = "named_struct('q_pos', -1, 'taken', map_from_arrays(array(''), array(-1)), 'n', 0)"
    pos = "p.shift + p.q_pos"
    use = f"acc.q_pos <> p.q_pos AND coalesce({pos} > acc.taken[p.term], true)"
    step = (
        f"if({use}, named_struct('q_pos', p.q_pos, 'taken', map_concat(map_filter(acc.taken, (t, x) -> t <> p.term), "
        f"map_from_arrays(array(p.term), array({pos}))), 'n', acc.n + 1), acc)"
    )
    return f"aggregate({inside}, {none}, (acc, p) -> {step}, acc -> acc.n) = {n_terms}"


def search_sloppy(postings: DataFrame, terms: DataFrame, slop: int, key: str = "doc_id") -> DataFrame:
    """(query_id, key): documents where the phrase terms fit within `slop` moves.

    With shift = position - place in the phrase, a document matches when some choice of
    one position per place keeps max(shift) - min(shift) <= slop. Documents that lack a
    term of the phrase are dropped first. Shifts then go into buckets slop + 1 wide; a
    window that starts in a bucket ends in it or the next, so each point is sent to its
    own bucket and the one before. A group then holds at most 2 (slop + 1) shifts per
    place, however often a document repeats a word. It needs no further shuffle, since
    the buckets of a document are where the document is.
    """
    if slop < 0:
        raise ValueError("slop must not be negative")
    probe = probe_terms(terms)
    joined = lookup_join(
        restrict(postings, probe).select("term", key, "positions"),
        probe.table.select("query_id", "clause", "clause_size", "q_pos", "term"), "term", "inner", key, probe.size)
    by_doc = ["query_id", "clause", "clause_size", key]
    complete = (
        joined.groupBy(*by_doc).agg(F.expr("collect_list(struct(q_pos, term, positions)) AS places"))
        .where("size(places) = clause_size")
    )
    points = (
        complete.selectExpr(*by_doc, "inline(places)")
        .selectExpr(*by_doc, "q_pos", "term", "explode(positions) AS pos")
        .selectExpr(*by_doc, "q_pos", "term", "pos - q_pos AS shift")
        .selectExpr(*by_doc, "q_pos", "term", "shift", f"int(floor(shift / {slop + 1})) AS own")
        .selectExpr(*by_doc, "q_pos", "term", "shift", "explode(array(own, own - 1)) AS bucket")
    )
    groups = (
        points.groupBy(*by_doc, "bucket")
        .agg(F.expr("sort_array(collect_set(struct(q_pos, term, shift))) AS points"))
        .where("size(points) >= clause_size")
    )
    windows = f"sequence(bucket * {slop + 1}, bucket * {slop + 1} + {slop})"
    matched = groups.where(f"exists({windows}, w -> {_fits_window_sql('points', 'w', slop, 'clause_size')})")
    return matched.select("query_id", key).distinct()
