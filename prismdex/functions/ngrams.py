"""Edge n-grams: the prefixes or suffixes of a term."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _check(side: str, smallest: int, largest: int) -> None:
    if side not in ("front", "back"):
        raise ValueError("side must be 'front' or 'back'")
    if smallest < 1:
        raise ValueError("the smallest gram size must be at least 1")
    if smallest > largest:
        raise ValueError("the smallest gram size must not exceed the largest")


def _per_size(term: str, smallest: int, largest: int, body: str) -> str:
    # sequence() counts down when its end is below its start, hence the guard.
    sizes = f"sequence({smallest}, least(length({term}), {largest}))"
    return f"if(length({term}) >= {smallest}, transform({sizes}, n -> {body}), array())"


def edge_ngrams_sql(term: str, side: str = "front", smallest: int = 1, largest: int = 1) -> str:
    """array<string> of the grams of `term`, shortest first."""
    _check(side, smallest, largest)
    return _per_size(term, smallest, largest, f"{'left' if side == 'front' else 'right'}({term}, n)")


def edge_ngrams_with_offsets_sql(term: str, token_start: str, side: str = "front", smallest: int = 1,
                                 largest: int = 1) -> str:
    """array<struct<gram, start, end>>; offsets count from the start of the text."""
    _check(side, smallest, largest)
    skip, cut = ("0", "left") if side == "front" else (f"length({term}) - n", "right")
    return _per_size(term, smallest, largest, (
        f"named_struct('gram', {cut}({term}, n), 'start', {token_start} + {skip}, 'end', {token_start} + {skip} + n)"))


def edge_ngrams(term: str, side: str = "front", smallest: int = 1, largest: int = 1) -> Column:
    return F.expr(edge_ngrams_sql(term, side, smallest, largest))


def edge_ngrams_with_offsets(term: str, token_start: str, side: str = "front", smallest: int = 1,
                             largest: int = 1) -> Column:
    return F.expr(edge_ngrams_with_offsets_sql(term, token_start, side, smallest, largest))
