"""Stop word removal on token arrays."""

from __future__ import annotations

from collections.abc import Iterable

from prismdex.config import TEXT_STOP_WORDS


def stop_list(words: Iterable[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def remove_stops_sql(tokens: str, words: Iterable[str] = TEXT_STOP_WORDS, gaps: bool = True) -> str:
    """Drop stop words from array<struct<pos, term>>.

    With `gaps` the words left keep their positions; without, they are numbered anew.
    """
    kept = f"filter({tokens}, s -> s.term NOT IN {stop_list(words)})"
    return kept if gaps else f"transform({kept}, (s, i) -> named_struct('pos', i, 'term', s.term))"
