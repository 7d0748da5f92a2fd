"""Small helpers on typed text and facet names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(text: str) -> Column:
    return F.expr(rf"{text} IS NULL OR {text} RLIKE r'^[\s\p{{Z}}]*$'")


def last_word(text: str) -> Column:
    """Text after the last white space; empty when the text ends in white space."""
    return F.expr(rf"element_at(split({text}, r'[\s\p{{Z}}]', -1), -1)")


def slug(name: str) -> Column:
    """Identifier form of a name: every white space or hyphen becomes an underscore."""
    return F.expr(rf"regexp_replace({name}, r'[\s\-]', '_')")


def complete_phrase(phrase: str, word: str) -> Column:
    """The phrase with its last word replaced by an accepted suggestion."""
    parts = rf"split({phrase}, r'\s+', -1)"
    return F.expr(f"array_join(concat(slice({parts}, 1, size({parts}) - 1), array(trim({word}))), ' ')")
