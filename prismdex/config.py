"""Index description and the fixed values of the analysis chains."""

from __future__ import annotations

from dataclasses import dataclass

# English stop words of the text chains.
TEXT_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

# Stop words of the suggestion chain (without "it", with "i", "s", "t").
SUGGEST_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "i", "if", "in",
    "into", "is", "no", "not", "of", "on", "or", "s", "such", "t", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

# Limits of the analysis and request chains.
MAX_TOKEN_CHARS = 255
MIN_SUGGEST_CHARS = 3
MIN_GRAM, MAX_GRAM = 1, 20
PAGE_OFFSET, PAGE_SIZE = 0, 50
SUGGEST_LIMIT = 8
MIN_INPUT_CHARS = 2

# The default synonym rows (term, synonym).
DEFAULT_SYNONYMS = (("stylecraft", "style craft"), ("style", "stylecraft"))


@dataclass(frozen=True)
class IndexConfig:
    """Which columns of a documents table are the key, the text and the facets."""

    key: str = "doc_id"
    text: str = "title"
    facets: tuple[str, ...] = ("Material", "Style", "Mounting", "Brand")

    def check_fields(self, names) -> None:
        unknown = sorted(set(names) - set(self.facets))
        if unknown:
            raise ValueError(f"unknown facet field(s): {', '.join(unknown)}")
