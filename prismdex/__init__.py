"""prismdex: faceted full-text search over Spark tables.

Text columns become postings, a term dictionary, a suggestion table and a facet
vocabulary; tables of phrases, selections and typed words are answered against
them as ordinary DataFrame jobs.
"""

from prismdex.config import IndexConfig

__all__ = ["IndexConfig"]
