"""Documents tables: projection to the indexed columns, and document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.config import IndexConfig


def to_documents(df: DataFrame, columns: dict[str, Column | str], cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Project a table to key, text and facet columns; `columns` maps their names to sources."""
    wanted = [cfg.key, cfg.text, *cfg.facets]
    missing = [c for c in wanted if c not in columns]
    if missing:
        raise ValueError(f"no source for column(s): {', '.join(missing)}")
    return df.select(*[
        (F.col(columns[c]) if isinstance(columns[c], str) else columns[c]).alias(c) for c in wanted])


def assign_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Give records without a key an id that follows the order of the input.

    The ids are those of this one evaluation: write the result and read it back before
    anything else is derived from it.
    """
    return df.select(F.monotonically_increasing_id().alias(key), "*")
