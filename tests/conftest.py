from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from prismdex.plans.index import default_synonyms, index_of  # noqa: E402
from prismdex.session import local_session  # noqa: E402

# The catalogue's products as (title, Material, Style, Mounting, Brand).
PRODUCTS = [
    ("Mid-America Standard Louvered Vinyl Shutters", "Vinyl", "Louver", "Decorative", "Mid-America"),
    ("Mid-America Standard Raised Panel Vinyl Shutters", "Vinyl", "Raised Panel", "Decorative", "Mid-America"),
    ("Mid-America Custom Louvered Vinyl Shutters", "Vinyl", "Louver", "Decorative", "Mid-America"),
    ("Mid-America Custom Raised Panel Vinyl Shutters", "Vinyl", "Raised Panel", "Decorative", "Mid-America"),
    ("StyleCraft New England Custom Raised Panel Wood Shutters", "Wood", "Raised Panel", "Operable", "StyleCraft"),
    ("StyleCraft New England Custom Louvered Wood Shutters", "Wood", "Louver", "Operable", "StyleCraft"),
    ("StyleCraft Southern Custom Louvered Wood Shutters", "Wood", "Louver", "Operable", "StyleCraft"),
    ("StyleCraft Southern Custom Raised Panel Wood Shutters", "Wood", "Raised Panel", "Operable", "StyleCraft"),
    ("StyleCraft Southern Custom Board and Batten Wood Shutters", "Wood", "Board and Batten", "Operable", "StyleCraft"),
    ("StyleCraft Southern Custom Bahama Wood Shutters", "Wood", "Bahama", "Operable", "StyleCraft"),
    ("StyleCraft Suburban Custom Louvered Composite Shutters", "Composite", "Louver", "Operable", "StyleCraft"),
    ("StyleCraft Suburban Custom Raised Panel Composite Shutters", "Composite", "Raised Panel", "Operable", "StyleCraft"),
    ("StyleCraft Suburban Custom Board and Batten Composite Shutters", "Composite", "Board and Batten", "Operable", "StyleCraft"),
    ("StyleCraft Suburban Custom Bahama Composite Shutters", "Composite", "Bahama", "Operable", "StyleCraft"),
    ("Atlantic Premium Custom Louvered Hybrid Shutters", "Hybrid", "Louver", "Operable", "Atlantic"),
    ("Atlantic Premium Custom Raised Panel Hybrid Shutters", "Hybrid", "Raised Panel", "Operable", "Atlantic"),
    ("Atlantic Premium Custom Board and Batten Hybrid Shutters", "Hybrid", "Board and Batten", "Operable", "Atlantic"),
    ("Atlantic Premium Custom Bahama Hybrid Shutters", "Hybrid", "Bahama", "Operable", "Atlantic"),
]
PRODUCT_ROWS = [(i, *row) for i, row in enumerate(PRODUCTS)]
SCHEMA = "doc_id long, title string, Material string, Style string, Mounting string, Brand string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(PRODUCT_ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def index(spark, docs):
    return index_of(docs, synonyms=default_synonyms(spark))


@pytest.fixture(scope="session")
def rows(spark):
    """rows("a long, b string", (1, "x"), ...) as a DataFrame."""
    return lambda schema, *values: spark.createDataFrame(list(values), schema)


@pytest.fixture
def no_broadcast(monkeypatch):
    """Every lookup takes the way of sides too large to broadcast."""
    from prismdex.operators.sizing import Size

    monkeypatch.setattr(Size, "small", property(lambda self: False))


def pairs(df):
    return sorted(tuple(r) for r in df.collect())
