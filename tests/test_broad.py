"""Facet counts kept with a build, held against counting the hits."""

from __future__ import annotations

import pytest

from prismdex.config import IndexConfig
from prismdex.operators.broad import broad_queries
from prismdex.plans import index as I
from prismdex.plans.search import browse

ASKED = [(1, "shutters"), (2, "Shutters wood shutters"), (3, "custom"), (4, "Custom CUSTOM"), (5, "bahama"), (6, "mid-america"),
         (7, "nowhere"), (8, ""), (9, "wood")]


def counted(df):
    return sorted(map(tuple, df.select("query_id", "field", "value", "hit_count").collect()))


@pytest.fixture(scope="module")
def built(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("broad"))
    I.build_index(spark, docs, path)
    return path


@pytest.mark.parametrize("min_docs", [1, 5, 1000])
def test_kept_counts_are_the_counts_of_the_hits(spark, built, rows, min_docs):
    I.build_facet_counts(spark, built, min_docs=min_docs)
    index, asked = I.open_index(spark, built), rows("query_id long, phrase string", *ASKED)
    found = browse(index, asked, kept=I.open_facet_counts(spark, built))
    plain = browse(index, asked)
    assert counted(found.facets) == counted(plain.facets) != []
    assert sorted(found.hits.collect()) == sorted(plain.hits.collect())


def test_frequent_single_terms_read_no_documents(spark, built, rows):
    I.build_facet_counts(spark, built, min_docs=5)
    asked = rows("query_id long, phrase string", (1, "shutters"), (2, "custom custom"))
    facets = browse(I.open_index(spark, built), asked, kept=I.open_facet_counts(spark, built)).facets
    assert facets.inputFiles() and all("/term_facets/" in file for file in facets.inputFiles())


def test_what_is_broad(spark, built, rows):
    asked = rows("query_id long, phrase string", *ASKED)
    broad, _ = broad_queries(asked, I.open_index(spark, built).frequencies, 5)
    assert sorted(map(tuple, broad.collect())) == [(1, "shutters"), (3, "custom"), (4, "custom"), (9, "wood")]


def test_null_facets_and_no_documents(spark, rows, tmp_path):
    schema = "doc_id long, title string, Material string, Style string, Mounting string, Brand string"
    asked = rows("query_id long, phrase string", (1, "oak"))
    for name, data in (("nulls", [(1, "oak", None, "s", None, None), (2, "oak", None, None, None, None)]), ("empty", [])):
        path = str(tmp_path / name)
        I.build_index(spark, spark.createDataFrame(data, schema), path, IndexConfig())
        I.build_facet_counts(spark, path, min_docs=1)
        found = browse(I.open_index(spark, path), asked, kept=I.open_facet_counts(spark, path)).facets
        assert counted(found) == ([(1, "Style", "s", 1)] if data else [])
