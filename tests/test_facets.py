import json

import pytest
from conftest import PRODUCT_ROWS, pairs
from pyspark.sql import functions as F

from prismdex.config import IndexConfig
from prismdex.operators import facets as E
from prismdex.operators import response as J
from prismdex.operators import search as S
from prismdex.operators.query_terms import phrase_terms
from prismdex.plans import search as plans

QUERY = "query_id long, phrase string"
SELECTION = "query_id long, field string, value string"
CFG = IndexConfig()

BROWSED = {
    "shutters": "Brand: Atlantic 4, Mid-America 4, StyleCraft 10 · Material: Composite 4, Hybrid 4, Vinyl 4, Wood 6 · "
                "Mounting: Decorative 4, Operable 14 · Style: Bahama 3, Board and Batten 3, Louver 6, Raised Panel 6",
    "louvered": "Brand: Atlantic 1, Mid-America 2, StyleCraft 3 · Material: Composite 1, Hybrid 1, Vinyl 2, Wood 2 · "
                "Mounting: Decorative 2, Operable 4 · Style: Louver 6",
    "custom wood": "Brand: StyleCraft 6 · Material: Wood 6 · Mounting: Operable 6 · "
                   "Style: Bahama 1, Board and Batten 1, Louver 2, Raised Panel 2",
}
REFINED = {
    1: "Brand: Atlantic 0, Mid-America 0, StyleCraft 6 · Material: Composite 0, Hybrid 0, Vinyl 0, Wood 6 · "
       "Mounting: Decorative 0, Operable 6 · Style: Bahama 1, Board and Batten 1, Louver 2, Raised Panel 2",
    2: "Brand: Atlantic 0, Mid-America 2, StyleCraft 2 · Material: Composite 0, Hybrid 0, Vinyl 2, Wood 2 · "
       "Mounting: Decorative 2, Operable 2 · Style: Bahama 0, Board and Batten 0, Louver 4, Raised Panel 0",
}


def shown(counts, query_id):
    """The counts of a query in the form of the goldens."""
    groups = {}
    for field, value, n in sorted((r.field, r.value, r.hit_count) for r in counts if r.query_id == query_id):
        groups.setdefault(field, []).append(f"{value} {n}")
    return " · ".join(f"{field}: {', '.join(values)}" for field, values in groups.items())


def test_browse(rows, index):
    queries = rows(QUERY, *enumerate(BROWSED), (9, "style"), (10, ""))
    facets = plans.browse(index, queries).facets.collect()
    assert {i: shown(facets, i) for i in range(3)} == dict(enumerate(BROWSED.values()))
    assert all(r.query_id < 9 and r.hit_count >= 1 for r in facets)


@pytest.mark.parametrize("broadcast", [True, False])
def test_refine(rows, index, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    queries = rows(QUERY, (1, "shutters"), (2, "shutters"), (3, "style"), (4, "shutters"))
    selections = rows(SELECTION, (1, "Material", "Wood"), (2, "Material", "Wood"), (2, "Material", "Vinyl"),
                      (2, "Style", "Louver"), (4, "Material", "wood"))
    result = plans.refine(index, queries, selections)
    facets = result.facets.collect()
    assert {i: shown(facets, i) for i in REFINED} == REFINED
    assert len(facets) == 4 * 13 and {r.hit_count for r in facets if r.query_id in (3, 4)} == {0}
    hits = [(r.query_id, r.doc_id) for r in result.hits.collect()]
    assert sorted(hits) == [(1, d) for d in range(4, 10)] + [(2, d) for d in (0, 2, 5, 6)]
    enabled = {(r.field, r.value) for r in facets if r.query_id == 1 and r.enabled}
    assert ("Material", "Hybrid") in enabled and ("Brand", "Atlantic") not in enabled and ("Brand", "StyleCraft") in enabled


def test_refine_without_selections_fills_zeros(rows, index):
    result = plans.refine(index, rows(QUERY, (1, "custom wood")), rows(SELECTION), keep=True)
    facets = result.facets.collect()
    assert len(facets) == 13 and sum(r.hit_count for r in facets) == 4 * 6 and result.hits.count() == 6


def test_unknown_field_raises(rows, index):
    with pytest.raises(Exception, match="unknown facet field: material"):
        plans.refine(index, rows(QUERY, (1, "wood")), rows(SELECTION, (1, "material", "Wood"))).hits.collect()


@pytest.mark.parametrize("broadcast", [True, False])
def test_select_facets(docs, rows, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    selections = rows(SELECTION, (1, "Material", "Wood"), (1, "Material", "Vinyl"), (2, "Material", "Wood"),
                      (2, "Style", "Louver"), (2, "Style", "Bahama"), (3, "Brand", "atlantic"))
    want = [(1, d) for d, *r in PRODUCT_ROWS if r[1] in ("Wood", "Vinyl")] + [
        (2, d) for d, *r in PRODUCT_ROWS if r[1] == "Wood" and r[2] in ("Louver", "Bahama")]
    assert pairs(E.select_facets(docs, selections)) == sorted(want)


def test_properties(docs, index, rows):
    hits = S.search_all(index.postings, phrase_terms(rows(QUERY, (1, "custom"))))
    faceted = E.with_facets(hits, docs)
    n = hits.count()
    for field in CFG.facets:
        assert E.facet_counts(faceted).where(f"field = '{field}'").groupBy().sum("hit_count").first()[0] == n

    def left(*selected):
        return {r.doc_id for r in E.refine_hits(faceted, rows(SELECTION, *[(1, *s) for s in selected])).collect()}

    wood, both = left(("Material", "Wood")), left(("Material", "Wood"), ("Material", "Hybrid"))
    assert wood <= both <= {r.doc_id for r in hits.collect()}
    assert left(("Material", "Wood"), ("Style", "Louver")) <= wood


def test_min_hits_and_prefix(docs, index, rows):
    faceted = E.with_facets(S.search_all(index.postings, phrase_terms(rows(QUERY, (1, "shutters")))), docs)
    assert {r.value for r in E.facet_counts(faceted, min_hits=10).collect()} == {"Operable", "StyleCraft"}
    assert {r.value for r in E.facet_counts(faceted, prefix="B").collect()} == {"Bahama", "Board and Batten"}


def test_orders(rows):
    values = [("Apple", 3), ("Apricot", 5), ("Bean", 5), ("Beet", 1), ("Corn", 9), ("Cord", 5), ("Zucchini", 1)]
    counts = rows("query_id long, field string, value string, hit_count long",
                  *[(q, f, v, n) for q in (1, 2) for f in ("A", "B") for v, n in values])
    by_value = [v for v, _ in sorted(values)]
    by_hits = [v for v, _ in sorted(values, key=lambda x: (-x[1], x[0]))]
    for order, want in (("value", by_value), ("hits", by_hits)):
        ranked = E.rank_facets(counts, order).collect()
        for q in (1, 2):
            for f in ("A", "B"):
                got = sorted((r["rank"], r.value) for r in ranked if (r.query_id, r.field) == (q, f))
                assert got == list(enumerate(want, 1))
        top = E.top_facets(counts, 3, order).where("query_id = 1 AND field = 'B'").orderBy("rank").collect()
        assert [r.value for r in top] == want[:3]
        flat = E.sort_facets(counts, order).collect()
        assert [r.value for r in flat] == want * 4
    with pytest.raises(ValueError):
        E.top_facets(counts, 1, "name")


@pytest.mark.parametrize("order", ["value", "hits"])
def test_rank_of_many_values_that_begin_alike(spark, order):
    """200,000 values of one field with a common start are spread evenly; other fields start and end inside a part."""
    many = spark.range(200_000).select(
        F.lit(1).cast("long").alias("query_id"), F.lit("B").alias("field"), F.format_string("Brand#%06d", F.col("id")).alias("value"),
        (F.col("id") * 7919 % 1000).alias("hit_count"))
    few = spark.range(300).select(
        (F.col("id") % 3).alias("query_id"), F.lit("A").alias("field"), F.concat(F.lit("x"), "id").alias("value"), (F.col("id") % 4).alias("hit_count"))
    counts = many.unionByName(few).repartition(5)
    ranked = E.rank_facets(counts, order, parts=8).toPandas()
    by = {"value": ["value"], "hits": ["hit_count", "value"]}[order]
    want = counts.toPandas().sort_values(by, ascending=[False, True][-len(by):] if order == "hits" else True)
    want["rank"] = want.groupby(["query_id", "field"]).cumcount() + 1
    key = ["query_id", "field", "value"]
    assert ranked.sort_values(key).reset_index(drop=True)[[*key, "rank"]].equals(want.sort_values(key).reset_index(drop=True)[[*key, "rank"]])

    # the same ranging as the operator's
    sizes = counts.repartitionByRange(8, "query_id", "field", *E._order(order)).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 2 * sizes.median()


def test_rank_by_shuffle_join(spark, no_broadcast):
    counts = spark.range(1000).select((F.col("id") % 2).alias("query_id"), F.lit("f").alias("field"), F.col("id").cast("string").alias("value"),
                                      F.lit(1).cast("long").alias("hit_count"))
    ranks = E.rank_facets(counts, "value", parts=4).groupBy("query_id").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"))
    assert pairs(ranks) == [(0, 1, 500, 500), (1, 1, 500, 500)]


def test_multi_value_and_facet_suggest(index, rows):
    hits = S.search_all(index.postings, phrase_terms(rows(QUERY, (1, "bahama"))))
    counted = {r.value: r.hit_count for r in E.multi_value_counts(hits, index.postings).collect()}
    assert pairs(E.multi_value_counts(hits, index.postings, max_hits=3)) == pairs(E.multi_value_counts(hits, index.postings))
    assert counted["bahama"] == 3 and counted["stylecraft"] == 2 and "vinyl" not in counted
    best = E.facet_suggest(hits, index.postings, "s", 2).orderBy("rank").collect()
    assert [(r.value, r.hit_count) for r in best] == [("shutters", 3), ("style craft", 2)]


def test_selection_groups(rows):
    boxes = rows("query_id long, field string, value string, checked boolean",
                 (1, "A", "x", True), (1, "A", "y", True), (1, "B", "z", False), (2, "B", "z", True))
    assert pairs(E.nest_selections(boxes)) == [(1, "A", ["x", "y"]), (2, "B", ["z"])]


def test_combinations(docs, index, rows):
    faceted = E.with_facets(S.search_all(index.postings, phrase_terms(rows(QUERY, (1, "shutters")))), docs)
    found = E.facet_combinations(faceted, ["Material", "Style"], 1).collect()
    wood = {r.Style: (r.hit_count, r.doc_id) for r in found if r.Material == "Wood"}
    assert wood == {"Bahama": (1, 9), "Board and Batten": (1, 8), "Louver": (2, 5), "Raised Panel": (2, 4)}


def test_response(index, rows):
    asked = rows(QUERY, (1, "custom wood"), (2, "nothing like it"), (3, None))
    result = plans.browse(index, asked, count=2)
    texts = {r.query_id: r.response for r in J.to_response_json(J.assemble(asked, result.hits, result.facets)).collect()}
    no_groups = {"Phrase": "", "SelectionGroups": [], "Results": [], "FacetGroups": []}
    assert json.loads(texts[3]) == no_groups
    fields = ("Brand", "Material", "Mounting", "Style")
    assert json.loads(texts[2]) == no_groups | {"FacetGroups": [{"Name": f, "Facets": []} for f in fields]}
    flat = pairs(J.flatten_groups(J.assemble(asked, result.hits, result.facets)).where("query_id > 1"))
    assert flat == [(2, f, None, 0) for f in fields]
    text = texts[1]
    answer = json.loads(text)
    assert list(answer) == ["Phrase", "SelectionGroups", "Results", "FacetGroups"]
    assert answer["Phrase"] == "" and answer["SelectionGroups"] == []
    assert answer["Results"] == [PRODUCT_ROWS[6][1], PRODUCT_ROWS[9][1]]
    assert [g["Name"] for g in answer["FacetGroups"]] == ["Brand", "Material", "Mounting", "Style"]
    assert answer["FacetGroups"][0]["Facets"] == [{"Name": "StyleCraft", "Count": 6}]


def test_tables_of_documents_do_not_pass_through_the_driver(spark, index, rows):
    hits = rows("query_id long, doc_id long", *[(1, i) for i in range(18)])
    scored, _ = plans.scored_hits(index, rows("query_id long, phrase string", (1, "shutters")))
    for joined in (E.with_facets(hits, index.docs, index.cfg), E.with_facets(hits, index.docs, index.cfg, 10**6)):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 18
    assert "BroadcastHashJoin" in E.with_facets(scored, index.docs, index.cfg, 18)._jdf.queryExecution().executedPlan().toString()
