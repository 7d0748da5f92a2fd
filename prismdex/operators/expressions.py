"""Nested boolean expressions as rows, decided per document in one aggregate.

A node is (query_id, node, parent, op, text): op is `and`, `or`, `not` (none of its children) or `term`, whose text
is a word or a phrase. The root has no parent, and a node's number is greater than its parent's; so the
nodes taken backwards come children first. Text of nothing but stop words vanishes from its group, as a
clause does in a flat query, and so does a group that has lost all its children.

However deep the expressions are, a document's matched leaves come together once; the groups are decided in
turn on each different set of them. A query whose expression holds for a document without any of its words needs all documents; only such
queries read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.operators.analysis import STANDARD, Chain
from prismdex.operators.query_terms import SHOULD, clause_terms, probe_terms
from prismdex.operators.search import match_clauses
from prismdex.operators.sizing import lookup_join, settle
from prismdex.sources.store import write_once

TERM = "term"
#: Queries that are answered for all documents in one pass.
NEGATIVE_BLOCK = 1_000

_CHILDREN = "transform(filter(nodes, c -> c.parent = x.node), c -> c.node)"
_ALIVE = (f"aggregate(nodes, CAST(array() AS array<int>), (alive, x) -> IF(x.leaf OR (x.op <> '{TERM}' AND "
          f"arrays_overlap(alive, {_CHILDREN})), array_append(alive, x.node), alive))")
_STEPS = (f"transform(filter(nodes, x -> x.op <> '{TERM}' AND array_contains(alive, x.node)), x -> "
          f"struct(x.node AS node, x.op AS op, array_intersect({_CHILDREN}, alive) AS children))")


def _holds(matched: str) -> str:
    """Whether the expression holds, from the array of its matched leaves."""
    group = ("CASE s.op WHEN 'and' THEN size(array_except(s.children, t)) = 0 WHEN 'or' THEN arrays_overlap(s.children, t) "
             "ELSE NOT arrays_overlap(s.children, t) END")
    return f"array_contains(aggregate(steps, {matched}, (t, s) -> IF({group}, array_append(t, s.node), t)), root)"


def _checked(nodes: DataFrame) -> DataFrame:
    known = F.col("op").isin("and", "or", "not", TERM) & F.coalesce(F.col("parent") < F.col("node"), F.lit(True))
    wrong = F.raise_error(F.concat(F.lit("unknown op, or a parent of greater number: node "), F.col("node"), F.lit(" of query "), F.col("query_id")))
    return nodes.select("query_id", F.when(known, F.col("node").cast("int")).otherwise(wrong.cast("int")).alias("node"),
                        F.col("parent").cast("int"), "op", "text")


def programs(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(query_id, root, steps, everywhere): the groups of each query, children first, and whether it holds without any leaf.

    `leaves` are the (query_id, node) of terms that the analysis leaves something of. A query with
    nothing left, or without exactly one root, has no row or raises.
    """
    about = F.struct(F.col("node"), F.col("parent"), F.col("op"), F.col("leaf").isNotNull().alias("leaf"))
    whole = (
        nodes.join(leaves.withColumn("leaf", F.lit(True)), ["query_id", "node"], "left")
        .groupBy("query_id").agg(
            F.sort_array(F.collect_list(about), asc=False).alias("nodes"),
            F.min_by("node", F.col("parent").isNotNull()).alias("root"), F.count_if(F.col("parent").isNull()).alias("n_roots"))
    )
    one = F.when(F.col("n_roots") == 1, F.col("root")).otherwise(
        F.raise_error(F.concat(F.lit("not one root: query "), F.col("query_id"))).cast("int"))
    return (
        whole.withColumn("root", one).withColumn("alive", F.expr(_ALIVE)).where("array_contains(alive, root)")
        .withColumn("steps", F.expr(_STEPS))
        .select("query_id", "root", "steps", F.expr(_holds("CAST(array() AS array<int>)")).alias("everywhere"))
    )


def search_expressions(postings: DataFrame, nodes: DataFrame, docs: DataFrame, key: str = "doc_id",
                       chain: Chain = STANDARD) -> DataFrame:
    """(query_id, key): the documents each expression holds for; `docs` are all documents of the index."""
    nodes, size = settle(_checked(nodes))
    texts = nodes.where(F.col("op") == TERM).select("query_id", F.col("node").alias("clause"), "text", F.lit(SHOULD).alias("occur"))
    terms = clause_terms(texts, chain)
    probe = probe_terms(terms)
    plans, _ = settle(programs(nodes, probe.table.select("query_id", F.col("clause").alias("node")).distinct()))
    met = match_clauses(postings, probe, key=key).select("query_id", key, F.col("clause").cast("int").alias("leaf"))
    ids = [r["query_id"] for r in plans.where("everywhere").select("query_id").collect()]
    for lo in range(0, len(ids), NEGATIVE_BLOCK):
        block = F.array(*[F.lit(i).cast("long") for i in ids[lo:lo + NEGATIVE_BLOCK]])
        met = met.unionByName(docs.select(F.explode(block).alias("query_id"), key, F.lit(None).cast("int").alias("leaf")))
    together = write_once(met.groupBy("query_id", key).agg(F.sort_array(F.collect_set("leaf")).alias("matched")), "leaves")
    # Many documents match the same leaves of a query: an expression is decided once for each set of them.
    sets = lookup_join(together.select("query_id", "matched").distinct(), plans.drop("everywhere"), "query_id", "inner", "matched", size)
    return lookup_join(together, sets.where(_holds("matched")).select("query_id", "matched"), ["query_id", "matched"], "inner", key).select("query_id", key)
