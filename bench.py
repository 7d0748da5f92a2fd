"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The index of the articles and of the products is built into Parquet files once; the
search queries then run on the opened files. Every query is run twice and the faster
run counts, the build is run once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from prismdex.operators import facets as E
from prismdex.operators import patterns as P
from prismdex.operators import rank as R
from prismdex.operators import search as S
from prismdex.operators import suggest as G
from prismdex.operators.analysis import STANDARD, analyze
from prismdex.operators.query_terms import SHOULD, phrase_terms
from prismdex.operators.sloppy import search_sloppy
from prismdex.plans import index as I
from prismdex.plans import search as plans
from prismdex.registry import inputs
from prismdex.registry import tables as T
from prismdex.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = local_session(CPUS)
    folder = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    timings: dict[str, float] = {}

    def timed(name: str, run, times: int = 2):
        spent = []
        for _ in range(times):
            started = time.perf_counter()
            result = run()
            spent.append(time.perf_counter() - started)
        timings[name] = round(min(spent), 3)
        print(f"{name:28} {timings[name]:8.3f}s", file=sys.stderr, flush=True)
        return result

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    products, articles = T.products(spark, SF), T.articles(spark, SF)
    timed("tokenize_articles", lambda: drain(analyze(articles.repartition(int(CPUS)), "title", STANDARD)))
    timed("build_articles", lambda: I.build_index(
        spark, articles, f"{folder}/articles", T.ARTICLES, files=int(CPUS)), 1)
    timed("build_products", lambda: I.build_index(
        spark, products, f"{folder}/products", T.PRODUCTS, T.synonyms(spark)), 1)
    on_articles = I.open_index(spark, f"{folder}/articles", T.ARTICLES)
    on_products = I.open_index(spark, f"{folder}/products", T.PRODUCTS)

    names, passages = T.name_phrases(spark, SF), T.passages(spark, SF)
    phrases, selections = spark.sql(inputs.PHRASES), spark.sql(inputs.SELECTIONS)
    log = T.table(spark, SF, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("phrase"))
    typed = T.table(spark, SF, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("input_id"), "text")

    timed("search_all_terms", lambda: drain(S.search_all(on_products.postings, phrase_terms(names))))
    timed("search_any_articles", lambda: drain(S.search_any(on_articles.postings, phrase_terms(passages, SHOULD))))
    timed("search_phrase_articles", lambda: drain(S.search_phrase(on_articles.postings, phrase_terms(passages, whole=True), on_articles.frequencies)))
    timed("search_phrase_slop", lambda: drain(search_sloppy(
        on_products.postings, phrase_terms(T.swapped_names(spark, SF), whole=True), 2)))
    timed("search_wildcard", lambda: drain(P.postings_of(
        on_articles.postings, P.match_pattern(on_articles.frequencies, spark.sql(inputs.PATTERNS)))))
    timed("search_fuzzy", lambda: drain(P.postings_of(
        on_articles.postings, P.match_fuzzy(on_articles.frequencies, spark.sql(inputs.FUZZY), grams=on_articles.grams))))
    timed("facet_counts_browse", lambda: drain(plans.browse(on_products, names).facets))
    timed("facet_counts_refine", lambda: drain(plans.refine(on_products, phrases, selections).facets))
    timed("tfidf_top50_products", lambda: drain(plans.browse(on_products, names).hits))
    timed("tfidf_top50_articles", lambda: drain(R.top_hits(R.score(
        on_articles.postings, phrase_terms(passages, SHOULD), on_articles.frequencies, on_articles.lengths,
        on_articles.totals, require_all=False))))
    timed("browse_log", lambda: drain(plans.answer_log(on_products, log).facets))
    timed("suggestion_table", lambda: drain(G.build_suggestions(on_articles.frequencies)))
    timed("suggest_batch", lambda: drain(G.suggest(on_articles.suggestions, typed, best=on_articles.best)))
    timed("facet_suggest", lambda: drain(E.facet_suggest(
        S.match_all(on_articles.docs, 1), on_articles.postings, "th")))
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
