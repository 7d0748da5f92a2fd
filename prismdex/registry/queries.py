"""One Spark query per operator of the inventory; every callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismdex.config import SUGGEST_STOP_WORDS, TEXT_STOP_WORDS
from prismdex.functions import folding, ngrams, tokens, words
from prismdex.functions.stopwords import remove_stops_sql
from prismdex.operators import blocks as B
from prismdex.operators import broad as K
from prismdex.operators import dictionary as D
from prismdex.operators import expressions as X
from prismdex.operators import facets as E
from prismdex.operators import patterns as P
from prismdex.operators import rank as R
from prismdex.operators import response as J
from prismdex.operators import search as S
from prismdex.operators import suggest as G
from prismdex.operators.analysis import STANDARD, SUGGEST, SYNONYM, Chain, analyze
from prismdex.operators.query_terms import SHOULD, bool_terms, clause_terms, phrase_terms
from prismdex.operators.sloppy import search_sloppy
from prismdex.plans import index as I
from prismdex.plans import search as plans
from prismdex.registry import inputs
from prismdex.registry import tables as T
from prismdex.sources import store, xml_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks ---------------------------------------------------------------


def _written_xml(spark: SparkSession, sf: str) -> str:
    path = store.workspace(spark, "xml")
    T.products(spark, sf).select("title", F.struct(
        F.col("Material").alias("material"), F.col("Style").alias("style"),
        F.col("Mounting").alias("mounting"), F.col("Brand").alias("brand")).alias("properties"),
    ).write.format("xml").option("rowTag", "product").option("rootTag", "products").save(path)
    return path


@query
def xml_scan(spark, sf):
    return xml_records.read_products(spark, _written_xml(spark, sf)).select("title", "properties.*")


@query
def xml_fields(spark, sf):
    return xml_records.extract_fields(xml_records.read_record_texts(spark, _written_xml(spark, sf)))


@query
def xml_sections(spark, sf):
    """Records with closing tags in CDATA sections, in comments inside them and in comments between them."""
    path = store.workspace(spark, "xml")
    T.products(spark, sf).select(F.expr("""concat(
        if(doc_id % 3 = 0, '<!-- <product><title>old</title></product> -->', ''), '<product><title><![CDATA[', title,
        if(doc_id % 5 = 0, ' </product> <!--', ''), ']]></title><properties><material>', Material, '</material>',
        if(doc_id % 7 = 0, '<!-- </product> ]]> -->', ''), '<style>', Style, '</style><mounting>', Mounting,
        '</mounting><brand>', Brand, '</brand></properties></product>')""").alias("value")).write.text(path)
    return xml_records.extract_fields(xml_records.read_record_texts(spark, path))


@query
def doc_projection(spark, sf):
    return T.products(spark, sf)


@query
def index_roundtrip(spark, sf):
    path = store.workspace(spark, "postings")
    store.write_table(T.product_index(spark, sf).postings.select("term", "doc_id", "tf"), path,
                      sort_by=["term", "doc_id"])
    return store.open_table(spark, path)


@query
def absent_index(spark, sf):
    typed = T.products(spark, sf).select(F.col("doc_id").alias("input_id"), F.col("title").alias("text"))
    return G.suggest(I.open_suggestions(spark, store.workspace(spark, "never-built")), typed)


@query
def build_metrics(spark, sf):
    metrics = I.build_index(spark, T.products(spark, sf), store.workspace(spark, "index"), T.PRODUCTS, T.synonyms(spark))
    return spark.range(1).select(F.lit(metrics["n_docs"]).cast("long").alias("n_docs"))


@query
def build_index(spark, sf):
    path = store.workspace(spark, "index")
    I.build_index(spark, T.articles(spark, sf), path, T.ARTICLES)
    built = I.open_index(spark, path, T.ARTICLES)
    names = ("docs", "postings", "lengths", "frequencies", "suggestions", "vocabulary")
    counts = [getattr(built, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name in names]
    return reduce(DataFrame.unionByName, counts)


@query
def response_json(spark, sf):
    index = T.product_index(spark, sf)
    asked = spark.sql(inputs.PHRASES)
    found = plans.browse(index, asked)
    return J.to_response_json(J.assemble(asked, found.hits, found.facets))


@query
def suggest_json(spark, sf):
    typed = spark.sql(inputs.INPUTS)
    return J.suggestions_json(typed, G.suggest(T.article_index(spark, sf).suggestions, typed))


# --- text analysis -------------------------------------------------------------------


@query
def tokenize_standard(spark, sf):
    return analyze(T.articles(spark, sf), "title", Chain())


@query
def token_normalize(spark, sf):
    raw = T.articles(spark, sf).select(F.explode(tokens.raw_words("title")).alias("word")).distinct()
    return raw.select("word", tokens.strip_word("word").alias("term"))


@query
def ascii_fold(spark, sf):
    terms = analyze(T.articles(spark, sf), "title", Chain()).select("term").distinct()
    return terms.select("term", folding.ascii_fold("term").alias("folded"))


@query
def stopwords_gaps(spark, sf):
    kept = remove_stops_sql(tokens.tokenize_sql("title"), TEXT_STOP_WORDS, gaps=True)
    return T.articles(spark, sf).selectExpr("doc_id", f"inline({kept})")


@query
def stopwords_nogaps(spark, sf):
    kept = remove_stops_sql(tokens.tokenize_sql("title"), SUGGEST_STOP_WORDS, gaps=False)
    return T.articles(spark, sf).selectExpr("doc_id", f"inline({kept})")


@query
def synonym_expand(spark, sf):
    return analyze(T.products(spark, sf), "title", SYNONYM, synonyms=T.synonyms(spark))


@query
def edge_ngrams_front(spark, sf):
    terms = D.term_dictionary(T.article_index(spark, sf).postings)
    return terms.select("term", F.explode(ngrams.edge_ngrams("term", "front", 1, 20)).alias("gram"))


@query
def edge_ngrams_back(spark, sf):
    terms = D.term_dictionary(T.article_index(spark, sf).postings)
    return terms.select("term", F.explode(ngrams.edge_ngrams("term", "back", 2, 5)).alias("gram"))


@query
def edge_ngram_offsets(spark, sf):
    located = T.products(spark, sf).select("doc_id", F.inline(tokens.tokenize_with_offsets("title")))
    grams = ngrams.edge_ngrams_with_offsets("term", "start", "back", 1, 20)
    return located.select("doc_id", "pos", F.inline(grams)).select(
        "doc_id", "pos", "gram", F.col("start").alias("gram_start"), F.col("end").alias("gram_end"))


@query
def token_offsets(spark, sf):
    located = T.articles(spark, sf).select("doc_id", F.inline(tokens.tokenize_with_offsets("title")))
    return located.select("doc_id", "pos", F.col("start").alias("token_start"), F.col("end").alias("token_end"))


@query
def dictionary_minlen(spark, sf):
    return G.suggestable(D.term_dictionary(T.article_index(spark, sf).postings))


@query
def last_word(spark, sf):
    return T.articles(spark, sf).select("doc_id", words.last_word("title").alias("word"))


@query
def facet_slug(spark, sf):
    return T.articles(spark, sf).select("doc_id", words.slug("title").alias("slug"))


@query
def complete_phrase(spark, sf):
    accepted = "concat(' ', Brand, ' ')"
    return T.products(spark, sf).select("doc_id", words.complete_phrase("title", accepted).alias("phrase"))


@query
def analyze_chain(spark, sf):
    docs = T.products(spark, sf)
    runs = {"standard": (STANDARD, None), "synonym": (SYNONYM, T.synonyms(spark)), "suggest": (SUGGEST, None)}
    parts = [analyze(docs, "title", chain, synonyms=known).select(F.lit(name).alias("chain"), "doc_id", "pos", "term")
             for name, (chain, known) in runs.items()]
    return reduce(DataFrame.unionByName, parts)


# --- index tables --------------------------------------------------------------------


@query
def postings(spark, sf):
    return T.product_index(spark, sf).postings.select("doc_id", F.explode("positions").alias("pos"), "term")


@query
def postings_articles(spark, sf):
    return T.article_index(spark, sf).postings.select("term", "doc_id", "tf")


@query
def doc_lengths(spark, sf):
    return T.product_index(spark, sf).lengths


@query
def term_dictionary(spark, sf):
    return D.term_dictionary(T.article_index(spark, sf).postings)


@query
def doc_freq(spark, sf):
    return T.article_index(spark, sf).frequencies


@query
def suggest_field(spark, sf):
    rows = D.occurrences(T.products(spark, sf), T.PRODUCTS, field="Brand")
    return G.build_suggestions(D.doc_freq(D.build_postings(rows)))


@query
def suggestion_table(spark, sf):
    return T.article_index(spark, sf).suggestions


@query
def facet_vocabulary(spark, sf):
    return D.facet_vocabulary(T.products(spark, sf), T.PRODUCTS)


# --- search predicates and ranking ---------------------------------------------------


@query
def term_match(spark, sf):
    return S.match_term(T.article_index(spark, sf).postings, "thanen")


@query
def search_all_terms(spark, sf):
    return S.search_all(T.product_index(spark, sf).postings, phrase_terms(T.name_phrases(spark, sf)))


@query
def search_any_term(spark, sf):
    return S.search_any(T.product_index(spark, sf).postings, phrase_terms(T.name_phrases(spark, sf), SHOULD))


@query
def search_not(spark, sf):
    return S.search_bool(T.product_index(spark, sf).postings, bool_terms(spark.sql(inputs.BOOL_QUERIES)))


@query
def search_nested(spark, sf):
    """A table of nested expressions; the first is (cold OR hot) AND (widget OR (gear AND NOT promo))."""
    index = T.product_index(spark, sf)
    nodes = spark.sql(inputs.EXPRESSIONS).withColumn("parent", F.expr("nullif(parent, 0)"))
    return X.search_expressions(index.postings, nodes, index.docs)


@query
def search_phrase(spark, sf):
    """Every benchmark passage as one phrase, over all articles."""
    return S.search_phrase(T.article_index(spark, sf).postings, phrase_terms(T.passages(spark, sf), whole=True))


@query
def search_phrase_slop(spark, sf):
    return search_sloppy(T.product_index(spark, sf).postings, phrase_terms(T.swapped_names(spark, sf), whole=True), 2)



@query
def search_prefix(spark, sf):
    index = T.article_index(spark, sf)
    return P.postings_of(index.postings, P.match_prefix(index.frequencies, spark.sql(inputs.PREFIXES)))


@query
def search_wildcard(spark, sf):
    index = T.article_index(spark, sf)
    return P.postings_of(index.postings, P.match_pattern(index.frequencies, spark.sql(inputs.PATTERNS)))


@query
def search_fuzzy(spark, sf):
    index = T.article_index(spark, sf)
    return P.postings_of(index.postings, P.match_fuzzy(index.frequencies, spark.sql(inputs.FUZZY)))


@query
def search_patterns_built(spark, sf):
    """Fuzzy words, wildcards and ranges on the files of a built index, one kind per thousand of query_id."""
    index, _ = _built_articles(spark, sf)
    found = [P.match_fuzzy(index.frequencies, spark.sql(inputs.FUZZY), grams=index.grams),
             P.match_pattern(index.frequencies, spark.sql(inputs.PATTERNS)), P.match_ranges(index.frequencies, spark.sql(inputs.OPEN_RANGES))]
    return P.postings_of(index.postings, reduce(DataFrame.unionByName, [
        f.select((F.col("query_id") + 1000 * i).alias("query_id"), "term") for i, f in enumerate(found)]))


@query
def search_range(spark, sf):
    index = T.article_index(spark, sf)
    return P.postings_of(index.postings, P.match_ranges(index.frequencies, spark.sql(inputs.RANGES)))


@query
def search_range_open(spark, sf):
    """Ranges without a lower bound, without an upper bound, and without both."""
    index = T.article_index(spark, sf)
    return P.postings_of(index.postings, P.match_ranges(index.frequencies, spark.sql(inputs.OPEN_RANGES)))


@query
def search_field_term(spark, sf):
    """Every facet value, typed in lower case, as a field term."""
    docs = T.products(spark, sf)
    asked = D.facet_values(docs, T.PRODUCTS).groupBy("field", "value").agg(F.min("doc_id").alias("query_id"))
    return S.match_field(docs, asked, T.PRODUCTS)


@query
def search_match_all(spark, sf):
    return S.match_all(T.products(spark, sf), 1)


@query
def search_empty(spark, sf):
    stop = spark.sql(inputs.PHRASES).where("phrase IN ('', 'the of')")
    return S.search_all(T.product_index(spark, sf).postings, phrase_terms(stop))


@query
def tfidf_score(spark, sf):
    """Articles scored by the words they share with each benchmark passage."""
    index = T.article_index(spark, sf, keep=True)
    return R.score(index.postings, phrase_terms(T.passages(spark, sf), SHOULD), index.frequencies, index.lengths,
                   index.totals, require_all=False)


@query
def tfidf_boost(spark, sf):
    index = T.product_index(spark, sf)
    return R.score(index.postings, clause_terms(spark.sql(inputs.BOOSTED)), index.frequencies, index.lengths,
                   index.totals, require_all=False)


def _built_articles(spark, sf) -> tuple[I.Index, str]:
    path = store.workspace(spark, "index")
    I.build_index(spark, T.articles(spark, sf), path, T.ARTICLES)
    return I.open_index(spark, path, T.ARTICLES), path


def _top_any(spark, sf) -> B.TopAny:
    index, path = _built_articles(spark, sf)
    I.build_blocks(spark, path, T.ARTICLES)
    return B.top_any(index.postings, *I.open_blocks(spark, path), phrase_terms(T.passages(spark, sf), SHOULD), index.frequencies, index.totals)


@query
def tfidf_top_any(spark, sf):
    """The best articles of each benchmark passage, scored only where the bounds of a block allow it."""
    return _top_any(spark, sf).hits


@query
def tfidf_top_any_reads(spark, sf):
    """The postings of each passage's words, and what was read in their place."""
    return _top_any(spark, sf).reads


@query
def tfidf_bool(spark, sf):
    """Required, optional and prohibited words together."""
    index = T.product_index(spark, sf)
    return R.score_bool(index.postings, bool_terms(spark.sql(inputs.BOOL_QUERIES)), index.frequencies, index.lengths, index.totals)


@query
def top_hits(spark, sf):
    scored, _ = plans.scored_hits(T.product_index(spark, sf), spark.sql(inputs.PHRASES))
    return R.top_hits(scored, offset=5, count=50)


@query
def hit_titles(spark, sf):
    index = T.product_index(spark, sf)
    scored, cost = plans.scored_hits(index, spark.sql(inputs.PHRASES))
    return R.fetch(R.top_hits(scored), index.docs, ["title"], cost.n_queries * 50).select("query_id", "rank", "title")


@query
def hit_count(spark, sf):
    index = T.product_index(spark, sf)
    return S.hit_count(S.search_all(index.postings, phrase_terms(T.name_phrases(spark, sf))))


# --- facets --------------------------------------------------------------------------


@query
def facet_filter_or(spark, sf):
    return E.select_facets(T.products(spark, sf), spark.sql(inputs.SELECTIONS_OR), T.PRODUCTS)


@query
def facet_filter_and(spark, sf):
    return E.select_facets(T.products(spark, sf), spark.sql(inputs.SELECTIONS), T.PRODUCTS)


def _hits(spark, sf, index: I.Index) -> DataFrame:
    return S.search_all(index.postings, phrase_terms(spark.sql(inputs.PHRASES)))


def _faceted(spark, sf) -> tuple[I.Index, DataFrame]:
    index = T.product_index(spark, sf)
    return index, E.with_facets(_hits(spark, sf, index), index.docs, index.cfg)


def _refined(spark, sf) -> tuple[I.Index, DataFrame]:
    index, faceted = _faceted(spark, sf)
    return index, E.refine_hits(faceted, spark.sql(inputs.SELECTIONS), index.cfg)


@query
def search_refine(spark, sf):
    return _refined(spark, sf)[1].select("query_id", "doc_id")


@query
def facet_counts_browse(spark, sf):
    index, faceted = _faceted(spark, sf)
    return E.facet_counts(faceted, index.cfg)


@query
def term_facets(spark, sf):
    """Facet counts of every term of 20 products or more."""
    index = T.product_index(spark, sf)
    return K.term_facets(index.postings, index.docs, index.frequencies, index.cfg, 20)


@query
def facet_counts_kept(spark, sf):
    """The facets of browsed phrases, those of frequent single terms from the counts kept with the build."""
    path = store.workspace(spark, "index")
    I.build_index(spark, T.products(spark, sf), path, T.PRODUCTS, T.synonyms(spark))
    I.build_facet_counts(spark, path, T.PRODUCTS, 20)
    return plans.browse(I.open_index(spark, path, T.PRODUCTS), spark.sql(inputs.PHRASES), kept=I.open_facet_counts(spark, path)).facets


@query
def facet_min_hits(spark, sf):
    index, faceted = _faceted(spark, sf)
    return E.facet_counts(faceted, index.cfg, min_hits=10)


@query
def facet_counts_refine(spark, sf):
    index, refined = _refined(spark, sf)
    return E.facet_counts_zero_filled(refined, spark.sql(inputs.PHRASES), index.vocabulary, index.cfg)


@query
def facet_order_value(spark, sf):
    return E.rank_facets(facet_counts_browse(spark, sf), "value")


@query
def facet_order_hits(spark, sf):
    return E.rank_facets(facet_counts_browse(spark, sf), "hits")


@query
def facet_order_terms(spark, sf):
    """Every term of the articles as a value of one field, most frequent first."""
    index = T.article_index(spark, sf)
    return E.rank_facets(E.multi_value_counts(S.match_all(index.docs, 1), index.postings), "hits")


@query
def facet_prefix(spark, sf):
    index, faceted = _faceted(spark, sf)
    return E.facet_counts(faceted, index.cfg, prefix="Brand#1")


@query
def facet_multi_value(spark, sf):
    index = T.product_index(spark, sf)
    return E.multi_value_counts(_hits(spark, sf, index), index.postings)


@query
def facet_suggest(spark, sf):
    index = T.article_index(spark, sf)
    return E.facet_suggest(S.match_all(index.docs, 1), index.postings, "th")


@query
def facet_groups_nested(spark, sf):
    asked = spark.sql(inputs.PHRASES)
    found = plans.browse(T.product_index(spark, sf), asked)
    return J.assemble(asked, found.hits, found.facets)


@query
def facet_groups_flat(spark, sf):
    return J.flatten_groups(facet_groups_nested(spark, sf))


def _boxes(spark, sf) -> DataFrame:
    """A box for every facet value, checked where an even number of products has it."""
    values = D.facet_values(T.products(spark, sf), T.PRODUCTS).groupBy("field", "value").agg(F.count("*").alias("n"))
    return values.select(F.lit(1).cast("long").alias("query_id"), "field", "value", (F.col("n") % 2 == 0).alias("checked"))


@query
def selection_groups(spark, sf):
    nested = E.nest_selections(_boxes(spark, sf))
    return nested.select("query_id", "field", F.explode("selections").alias("value"))


@query
def facet_state(spark, sf):
    return E.facet_state(facet_counts_refine(spark, sf), spark.sql(inputs.SELECTIONS), T.PRODUCTS)


@query
def facet_combinations(spark, sf):
    _, faceted = _faceted(spark, sf)
    return E.facet_combinations(faceted, ["Material", "Style"], 50)


# --- suggestions ---------------------------------------------------------------------


@query
def suggest_topk(spark, sf):
    index = T.article_index(spark, sf)
    return G.suggest(index.suggestions, spark.sql(inputs.INPUTS), best=index.best)


@query
def suggest_more(spark, sf):
    """More words than are kept beforehand: from the full table."""
    index = T.article_index(spark, sf)
    return G.suggest(index.suggestions, spark.sql(inputs.INPUTS), 30, best=index.best)


@query
def suggest_popular(spark, sf):
    index = T.article_index(spark, sf)
    return G.suggest(index.suggestions, spark.sql(inputs.INPUTS), order="count_desc", best=index.best)


def _typed_prefixes(spark, sf) -> DataFrame:
    """What was typed of every conversation turn after 0, 1, 2, 3 and all characters."""
    turns = T.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return turns.select(F.posexplode(F.expr("array(0, 1, 2, 3, length(text))")).alias("at", "n"), "turn_id", "text").select(
        (F.col("turn_id") * 10 + F.col("at")).alias("input_id"), F.expr("left(text, n)").alias("text"))


@query
def suggest_gate(spark, sf):
    return G.passes_gate(_typed_prefixes(spark, sf)).select("input_id")


@query
def suggest_gate_long(spark, sf):
    return G.passes_gate(T.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("input_id"), "text"), 80).select("input_id")


# --- jobs ----------------------------------------------------------------------------


@query
def browse_hits(spark, sf):
    return plans.browse(T.product_index(spark, sf), T.name_phrases(spark, sf)).hits


@query
def browse_facets(spark, sf):
    return plans.browse(T.product_index(spark, sf), T.name_phrases(spark, sf)).facets


def _built_products(spark, sf) -> I.Index:
    path = store.workspace(spark, "index")
    I.build_index(spark, T.products(spark, sf), path, T.PRODUCTS, T.synonyms(spark))
    return I.open_index(spark, path, T.PRODUCTS)


@query
def browse_built(spark, sf):
    """Browsing on the files of a built index."""
    return plans.browse(_built_products(spark, sf), T.name_phrases(spark, sf)).hits


@query
def refine_built(spark, sf):
    return plans.refine(_built_products(spark, sf), spark.sql(inputs.PHRASES), spark.sql(inputs.SELECTIONS)).facets


@query
def refine_hits(spark, sf):
    return plans.refine(T.product_index(spark, sf), spark.sql(inputs.PHRASES), spark.sql(inputs.SELECTIONS)).hits


@query
def refine_facets(spark, sf):
    return plans.refine(T.product_index(spark, sf), spark.sql(inputs.PHRASES), spark.sql(inputs.SELECTIONS)).facets


@query
def browse_log(spark, sf):
    """Every part name as a line of a query log: many lines, few different phrases."""
    log = T.table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("phrase"))
    return plans.answer_log(T.product_index(spark, sf), log).facets
