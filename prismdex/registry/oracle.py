"""The registered queries as SQL over the same tables, written on their own terms.

Each entry is a list of common table expressions and a final SELECT.
"""

from __future__ import annotations

from prismdex.config import SUGGEST_STOP_WORDS, TEXT_STOP_WORDS
from prismdex.functions.tokens import word_pattern
from prismdex.registry import inputs

# The letters of the test data are Latin-1; small classes keep this regex engine fast.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = word_pattern(f"[{_LETTERS}]", f"[{_LETTERS}0-9]", f"[{_LETTERS}0-9]", possessive=False)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _strip(raw: str) -> str:
    return (f"CASE WHEN right({raw}, 2) IN ('''s', '''S') THEN left({raw}, length({raw}) - 2) "
            rf"WHEN regexp_full_match({raw}, '\p{{L}}(\.\p{{L}})+\.') THEN replace({raw}, '.', '') "
            f"WHEN right({raw}, 1) = '.' THEN left({raw}, length({raw}) - 1) ELSE {raw} END")


def _fold(term: str) -> str:
    return f"replace(replace(strip_accents({term}), 'ß', 'ss'), 'æ', 'ae')"


def _words(source: str, text: str, *carry: str) -> str:
    """Raw words with their positions."""
    kept = ", ".join(carry)
    return (f"SELECT {kept}, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos "
            f"FROM (SELECT {kept}, regexp_extract_all({text}, '{_WORD}') AS l FROM {source})")


def _tokens(source: str, text: str, *carry: str) -> str:
    kept = ", ".join(carry)
    return (f"SELECT {kept}, pos::INTEGER AS pos, lower({_strip('raw')}) AS term "
            f"FROM ({_words(source, text, *carry)}) WHERE length(raw) <= 255")


def _text_tokens(source: str, text: str, *carry: str) -> str:
    return f"SELECT * FROM ({_tokens(source, text, *carry)}) WHERE term NOT IN {_in(TEXT_STOP_WORDS)}"


PRODUCTS = """products AS (SELECT p_partkey AS doc_id, concat_ws(' ', p_type, p_name) AS title, p_type AS "Material",
 split_part(p_name, ' ', 2) AS "Style", CASE WHEN p_size <= 25 THEN 'Compact' ELSE 'Full' END AS "Mounting",
 p_brand AS "Brand" FROM part)"""
ARTICLES = "articles AS (SELECT doc_id, text AS title, lang, source FROM documents)"
SYN = f"syn AS ({inputs.SYNONYMS_SQL})"

# occ: (doc_id, pos, term) with synonyms; post: one row per term and document.
P_BASE = f"base AS ({_text_tokens('products', 'title', 'doc_id')})"
P_OCC = "occ AS (SELECT * FROM base UNION ALL SELECT doc_id, pos, synonym FROM base JOIN syn USING (term))"
A_OCC = f"occ AS ({_text_tokens('articles', 'title', 'doc_id')})"
POST = "post AS (SELECT term, doc_id, count(*)::INTEGER AS tf FROM occ GROUP BY ALL)"
DF = "df AS (SELECT term, count(*) AS doc_freq FROM post GROUP BY term)"
P_INDEX = (PRODUCTS, SYN, P_BASE, P_OCC, POST, DF)
A_INDEX = (ARTICLES, A_OCC, POST, DF)
VOCAB_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, \"{f}\" AS value FROM products" for f in ("Material", "Style", "Mounting", "Brand"))
FACETS = f"fv AS ({VOCAB_ROWS})"
VOCAB = "vocab AS (SELECT DISTINCT field, value FROM fv)"


def _query_terms(source: str, whole: bool = False) -> tuple[str, ...]:
    """q: (query_id, clause, pos, term, size, n) of the phrases in `source`."""
    chunks = "[phrase]" if whole else r"regexp_split_to_array(phrase, '\s+')"
    return (
        f"asked AS ({source})",
        f"chunk AS (SELECT query_id, unnest(c) AS chunk, generate_subscripts(c, 1) AS clause "
        f"FROM (SELECT query_id, {chunks} AS c FROM asked))",
        f"qtok AS ({_text_tokens('chunk', 'chunk', 'query_id', 'clause')})",
        "q AS (SELECT *, count(*) OVER (PARTITION BY query_id, clause) AS size, "
        "(SELECT count(DISTINCT clause) FROM qtok x WHERE x.query_id = qtok.query_id) AS n FROM qtok)",
    )


# m: (query_id, clause, doc_id, freq), a clause matched where all its terms share a start.
MATCH = ("m AS (SELECT query_id, clause, n, doc_id, count(*) AS freq FROM ("
         "SELECT q.query_id, q.clause, q.n, occ.doc_id, occ.pos - q.pos AS start FROM q JOIN occ USING (term) "
         "GROUP BY ALL HAVING count(*) = any_value(q.size)) GROUP BY ALL)")
HITS = "hits AS (SELECT query_id, doc_id FROM m GROUP BY query_id, doc_id HAVING count(*) = any_value(n))"
LENGTHS = ("len AS (SELECT doc_id, count(*) AS n_terms, count(DISTINCT pos) AS n_positions FROM occ GROUP BY doc_id)")
NORM = ("norm AS (SELECT doc_id, p * (1 + floor((x / p - 1) * 4) / 4) AS norm FROM "
        "(SELECT doc_id, x, pow(2, floor(log2(x))) AS p FROM (SELECT doc_id, 1 / sqrt(n_terms) AS x FROM len)))")


def _weights(docs: str, boost: str = "1.0") -> str:
    return (f"w AS (SELECT query_id, clause, {boost} * pow(sum(1 + ln((SELECT count(*) FROM {docs}) / "
            "(coalesce(doc_freq, 0) + 1.0))), 2) AS weight FROM q LEFT JOIN df USING (term) GROUP BY query_id, clause)")


def _scored(require_all: bool = True) -> str:
    having = " HAVING count(*) = any_value(n)" if require_all else ""
    return ("scored AS (SELECT query_id, doc_id, round(raw * norm * coord * 1e6)::BIGINT AS score FROM "
            "(SELECT query_id, doc_id, sum(sqrt(freq) * weight) AS raw, count(*) / any_value(n) AS coord "
            f"FROM m JOIN w USING (query_id, clause) GROUP BY query_id, doc_id{having}) JOIN norm USING (doc_id))")


RANKED = ("ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS "
          "rank, doc_id, score FROM scored)")

P_SEARCH = (*P_INDEX, *_query_terms(inputs.PHRASES), MATCH, HITS)
P_NAMES = (*P_INDEX, *_query_terms(inputs.NAME_PHRASES), MATCH, HITS)
P_SCORED = (*P_SEARCH, LENGTHS, NORM, _weights("products"), _scored(), RANKED)
N_SCORED = (*P_NAMES, LENGTHS, NORM, _weights("products"), _scored(), RANKED)
SELECTED = f"sel AS ({inputs.SELECTIONS})"
# refined: the hits where every field with a selection has one of the selected values.
REFINED = ("refined AS (SELECT h.query_id, h.doc_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM "
           "(SELECT DISTINCT query_id, field FROM sel) s WHERE s.query_id = h.query_id AND NOT EXISTS "
           "(SELECT 1 FROM fv JOIN sel v ON v.field = fv.field AND v.value = fv.value AND v.query_id = s.query_id "
           "WHERE fv.doc_id = h.doc_id AND fv.field = s.field)))")
BROWSED = ("counts AS (SELECT query_id, field, value, count(*) AS hit_count FROM hits JOIN fv USING (doc_id) "
           "GROUP BY ALL)")
FILLED = ("filled AS (SELECT a.query_id, v.field, v.value, coalesce(c.n, 0)::BIGINT AS hit_count FROM asked a CROSS JOIN vocab v "
          "LEFT JOIN (SELECT query_id, field, value, count(*) AS n FROM refined JOIN fv USING (doc_id) GROUP BY ALL) c "
          "ON c.query_id = a.query_id AND c.field = v.field AND c.value = v.value)")
# Every field of every phrase that was searched, with or without hits.
SEARCHED_GROUPS = ("searched AS (SELECT query_id, field FROM asked, (SELECT unnest(['Material', 'Style', 'Mounting', 'Brand']) AS field) "
                   "WHERE trim(phrase) <> '')")
P_FACETS = (*P_SEARCH, FACETS, BROWSED)
P_REFINED = (*P_SEARCH, FACETS, VOCAB, SELECTED, REFINED, FILLED)
STATE = ("SELECT f.*, hit_count > 0 OR EXISTS (SELECT 1 FROM sel s WHERE s.query_id = f.query_id AND s.field = f.field) "
         "AS enabled FROM filled f")


def _grams(freq: str) -> tuple[str, ...]:
    """sug: (gram, word, doc_freq) of a (term, doc_freq) table."""
    return (
        f"longer AS (SELECT term AS word, doc_freq FROM {freq} WHERE length(term) >= 3)",
        f"part_words AS (SELECT word, doc_freq, {_fold('term')} AS part FROM ({_tokens('longer', 'word', 'word', 'doc_freq')}))",
        "sug AS (SELECT DISTINCT part[1:n] AS gram, word, doc_freq FROM part_words, range(1, 21) r(n) "
        f"WHERE n <= length(part) AND part NOT IN {_in(SUGGEST_STOP_WORDS)})",
    )


def _suggested(order: str, k: int = 8) -> str:
    last = r"lower(regexp_extract(text, '\S*$'))"
    return ("SELECT input_id, rank, word, doc_freq FROM (SELECT input_id, word, doc_freq, row_number() OVER "
            f"(PARTITION BY input_id ORDER BY {order})::INTEGER AS rank FROM ({inputs.INPUTS}) i JOIN sug ON gram = {last} "
            f"WHERE trim(text) <> '') WHERE rank <= {k}")


def _pattern_hits(source: str, test: str) -> str:
    return (f"SELECT DISTINCT query_id, doc_id FROM post JOIN (SELECT query_id, term FROM ({source}) JOIN df ON {test}) "
            "USING (term)")


_BOOL = " UNION ALL ".join(
    f"SELECT query_id, '{kind}' AS occur, unnest(string_split({kind}, ' ')) AS term FROM ({inputs.BOOL_QUERIES}) "
    f"WHERE {kind} IS NOT NULL" for kind in ("must", "should", "must_not"))


def _has(*words: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM post WHERE term IN {_in(words)})"


def _nested(rows, parent: int = 0) -> str:
    """The expression below a node as a condition on doc_id."""
    parts = []
    for _, node, above, op, text in rows:
        if above == parent:
            below = _nested(rows, node) if op != "term" else None
            parts.append({"term": lambda: _has(text.lower()), "not": lambda: f"NOT ({below})"}.get(op, lambda: f"({below})")())
    joiner = next((f" {op.upper()} " for _, node, _, op, _ in rows if node == parent and op in ("and", "or")), " OR ")
    return joiner.join(parts)


def _by_query():
    ids = sorted({r[0] for r in inputs.EXPRESSION_ROWS})
    return [(i, [r for r in inputs.EXPRESSION_ROWS if r[0] == i]) for i in ids]


def _entry(ctes, select: str) -> str:
    return (f"WITH {', '.join(ctes)} " if ctes else "") + select


# levenshtein() counts bytes here, so the accented letters of the data become one-byte signs first.
_SHORT_EDIT = ("1.0 - levenshtein(translate(lower(word), 'éóèñçüêäößí', '!#$%&()*+;<'), translate(term, 'éóèñçüêäößí', "
               "'!#$%&()*+;<')) / least(length(word), length(term))::DOUBLE > 0.5")
_LIKE = "replace(replace(lower(pattern), '*', '%'), '?', '_')"
_FLAT = 'title, "Material" AS material, "Style" AS style, "Mounting" AS mounting, "Brand" AS brand'
_OPEN_RANGE = ("CASE WHEN inclusive THEN (low IS NULL OR term >= lower(low)) AND (high IS NULL OR term <= lower(high)) "
               "ELSE (low IS NULL OR term > lower(low)) AND (high IS NULL OR term < lower(high)) END")
_RANGE = ("CASE WHEN inclusive THEN term BETWEEN lower(low) AND lower(high) "
          "ELSE term > lower(low) AND term < lower(high) END")

ORACLE: dict[str, str] = {
    # sources and sinks
    "xml_scan": _entry((PRODUCTS,), f"SELECT {_FLAT} FROM products"),
    "xml_fields": _entry((PRODUCTS,), "SELECT * EXCLUDE (doc_id) FROM products"),
    "xml_sections": _entry((PRODUCTS,), "SELECT * EXCLUDE (doc_id) REPLACE (CASE WHEN doc_id % 5 = 0 THEN title || ' </product> <!--' "
                           "ELSE title END AS title) FROM products"),
    "doc_projection": _entry((PRODUCTS,), "SELECT * FROM products"),
    "index_roundtrip": _entry(P_INDEX, "SELECT * FROM post"),
    "absent_index": "SELECT 0::BIGINT AS input_id, 0::INTEGER AS rank, '' AS word, 0::BIGINT AS doc_freq WHERE false",
    "build_metrics": "SELECT count(*) AS n_docs FROM part",
    "build_index": _entry(
        (*A_INDEX, *_grams("df")),
        "SELECT 'docs' AS table_name, count(*) AS n_rows FROM articles UNION ALL SELECT 'postings', count(*) FROM post "
        "UNION ALL SELECT 'lengths', count(DISTINCT doc_id) FROM occ UNION ALL SELECT 'frequencies', count(*) FROM df "
        "UNION ALL SELECT 'suggestions', count(*) FROM sug UNION ALL SELECT 'vocabulary', "
        "count(DISTINCT lang) + count(DISTINCT source) FROM articles"),
    "response_json": _entry(
        (*P_SCORED, FACETS, BROWSED,
         "pages AS (SELECT query_id, string_agg('\"' || title || '\"', ',' ORDER BY rank) AS results FROM ranked "
         "JOIN products USING (doc_id) WHERE rank <= 50 GROUP BY query_id)",
         "grouped AS (SELECT query_id, field, string_agg('{\"Name\":\"' || value || '\",\"Count\":' || hit_count || '}', ',' "
         "ORDER BY value) AS facets FROM counts GROUP BY ALL)", SEARCHED_GROUPS,
         "grouped_all AS (SELECT query_id, field, coalesce(facets, '') AS facets FROM searched LEFT JOIN grouped USING (query_id, field))",
         "nested AS (SELECT query_id, string_agg('{\"Name\":\"' || field || '\",\"Facets\":[' || facets || ']}', ',' "
         "ORDER BY field) AS groups FROM grouped_all GROUP BY query_id)"),
        "SELECT query_id, '{\"Phrase\":\"\",\"SelectionGroups\":[],\"Results\":[' || coalesce(results, '') || '],\"FacetGroups\":[' || coalesce(groups, '') "
        f"|| ']}}' AS response FROM ({inputs.PHRASES}) q LEFT JOIN pages USING (query_id) LEFT JOIN nested USING (query_id)"),
    "suggest_json": _entry(
        (*A_INDEX, *_grams("df"), f"best AS ({_suggested('doc_freq, word')})"),
        "SELECT input_id, '[' || coalesce(string_agg('\"' || word || '\"', ',' ORDER BY rank), '') || ']' AS response "
        f"FROM ({inputs.INPUTS}) LEFT JOIN best USING (input_id) GROUP BY input_id"),
    # text analysis
    "tokenize_standard": _entry((ARTICLES,), _tokens("articles", "title", "doc_id")),
    "token_normalize": _entry((ARTICLES, f"w AS ({_words('articles', 'title', 'doc_id')})"),
                              f"SELECT DISTINCT raw AS word, {_strip('raw')} AS term FROM w"),
    "ascii_fold": _entry((ARTICLES, f"t AS ({_tokens('articles', 'title', 'doc_id')})"),
                         f"SELECT DISTINCT term, {_fold('term')} AS folded FROM t"),
    "stopwords_gaps": _entry((ARTICLES,), _text_tokens("articles", "title", "doc_id")),
    "stopwords_nogaps": _entry(
        (ARTICLES, f"t AS ({_tokens('articles', 'title', 'doc_id')})"),
        "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos, term FROM t "
        f"WHERE term NOT IN {_in(SUGGEST_STOP_WORDS)}"),
    "synonym_expand": _entry((PRODUCTS, SYN, P_BASE, P_OCC), "SELECT * FROM occ"),
    "edge_ngrams_front": _entry(A_INDEX, "SELECT term, term[1:n] AS gram FROM df, range(1, 21) r(n) WHERE n <= length(term)"),
    "edge_ngrams_back": _entry(A_INDEX, "SELECT term, right(term, n) AS gram FROM df, range(2, 6) r(n) WHERE n <= length(term)"),
    "edge_ngram_offsets": _entry(
        (PRODUCTS, f"t AS ({_tokens('products', 'title', 'doc_id')})",
         "s AS (SELECT *, coalesce(sum(length(term) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED "
         "PRECEDING AND 1 PRECEDING), 0) AS start FROM t)"),
        "SELECT doc_id, pos, right(term, n) AS gram, (start + length(term) - n)::INTEGER AS gram_start, "
        "(start + length(term))::INTEGER AS gram_end FROM s, range(1, 21) r(n) WHERE n <= length(term)"),
    "token_offsets": _entry(
        (ARTICLES, f"w AS (SELECT doc_id, unnest(l) AS raw, unnest(g[:len(l)]) AS gap, generate_subscripts(l, 1) - 1 AS pos FROM "
         f"(SELECT doc_id, regexp_extract_all(title, '{_WORD}') AS l, regexp_split_to_array(title, '{_WORD}') AS g "
         "FROM articles))",
         "e AS (SELECT *, sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM w)"),
        "SELECT doc_id, pos::INTEGER AS pos, (stop - length(raw))::INTEGER AS token_start, stop::INTEGER AS token_end FROM e "
        "WHERE length(raw) <= 255"),
    "dictionary_minlen": _entry(A_INDEX, "SELECT term FROM df WHERE length(term) >= 3"),
    "last_word": r"SELECT doc_id, regexp_extract(text, '\S*$') AS word FROM documents",
    "facet_slug": r"SELECT doc_id, regexp_replace(text, '[\s-]', '_', 'g') AS slug FROM documents",
    "complete_phrase": _entry((PRODUCTS,), "SELECT doc_id, concat_ws(' ', split_part(title, ' ', 1), split_part(title, ' ', 2), "
                              "\"Brand\") AS phrase FROM products"),
    "analyze_chain": _entry(
        (PRODUCTS, SYN, P_BASE, P_OCC, f"t AS ({_tokens('products', 'title', 'doc_id')})"),
        "SELECT 'standard' AS chain, doc_id, pos, term FROM base UNION ALL SELECT 'synonym', doc_id, pos, term FROM occ "
        f"UNION ALL SELECT 'suggest', doc_id, pos, {_fold('term')}[1:n] FROM t, range(1, 21) r(n) WHERE n <= length(term) "
        f"AND term NOT IN {_in(SUGGEST_STOP_WORDS)}"),
    # index tables
    "postings": _entry((PRODUCTS, SYN, P_BASE, P_OCC), "SELECT * FROM occ"),
    "postings_articles": _entry((ARTICLES, A_OCC, POST), "SELECT * FROM post"),
    "doc_lengths": _entry((PRODUCTS, SYN, P_BASE, P_OCC, LENGTHS), "SELECT * FROM len"),
    "term_dictionary": _entry(A_INDEX, "SELECT term FROM df"),
    "doc_freq": _entry(A_INDEX, "SELECT * FROM df"),
    "suggest_field": _entry(
        ("brands AS (SELECT p_brand AS term, count(*) AS doc_freq FROM part GROUP BY 1)", *_grams("brands")),
        "SELECT * FROM sug"),
    "suggestion_table": _entry((*A_INDEX, *_grams("df")), "SELECT * FROM sug"),
    "facet_vocabulary": _entry((PRODUCTS, FACETS, VOCAB), "SELECT * FROM vocab"),
    # search predicates and ranking
    "term_match": _entry((ARTICLES, A_OCC, POST), "SELECT doc_id, tf FROM post WHERE term = 'thanen'"),
    "search_all_terms": _entry(P_NAMES, "SELECT * FROM hits"),
    "search_any_term": _entry(P_NAMES, "SELECT DISTINCT query_id, doc_id FROM m"),
    "search_not": _entry(
        (*P_INDEX, f"b AS ({_BOOL})", "g AS (SELECT query_id, doc_id, count(*) FILTER (occur = 'must') AS a, "
         "count(*) FILTER (occur = 'should') AS o, count(*) FILTER (occur = 'must_not') AS x FROM b JOIN post USING (term) "
         "GROUP BY ALL)"),
        "SELECT query_id, doc_id FROM g WHERE x = 0 AND a + o > 0 AND "
        "a = (SELECT count(*) FROM b WHERE b.query_id = g.query_id AND occur = 'must')"),
    "search_nested": _entry(P_INDEX, " UNION ALL ".join(
        f"SELECT {query_id}::BIGINT AS query_id, doc_id FROM products WHERE {_nested(rows)}" for query_id, rows in _by_query())),
    "search_phrase": _entry((*A_INDEX, *_query_terms(inputs.PASSAGES, whole=True), MATCH, HITS), "SELECT * FROM hits"),
    "search_phrase_slop": _entry(
        (*P_INDEX, *_query_terms(inputs.SWAPPED_NAMES, whole=True)),
        "SELECT DISTINCT a.query_id, x.doc_id FROM q a JOIN q b ON a.query_id = b.query_id AND a.pos = 0 AND b.pos = 1 "
        "JOIN occ x ON x.term = a.term JOIN occ y ON y.term = b.term AND y.doc_id = x.doc_id "
        "WHERE abs((y.pos - 1) - x.pos) <= 2"),
    "search_prefix": _entry(A_INDEX, _pattern_hits(inputs.PREFIXES, "starts_with(term, lower(prefix))")),
    "search_wildcard": _entry(A_INDEX, _pattern_hits(inputs.PATTERNS, f"term LIKE {_LIKE}")),
    "search_fuzzy": _entry(A_INDEX, _pattern_hits(inputs.FUZZY, _SHORT_EDIT)),
    "search_range": _entry(A_INDEX, _pattern_hits(inputs.RANGES, _RANGE)),
    "search_range_open": _entry(A_INDEX, _pattern_hits(inputs.OPEN_RANGES, _OPEN_RANGE)),
    "search_patterns_built": _entry(A_INDEX, " UNION ALL ".join(
        f"SELECT query_id + {1000 * i} AS query_id, doc_id FROM ({hits})" for i, hits in enumerate((
            _pattern_hits(inputs.FUZZY, _SHORT_EDIT), _pattern_hits(inputs.PATTERNS, f"term LIKE {_LIKE}"),
            _pattern_hits(inputs.OPEN_RANGES, _OPEN_RANGE))))),
    "search_field_term": _entry(
        (PRODUCTS, FACETS, "ask AS (SELECT field, lower(value) AS value, min(doc_id) AS query_id FROM fv "
         "GROUP BY field, fv.value)"),
        "SELECT query_id, doc_id FROM fv JOIN ask USING (field, value)"),
    "search_match_all": "SELECT 1::BIGINT AS query_id, p_partkey AS doc_id FROM part",
    "search_empty": "SELECT 0::BIGINT AS query_id, 0::BIGINT AS doc_id WHERE false",
    "tfidf_score": _entry(
        (*A_INDEX, *_query_terms(inputs.PASSAGES), MATCH, LENGTHS, NORM, _weights("articles"), _scored(False)),
        "SELECT * FROM scored"),
    "tfidf_boost": _entry(
        (*P_INDEX, f"asked AS ({inputs.BOOSTED})", f"qtok AS ({_text_tokens('asked', 'text', 'query_id', 'clause', 'boost')})",
         "q AS (SELECT *, count(*) OVER (PARTITION BY query_id, clause) AS size, "
         "(SELECT count(DISTINCT clause) FROM qtok x WHERE x.query_id = qtok.query_id) AS n FROM qtok)",
         MATCH, LENGTHS, NORM, _weights("products", "any_value(boost)::DOUBLE"), _scored(False)),
        "SELECT * FROM scored"),
    "tfidf_top_any": _entry(
        (*A_INDEX, *_query_terms(inputs.PASSAGES), MATCH, LENGTHS, NORM, _weights("articles"), _scored(False), RANKED),
        "SELECT * FROM ranked WHERE rank <= 50"),
    "tfidf_bool": _entry(
        (*P_INDEX, f"b AS ({_BOOL})",
         "g AS (SELECT query_id, doc_id, count(*) FILTER (occur = 'must') AS a, count(*) FILTER (occur = 'should') AS o, "
         "count(*) FILTER (occur = 'must_not') AS x FROM b JOIN post USING (term) GROUP BY ALL)",
         "hits AS (SELECT query_id, doc_id FROM g WHERE x = 0 AND a + o > 0 AND "
         "a = (SELECT count(*) FROM b WHERE b.query_id = g.query_id AND occur = 'must'))",
         "q AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n, pow(1 + ln((SELECT count(*) FROM products) / "
         "(coalesce(doc_freq, 0) + 1.0)), 2) AS weight FROM b LEFT JOIN df USING (term) WHERE occur <> 'must_not')", LENGTHS, NORM),
        "SELECT query_id, doc_id, round(raw * norm * coord * 1e6)::BIGINT AS score FROM (SELECT query_id, doc_id, sum(sqrt(tf) * weight) "
        "AS raw, count(*) / any_value(n) AS coord FROM q JOIN post USING (term) GROUP BY query_id, doc_id) "
        "JOIN hits USING (query_id, doc_id) JOIN norm USING (doc_id)"),
    "top_hits": _entry(P_SCORED, "SELECT * FROM ranked WHERE rank BETWEEN 6 AND 55"),
    "hit_titles": _entry(P_SCORED, "SELECT query_id, rank, title FROM ranked JOIN products USING (doc_id) WHERE rank <= 50"),
    "hit_count": _entry(P_NAMES, "SELECT query_id, count(*) AS hit_count FROM hits GROUP BY query_id"),
    # facets
    "facet_filter_or": _entry((PRODUCTS, FACETS), "SELECT query_id, doc_id FROM fv JOIN "
                              f"({inputs.SELECTIONS_OR}) USING (field, value)"),
    "facet_filter_and": _entry(
        (PRODUCTS, FACETS, SELECTED),
        "SELECT query_id, doc_id FROM fv JOIN sel USING (field, value) GROUP BY query_id, doc_id HAVING count(*) = "
        "(SELECT count(DISTINCT field) FROM sel s WHERE s.query_id = sel.query_id)"),
    "search_refine": _entry(P_REFINED, "SELECT * FROM refined"),
    "facet_counts_browse": _entry(P_FACETS, "SELECT * FROM counts"),
    "facet_counts_kept": _entry(P_FACETS, "SELECT * FROM counts"),
    "term_facets": _entry((*P_INDEX, FACETS), "SELECT term, field, value, count(*) AS hit_count FROM post JOIN df USING (term) "
                          "JOIN fv USING (doc_id) WHERE doc_freq >= 20 GROUP BY ALL"),
    "facet_min_hits": _entry(P_FACETS, "SELECT * FROM counts WHERE hit_count >= 10"),
    "facet_counts_refine": _entry(P_REFINED, "SELECT * FROM filled"),
    "facet_order_value": _entry(P_FACETS, "SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY value) AS rank "
                                "FROM counts"),
    "facet_order_hits": _entry(P_FACETS, "SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY hit_count DESC, "
                               "value) AS rank FROM counts"),
    "facet_order_terms": _entry(
        (ARTICLES, A_OCC, POST, DF),
        "SELECT 1::BIGINT AS query_id, 'title' AS field, term AS value, doc_freq AS hit_count, "
        "row_number() OVER (ORDER BY doc_freq DESC, term) AS rank FROM df"),
    "facet_groups_flat": _entry((*P_FACETS, SEARCHED_GROUPS), "SELECT query_id, field, value, coalesce(hit_count, 0) AS hit_count FROM searched "
                                "LEFT JOIN counts USING (query_id, field)"),
    "facet_prefix": _entry(P_FACETS, "SELECT * FROM counts WHERE starts_with(value, 'Brand#1')"),
    "facet_multi_value": _entry(P_SEARCH, "SELECT query_id, 'title' AS field, term AS value, count(*) AS hit_count "
                                "FROM hits JOIN post USING (doc_id) GROUP BY ALL"),
    "facet_suggest": _entry(
        (ARTICLES, A_OCC, POST),
        "SELECT 1::BIGINT AS query_id, 'title' AS field, term AS value, count(*) AS hit_count, "
        "row_number() OVER (ORDER BY count(*) DESC, term)::INTEGER AS rank FROM post WHERE starts_with(term, 'th') "
        "GROUP BY term QUALIFY rank <= 8"),
    "selection_groups": _entry((PRODUCTS, FACETS), "SELECT 1::BIGINT AS query_id, field, value FROM fv GROUP BY field, value "
                               "HAVING count(*) % 2 = 0"),
    "facet_state": _entry(P_REFINED, STATE),
    "facet_combinations": _entry(
        P_SEARCH,
        'SELECT query_id, "Material", "Style", count(*) OVER w AS hit_count, '
        "row_number() OVER (w ORDER BY doc_id)::INTEGER AS rank, doc_id FROM hits JOIN products USING (doc_id) "
        'WINDOW w AS (PARTITION BY query_id, "Material", "Style") QUALIFY rank <= 50'),
    # suggestions
    "suggest_topk": _entry((*A_INDEX, *_grams("df")), _suggested("doc_freq, word")),
    "suggest_more": _entry((*A_INDEX, *_grams("df")), _suggested("doc_freq, word", 30)),
    "suggest_popular": _entry((*A_INDEX, *_grams("df")), _suggested("doc_freq DESC, word")),
    "suggest_gate": "SELECT (conv_id * 1000 + turn) * 10 + nth AS input_id FROM (SELECT *, unnest([0, 1, 2, 3, length(text)]) AS n, "
                    "unnest(range(5)) AS nth FROM conversations) WHERE length(left(text, n)) >= 2",
    "suggest_gate_long": "SELECT conv_id * 1000 + turn AS input_id FROM conversations WHERE length(text) >= 80",
    # jobs
    "browse_hits": _entry(N_SCORED, "SELECT query_id, rank, doc_id, score, title FROM ranked JOIN products USING (doc_id) "
                          "WHERE rank <= 50"),
    "browse_facets": _entry((*P_NAMES, FACETS, BROWSED), "SELECT * FROM counts"),
    "refine_hits": _entry(
        (*P_SCORED, FACETS, SELECTED, REFINED),
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, "
        "score, title FROM refined JOIN scored USING (query_id, doc_id) JOIN products USING (doc_id) QUALIFY rank <= 50"),
    "refine_facets": _entry(P_REFINED, STATE),
    "browse_built": _entry(N_SCORED, "SELECT query_id, rank, doc_id, score, title FROM ranked JOIN products USING (doc_id) "
                           "WHERE rank <= 50"),
    "refine_built": _entry(P_REFINED, STATE),
    "browse_log": _entry(
        (*P_NAMES, FACETS, BROWSED, "line AS (SELECT p_partkey AS line_id, min(p_partkey) OVER (PARTITION BY p_name) AS query_id "
         "FROM part)"),
        "SELECT line_id AS query_id, field, value, hit_count FROM line JOIN counts USING (query_id)"),
}
