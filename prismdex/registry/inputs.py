"""Parameters of the registered queries: phrases, selections, patterns and typed words."""

from __future__ import annotations

import random


def _literal(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR(100))"
    if isinstance(value, bool):
        return str(value).lower()
    return f"'{value}'" if isinstance(value, str) else str(value)


def rows_sql(rows, *columns: str) -> str:
    """A SELECT of literal rows that Spark and DuckDB both read; the first column is BIGINT."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    first, *others = columns
    picked = ", ".join([f"CAST({first} AS BIGINT) AS {first}", *others])
    return f"SELECT {picked} FROM (VALUES {values}) AS t({', '.join(columns)})"


SYNONYMS = (("widget", "gizmo"), ("cold", "ice cold"))
SYNONYMS_SQL = ("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + ") AS t(term, synonym)")

PHRASES = rows_sql((
    (1, "cold widget"), (2, "small"), (3, "Hot STANDARD"), (4, "gizmo"), (5, "the of"), (6, "red plate economy"),
    (7, "ice cold"), (8, "large-gear"), (9, ""), (10, "medium widget of the new"),
), "query_id", "phrase")

# Every distinct part name, typed as a phrase; its id is the first part that has it.
NAME_PHRASES = "SELECT min(p_partkey) AS query_id, p_name AS phrase FROM part GROUP BY p_name"
SWAPPED_NAMES = (
    "SELECT min(p_partkey) AS query_id, concat_ws(' ', split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)) AS phrase "
    "FROM part GROUP BY p_name")
PASSAGES = "SELECT item_id AS query_id, text AS phrase FROM benchmark"

SELECTIONS = rows_sql((
    (1, "Material", "PROMO"), (1, "Material", "SMALL"), (1, "Style", "widget"), (2, "Mounting", "Compact"),
    (4, "Brand", "Brand#13"), (4, "Brand", "Brand#2"), (4, "Mounting", "Full"), (6, "Material", "STANDARD"),
), "query_id", "field", "value")
SELECTIONS_OR = rows_sql((
    (1, "Material", "PROMO"), (1, "Material", "SMALL"), (2, "Brand", "Brand#13"), (3, "Style", "Widget"),
), "query_id", "field", "value")

BOOL_QUERIES = rows_sql((
    (1, "cold", None, "widget"), (2, None, "anvil rod", "small"), (3, "widget", "hot", "promo"), (4, None, None, "red"),
), "query_id", "must", "should", "must_not")

BOOSTED = rows_sql(((1, 0, "cold", "should", 2.5), (1, 1, "widget", "should", 1.0), (1, 2, "small ring", "should", 0.5),
                    (2, 0, "promo", "should", 3.0), (2, 1, "gear", "should", 1.0)),
                   "query_id", "clause", "text", "occur", "boost")

PATTERNS = rows_sql(((1, "tha*"), (2, "Un*"), (3, "erst?h*"), (4, "é*on"), (5, "an?")), "query_id", "pattern")
PREFIXES = rows_sql(((1, "than"), (2, "Schw"), (3, "êt"), (4, "qu")), "query_id", "prefix")
FUZZY = rows_sql(((1, "thanen"), (2, "Avec"), (3, "undere"), (4, "on"), (5, "schenung")), "query_id", "word")
RANGES = rows_sql(((1, "tha", "the", True), (2, "than", "that", False), (3, "X", "z", True)),
                  "query_id", "low", "high", "inclusive")
OPEN_RANGES = rows_sql(((1, None, "an", True), (2, "the", None, False), (3, None, None, True)),
                       "query_id", "low", "high", "inclusive")
INPUTS = rows_sql((
    (1, "th"), (2, "An"), (3, "la qu"), (4, "schon"), (5, "th "), (6, "   "), (7, "e"), (8, "é"), (9, "the ou"), (10, "x"),
), "input_id", "text")


def expressions(count: int, depth: int, words: tuple[str, ...], seed: int = 4) -> list[tuple]:
    """(query_id, node, parent, op, text) of random expressions; the root's parent is 0."""
    rng, rows = random.Random(seed), []

    def grow(query_id: int, parent: int, left: int, at: list[int]) -> None:
        at[0] += 1
        node = at[0]
        if left == 0 or left < depth - 1 and rng.random() < 0.2:
            rows.append((query_id, node, parent, "term", rng.choice(words)))
            return
        op = rng.choice(("and", "or", "or", "not") if left < depth else ("and", "or", "not"))
        rows.append((query_id, node, parent, op, ""))
        for _ in range(1 if op == "not" else rng.randint(2, 3)):
            grow(query_id, node, left - 1, at)

    for query_id in range(2, count + 2):
        grow(query_id, 0, depth, [0])
    return rows


# (cold OR hot) AND (widget OR (gear AND NOT promo)), and fifty expressions of depth 4.
EXPRESSION_ROWS = [
    (1, 1, 0, "and", ""), (1, 2, 1, "or", ""), (1, 3, 2, "term", "cold"), (1, 4, 2, "term", "Hot"), (1, 5, 1, "or", ""),
    (1, 6, 5, "term", "widget"), (1, 7, 5, "and", ""), (1, 8, 7, "term", "gear"), (1, 9, 7, "not", ""), (1, 10, 9, "term", "PROMO"),
    *expressions(50, 4, ("cold", "hot", "widget", "gizmo", "gear", "promo", "small", "red", "plate", "anvil", "large", "economy", "standard")),
]
EXPRESSIONS = rows_sql(EXPRESSION_ROWS, "query_id", "node", "parent", "op", "text")
