"""ASCII folding: accented and special Latin letters to plain ASCII."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges whose characters are folded by their Unicode decomposition.
_DECOMPOSED_RANGES = ((0x00C0, 0x024F), (0x1E00, 0x1EFF), (0x2070, 0x209C), (0x2460, 0x24E9),
                      (0xFB00, 0xFB06), (0xFF01, 0xFF5E))

# Letters and signs without a decomposition.
_SPECIAL = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "n", "Ŋ": "N", "ŧ": "t", "Ŧ": "T", "ĸ": "q", "ſ": "s",
    "ƀ": "b", "Ɓ": "B", "ƈ": "c", "Ƈ": "C", "ƒ": "f", "Ƒ": "F", "ƙ": "k", "Ƙ": "K",
    "ƥ": "p", "Ƥ": "P", "ƶ": "z", "Ƶ": "Z", "«": '"', "»": '"',
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
}


@lru_cache(maxsize=1)
def fold_table() -> dict[str, str]:
    table = dict(_SPECIAL)
    for first, last in _DECOMPOSED_RANGES:
        for code in range(first, last + 1):
            char = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if char not in table and base and base != char and base.isascii():
                table[char] = base
    return table


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ascii_fold_sql(text: str) -> str:
    """One-to-one characters by `translate`, the others by `replace`; ASCII text is left alone."""
    table = fold_table()
    single = {c: b for c, b in table.items() if len(b) == 1}
    longer = {c: b for c, b in table.items() if len(b) > 1}
    folded = f"translate({text}, {_literal(''.join(single))}, {_literal(''.join(single.values()))})"
    expanded = folded
    for char, base in longer.items():
        expanded = f"replace({expanded}, '{char}', '{base}')"
    return (
        rf"CASE WHEN NOT {text} RLIKE r'[^\x00-\x7F]' THEN {text} "
        f"WHEN {text} RLIKE '[{''.join(longer)}]' THEN {expanded} ELSE {folded} END"
    )


def ascii_fold(text: str) -> Column:
    return F.expr(ascii_fold_sql(text))
