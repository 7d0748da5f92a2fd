"""Word tokenisation as Column expressions.

A word is the longest match at its start among: e-mail address, apostrophe word,
company name (at&t), number-like word, dotted name or acronym, plain alphanumeric
run, single Chinese or Japanese character. A backtracking regex takes the *first*
alternative, so the alternatives are ordered and shaped such that the first that
matches is also the longest:

* an e-mail address swallows everything another rule could start with;
* apostrophe and company words compete with nothing that has the same first joiner;
* a number-like word beats a dotted name only where it passes a joiner other than a
  dot, so only number-like words with such a joiner are listed before dotted names.

Quantifiers are possessive: the matcher never backtracks, which keeps it linear per
word and free of deep recursion on very long runs.

Functions named `*_sql` take and return SQL expression text, so that they nest freely in
lambdas; the others wrap them as Columns over a column name or expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismdex.config import MAX_TOKEN_CHARS

# Character classes of the word grammar. The leading ASCII range only
# spares the matcher the wider tests on most characters.
_CJ = (
    r"\u3040-\u30ff\u3100-\u312f\u31f0-\u31ff\u3300-\u337f\u3400-\u4dbf\u4e00-\u9fff"
    r"\uf900-\ufaff\uff65-\uff9f"
)
_THAI = r"\u0e00-\u0e59"
_LETTER = rf"[a-zA-Z[\p{{L}}&&[^{_CJ}]]]"
_ALNUM = rf"[a-zA-Z0-9[\p{{L}}\p{{Nd}}{_THAI}&&[^{_CJ}]]]"
_LETTER_OR_DIGIT = rf"[a-zA-Z0-9[\p{{L}}\p{{Nd}}&&[^{_CJ}]]]"
_JOINER = r"[_\-/.,]"
_JOINER_NOT_DOT = r"[_\-/,]"


def word_pattern(letter: str, alnum: str, letter_or_digit: str, possessive: bool = True, emails: bool = True) -> str:
    """The word grammar over the given character classes.

    A number-like word is a chain of segments in which every other one has a digit.
    Walking such a chain, three states say what the next segment may be: `run` (all
    segments so far have a digit: anything), `any` (anything) and `digit` (must have
    a digit). `*_tail` walks on over every joiner; `*_mixed` walks over dots until it
    has passed one other joiner.
    """
    p = "+" if possessive else ""
    seg, num = f"{alnum}+{p}", rf"{letter}*{p}\p{{Nd}}{letter_or_digit}*{p}"
    j, q, dot = _JOINER, _JOINER_NOT_DOT, r"\."

    digit_tail = f"(?:{j}{num}{j}{seg})*{p}(?:{j}{num})?{p}"
    any_tail = f"(?:{j}{seg}{digit_tail})?{p}"
    run_tail = f"(?:{j}{num})*{p}{any_tail}"
    digit_mixed = f"(?:{dot}{num}{dot}{seg})*{p}(?:{q}{num}{any_tail}|{dot}{num}{q}{seg}{digit_tail})"
    run_mixed = f"(?:{dot}{num})*{p}(?:{q}{num}{run_tail}|{q}{seg}{digit_tail}|{dot}{seg}{digit_mixed})"

    email = rf"{seg}(?:[._\-]{seg})*{p}@{seg}(?:[.\-]{seg})+{p}"
    apostrophe = rf"{letter}+{p}(?:\x27{letter}+{p})+{p}"
    company = f"{letter}+{p}[&@]{letter}+{p}"
    number = f"{num}{run_mixed}|{seg}{digit_mixed}"
    dotted = rf"{seg}(?:\.{seg})+{p}\.?{p}"
    return "|".join([*([email] if emails else []), apostrophe, company, number, dotted, seg])


# A run with no joiner and further run behind it is a word already: the common case first.
_LONE_WORD = rf"{_ALNUM}++(?![._\-/,\x27&@]{_ALNUM})"


def _pattern(emails: bool) -> str:
    # The look-ahead spares every rule a try at each blank and punctuation mark.
    rules = f"(?={_ALNUM})(?:{word_pattern(_LETTER, _ALNUM, _LETTER_OR_DIGIT, emails=emails)})"
    return "|".join([_LONE_WORD, rules, f"[{_CJ}]"])


# A long chain like a_b_c_d is looked through for an @ from each of its words, so the
# e-mail rule is tried only on texts that hold one.
WORD_PATTERN, WORD_PATTERN_WITHOUT_EMAILS = _pattern(True), _pattern(False)
_ACRONYM = rf"^{_LETTER}(?:\.{_LETTER})+\.$"


def raw_words_sql(text: str) -> str:
    """array<string>: the words of `text` as written, in order."""
    return (f"if(contains({text}, '@'), regexp_extract_all({text}, r'{WORD_PATTERN}', 0), "
            f"regexp_extract_all({text}, r'{WORD_PATTERN_WITHOUT_EMAILS}', 0))")


def strip_word_sql(word: str) -> str:
    """Drop a trailing 's, the dots of an acronym and the last dot of a dotted name."""
    return (
        f"CASE WHEN right({word}, 2) IN ('\\'s', '\\'S') THEN left({word}, length({word}) - 2) "
        f"WHEN endswith({word}, '.') AND {word} RLIKE r'{_ACRONYM}' THEN replace({word}, '.', '') "
        f"WHEN endswith({word}, '.') THEN left({word}, length({word}) - 1) ELSE {word} END"
    )


def normalize_word_sql(word: str) -> str:
    """strip_word, then lower case."""
    return f"lower({strip_word_sql(word)})"


def word_fits_sql(word: str) -> str:
    """Words over the length limit are dropped; they still take up a position."""
    return f"length({word}) <= {MAX_TOKEN_CHARS}"


def tokenize_sql(text: str) -> str:
    """array<struct<pos:int, term:string>> of one value."""
    numbered = f"transform({raw_words_sql(text)}, (w, i) -> named_struct('pos', i, 'word', w))"
    return (
        f"transform(filter({numbered}, t -> {word_fits_sql('t.word')}), "
        f"t -> named_struct('pos', t.pos, 'term', {normalize_word_sql('t.word')}))"
    )


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is worked out once and not at every use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running_sums(lengths: str, block: int = 32) -> str:
    """For array<int>: the sum of all elements before each one.

    Summed on within blocks; the blocks' own sums are summed on in the same way, in blocks again, and added to
    their elements. A sum is worked out from the one before it, so the work is linear in the length of the array.
    """

    def summed(part: str) -> str:
        """The sums before each element of a part, and the sum of all."""
        return f"aggregate({part}, array(0), (a, b) -> array_append(a, a[size(a) - 1] + b))"

    def in_blocks(values: str, name: str) -> str:
        n = f"int(ceil(size({name}) / {block}))"
        return _let(name, values, f"transform(slice(sequence(0, {n}), 1, {n}), k -> {summed(f'slice({name}, k * {block} + 1, {block})')})")

    def before(blocks: str, starts: str) -> str:
        return f"flatten(transform({blocks}, (b, k) -> transform(slice(b, 1, size(b) - 1), x -> x + {starts}[k])))"

    def totals(blocks: str) -> str:
        return f"transform({blocks}, b -> b[size(b) - 1])"

    upper = _let("ups", in_blocks(totals("parts_"), "ts"), _let("firsts", summed(totals("ups")), before("ups", "firsts")))
    return _let("parts_", in_blocks(lengths, "ls"), _let("starts", upper, before("parts_", "starts")))


def located_words_sql(text: str) -> str:
    """array<struct<word, start>>: the words of `text` as written, and the characters before each.

    The text is split at its words; a word starts behind all gaps and words before it.
    """
    # One gap more than words: the last one has no word and is dropped.
    gaps = (f"if(contains({text}, '@'), split({text}, r'{WORD_PATTERN}', -1), "
            f"split({text}, r'{WORD_PATTERN_WITHOUT_EMAILS}', -1))")
    before = _running_sums("zip_with(gaps, words, (g, w) -> length(g) + length(w))")
    starts = f"zip_with(slice(gaps, 1, size(words)), slice({before}, 1, size(words)), (g, b) -> length(g) + b)"
    located = f"zip_with(words, {starts}, (w, s) -> named_struct('word', w, 'start', s))"
    return _let("words", raw_words_sql(text), _let("gaps", gaps, located))


def tokenize_with_offsets_sql(text: str) -> str:
    """array<struct<pos, term, start, end>>; offsets are characters of `text`."""
    numbered = f"transform({located_words_sql(text)}, (l, i) -> named_struct('pos', i, 'word', l.word, 'start', l.start))"
    return (
        f"transform(filter({numbered}, t -> {word_fits_sql('t.word')}), t -> named_struct('pos', t.pos, "
        f"'term', {normalize_word_sql('t.word')}, 'start', t.start, 'end', t.start + length(t.word)))"
    )


def raw_words(text: str) -> Column:
    return F.expr(raw_words_sql(text))


def strip_word(word: str) -> Column:
    return F.expr(strip_word_sql(word))


def tokenize(text: str) -> Column:
    return F.expr(tokenize_sql(text))


def tokenize_with_offsets(text: str) -> Column:
    return F.expr(tokenize_with_offsets_sql(text))
