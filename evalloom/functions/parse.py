"""Answers in free text: numbers, triplets and choice letters. All are column expressions; whole texts are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of what counts as a number and as an answer.
NUMBER = r"[-+]?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?"
LITERAL = r"^(?i)(?:answer\s*[:=]\s*)?([-+]?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?)\.?$"
DOUBLE_DICT = r"(?is)\{\{\s*['\"]answer['\"]\s*:\s*([^{}]+?)\s*\}\}"
SINGLE_DICT = r"(?is)\{\s*['\"]answer['\"]\s*:\s*([^{}]+?)\s*\}"
FIRST_ANSWER = r"(?i)answer\s*['\"]?\s*[:=]\s*['\"]?([-+]?[0-9]+(?:\.[0-9]+)?)"
LENGTH = r"(?i)^\s*~?\s*([-+]?[0-9]+(?:[.,][0-9]+)?)\s*(mm|cm|m|met(?:re|er)s?)?\s*$"
NUMERIC_TEXT = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"


def to_float(text: Column, finite: bool = False) -> Column:
    """Text as a double if the whole of it is a plain decimal number, else null: '1_000', '1.5f' and '2d' are none. NaN and infinities
    by name count unless ``finite``."""
    value = F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))
    named = F.when(F.lower(F.trim(text)) == "nan", F.lit(float("nan"))).when(F.lower(F.trim(text)).rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(F.lower(F.trim(text)).rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    return value if finite else F.coalesce(value, named)


def length_metres(text: Column) -> Column:
    """A length as a double in metres: a plain number, or '120 cm', '1200mm', '1.2 m', '~1.2 metres', '1,2'; else null. Metres where no unit stands."""
    value = F.regexp_replace(_blank(F.regexp_extract(text, LENGTH, 1)), ",", ".").try_cast("double")
    unit = F.lower(F.regexp_extract(text, LENGTH, 2))
    return F.coalesce(to_float(text), F.when(unit == "mm", value / 1000).when(unit == "cm", value / 100).otherwise(value))


def finite_or_null(x: Column) -> Column:
    """The double, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _last(matches: Column) -> Column:
    return F.try_element_at(matches, F.lit(-1))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def last_line(text: Column) -> Column:
    """The last line that is not blank, trimmed; null if there is none. Found from the end, without splitting the text."""
    tail = F.substring_index(F.substring_index(F.rtrim(text, F.lit(" \n\r\t")), "\n", -1), "\r", -1)
    return _blank(F.trim(tail))


def _braced(text: Column, value: Column) -> Column:
    """The value, looked for only in texts with a brace, which spares most of them a regular expression over the whole text."""
    return F.when(F.contains(text, F.lit("{")), value)


def _blank(text: str | Column) -> Column:
    return F.nullif(text, F.lit(""))


def number_literal(text: Column) -> Column:
    """A line that is just a number, 'answer: number', a boolean (1 or 0) or a one-entry answer dict; else null."""
    t = F.trim(text)
    plain = _blank(F.regexp_extract(t, LITERAL, 1)).try_cast("double")
    point = F.when(t.rlike(r"^[-+]?\.[0-9]+$"), t.try_cast("double"))
    logical = F.when(t == "True", 1.0).when(t == "False", 0.0)
    inner = _blank(F.regexp_extract(t, r"(?is)^\{\s*['\"]answer['\"]\s*:\s*['\"]?([^{},'\"]+?)['\"]?\s*\}$", 1))
    return F.coalesce(plain, point, logical, F.when(inner.rlike(NUMERIC_TEXT), inner.try_cast("double")))


def numeric_answer(text: Column) -> Column:
    """The number that a response gives: its last line if that is a literal, else the last {{'answer': x}}, else the last
    {'answer': x}, else the last number anywhere. Null for null, empty or numberless text."""
    return F.coalesce(
        number_literal(last_line(text)), _braced(text, F.coalesce(number_literal(_last(_all(text, DOUBLE_DICT, 1))), number_literal(_last(_all(text, SINGLE_DICT, 1))))), _last(_all(text, NUMBER)).try_cast("double")
    )


def first_numeric_answer(text: Column) -> Column:
    """The first 'answer: x', else the last number, to one decimal; null if there is none."""
    found = F.coalesce(_blank(F.regexp_extract(text, FIRST_ANSWER, 1)), _last(_all(text, r"[-+]?[0-9]+(?:\.[0-9]+)?")))
    return F.round(found.try_cast("double"), 1)


def _three(text: Column) -> Column:
    """Text '[a, b, c]' or '(a, b, c)' as three doubles, else null."""
    inner = F.regexp_extract(text, r"^\s*[\[(]\s*([^\[\]()]*?)\s*,?\s*[\])]\s*$", 1)
    parts = F.transform(F.split(inner, r"\s*,\s*"), lambda x: to_float(x, finite=True))
    return F.when((F.size(parts) == 3) & ~F.exists(parts, lambda x: x.isNull()), parts)


def triplet_answer(text: Column) -> Column:
    """Three numbers: the last line, else the last answer dict that holds a triplet, else the last bracketed triplet, else the last three numbers."""

    def last_of(found: Column) -> Column:
        return _last(F.filter(F.transform(found, lambda x: _three(x)), lambda x: x.isNotNull()))

    numbers = F.transform(_all(text, NUMBER), lambda x: x.try_cast("double"))
    tail = F.when(F.size(numbers) >= 3, F.slice(numbers, -3, 3))
    dicts = _braced(text, F.coalesce(last_of(_all(text, DOUBLE_DICT, 1)), last_of(_all(text, SINGLE_DICT, 1))))
    return F.coalesce(_three(last_line(text)), dicts, last_of(_all(text, r"\[[^\[\]]+\]")), tail)


def _letter(text: Column) -> Column:
    named = _blank(F.regexp_extract(text, r"(?i)answer\s*[:=]\s*['\"]?([AB])['\"]?", 1))
    return F.upper(F.coalesce(F.when(F.trim(text).rlike("^[ABab]$"), F.trim(text)), named, _last(_all(text, r"(?i)\b([AB])\b", 1))))


def choice_answer(text: Column) -> Column:
    """'A' or 'B': a lone letter, the first 'answer: A', else the last letter standing alone, in upper case. The article 'a' counts as A.
    Where the whole text has none, the inside of the last answer dict is tried. Null if there is none."""
    return F.coalesce(_letter(text), _letter(last_line(text)), _letter(_last(_all(text, SINGLE_DICT, 1))))
