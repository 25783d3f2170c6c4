"""Scalar columns: missing-value rules, safe parsing, money, serial dates, counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words that may stand for a count.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
# Texts read as a true flag.
TRUE_FLAGS = ("Y", "YES", "TRUE", "1")
# A count must stay under this bound.
MAX_COUNT = 5_000_000
# Day number range of a believable spreadsheet date, and day zero.
SERIAL_RANGE = (20000, 80000)
SERIAL_DAY_ZERO = "1899-12-30"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: dict, key: Column) -> Column:
    """Value for a key from a small fixed mapping, null when absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def text_or_null(c: Column | str) -> Column:
    trimmed = F.trim(col(c))
    return F.nullif(trimmed, F.lit(""))


def number_or_null(c: Column | str) -> Column:
    """Zero counts as missing."""
    return F.nullif(col(c), F.lit(0))


def first_number(*cols: Column | str) -> Column:
    """First value that is neither null nor zero, else zero."""
    return F.coalesce(*[number_or_null(c) for c in cols], F.lit(0))


def first_text(*cols: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def half_even(c: Column | str) -> Column:
    return F.bround(col(c)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half-even; zero when the whole is missing or zero."""
    return F.when(whole > 0, half_even(F.lit(100) * part / whole)).otherwise(F.lit(0)).cast("long")


def to_float(c: Column | str) -> Column:
    return text_or_null(c).try_cast("double")


def to_int(c: Column | str) -> Column:
    return half_even(to_float(c))


def to_flag(c: Column | str) -> Column:
    return F.coalesce(F.upper(F.trim(col(c))).isin(*TRUE_FLAGS), F.lit(False))


def place_name(c: Column | str) -> Column:
    """Title case only for a name written wholly in capitals.

    A letter after any non-letter starts a word, so a marker space is put there
    for `initcap` and taken out again.
    """
    text = F.coalesce(F.trim(col(c)), F.lit(""))
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    marked = F.regexp_replace(F.lower(text), r"([^\p{L}])(?=\p{L})", "$1\u0001 ")
    titled = F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))
    return F.when(capitals, titled).otherwise(text)


def money(c: Column | str) -> Column:
    """Whole units from a money text; unreadable text is null."""
    bare = F.regexp_replace(F.trim(col(c)), "[$,]", "")
    return half_even(F.nullif(bare, F.lit("")).try_cast("double"))


def serial_date(c: Column | str) -> Column:
    serial = text_or_null(c).try_cast("double")
    low, high = SERIAL_RANGE
    day = F.date_add(F.lit(SERIAL_DAY_ZERO).cast("date"), F.floor(serial).cast("int"))
    return F.when((serial >= low) & (serial <= high), day)


def fiscal_year(*texts: Column | str) -> Column:
    """Year from the first text that names a fiscal year."""
    found = [
        F.nullif(F.regexp_extract(col(t), r"(?i)(?:FY[_\s-]?|/)(20\d{2})", 1), F.lit(""))
        for t in texts
    ]
    return F.coalesce(*found).cast("int")


def edition_range(url: Column | str) -> Column:
    """`2025-2029` style edition named inside a file URL."""
    return F.nullif(F.regexp_extract(col(url), r"(20\d{2}-20\d{2})", 1), F.lit(""))


def count_from_text(c: Column | str) -> Column:
    """Count from digits with separators, or from a number word."""
    bare = F.trim(F.regexp_replace(col(c), ",", ""))
    digits = F.when(bare.rlike(r"^\d{1,12}$"), bare.try_cast("long"))
    bounded = F.when((digits > 0) & (digits < MAX_COUNT), digits)
    return F.coalesce(bounded, lookup(NUMBER_WORDS, F.lower(bare)).cast("long"))


def thousands(c: Column | str) -> Column:
    return F.format_number(col(c).cast("long"), 0)


def joined(sep: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def yes(c: Column) -> Column:
    """A predicate with null read as false."""
    return F.coalesce(c, F.lit(False))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}]", "-")


# Other letters that case-blind patterns take for s, k and i.
ODD_CASES = ("\u017f", "\u212a", "\u0130", "\u0131")


def has_odd_case(text: Column | str) -> Column:
    return any_of(*[F.contains(col(text), F.lit(c)) for c in ODD_CASES])


def from_first(text: Column, low: Column, odd: Column, starts: Sequence[str]) -> Column:
    """A text from where one of some words first stands, with what is just before; empty if none does.

    For case-blind patterns whose matches begin with one of the words (lower case, ASCII)
    or one character before: they match the same in what is left. `low` is the text in
    lower case, `odd` whether it holds letters that lower case does not show; such a text
    stays whole. What is kept before the word (32 characters) is what a word boundary
    looks at: a letter with its marks.
    """
    first = F.array_min(F.filter(F.array(*[F.locate(w, low) for w in starts]), lambda x: x > 0))
    rest = F.substring(text, F.greatest(first - 32, F.lit(1)), F.length(text))
    held = any_of(*[F.contains(low, F.lit(w)) for w in starts])
    return F.when(odd, text).when(held, rest).otherwise("")


def found(text: Column, low: Column, odd: Column, pattern: str, parts: Sequence[tuple[str, str | None]] | None) -> Column:
    """`text.rlike(pattern)`; of a case-blind pattern whose alternatives are known, only those a text can hold are tried.

    `parts` are pairs (word, alternative): the word each match of the alternative begins
    with, or has one character before; no alternative, if the word alone is one.
    """
    if not parts:
        return text.rlike(pattern)
    tried = [F.contains(low, F.lit(word)) if part is None else
             F.contains(low, F.lit(word)) & from_first(text, low, F.lit(False), [word]).rlike(part) for word, part in parts]
    return F.when(odd, text.rlike(pattern)).otherwise(any_of(*tried))
