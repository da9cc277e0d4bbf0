"""Column helpers over strings and arrays of lines. Everything stays a Spark expression."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.functions.patterns import java


def strip(c: Column) -> Column:
    """Unicode strip; Spark's ``trim`` leaves tabs and line breaks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Whitespace-collapsed, case-folded comparison key."""
    return collapse(F.lower(c))


def blank_to_null(c: Column) -> Column:
    stripped = strip(c)
    return F.when(F.length(stripped) > 0, stripped)


def has(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def group(c: Column, pattern: str, index: int = 1) -> Column:
    """First match of ``pattern``; NULL where nothing matches."""
    return F.nullif(F.regexp_extract(c, java(pattern), index), F.lit(""))


def all_groups(c: Column, pattern: str, index: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern)), F.lit(index))


def to_line_array(text: Column) -> Column:
    """Split on line breaks, strip, drop blanks: the in-row form of a document's lines."""
    return F.filter(F.transform(F.split(text, r"\R"), strip), lambda s: F.length(s) > 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once. A lambda that captures an expression would evaluate it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def index_of(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Zero-based index of the first element that passes; NULL when none does."""
    position = F.array_position(F.transform(lines, lambda s: F.coalesce(test(s), F.lit(False))), True)
    return let(position, lambda p: F.when(p > 0, (p - 1).cast("int")))


def _stands_in_text(pattern: str) -> bool:
    """Whether a match of ``pattern`` in a line is also one in the lines joined by line breaks: no anchor, look-around
    or possessive part, which could depend on what is beside the line. A word border is the same beside a break."""
    return not re.search(r"\^|\$|\\[AGZz]|\(\?[=!<>]|[*+?}]\+", pattern.replace("[^", "["))


def index_matching(lines: Column, pattern: str) -> Column:
    """``index_of`` for a pattern; the joined lines are searched first, once, as most patterns fit no line of a document."""
    found = index_of(lines, lambda s: has(s, pattern))
    return F.when(has(F.array_join(lines, "\n"), pattern), found) if _stands_in_text(pattern) else found


def index_containing(lines: Column, words: list[str]) -> Column:
    """Zero-based index of the first line that holds the first of the lower-case ``words`` that any line holds."""
    def search(text: Column) -> Column:
        return F.coalesce(*[F.when(text.contains(w), index_of(lines, lambda s, w=w: F.lower(s).contains(w))) for w in words])
    return let(F.lower(F.array_join(lines, "\n")), search)


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def window_after(lines: Column, index: Column, size: int) -> Column:
    """The ``size`` elements after a zero-based index."""
    return F.when(index.isNotNull(), F.slice(lines, index + 2, F.lit(size)))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def padded_tokens(c: Column) -> Column:
    """Token sequence as `` a b c `` so that containment of sequences is containment of strings."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def lookup(mapping: dict, key: Column) -> Column:
    pairs = [part for k, v in mapping.items() for part in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
