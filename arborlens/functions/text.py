"""Small text helpers shared by the column builders."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.fixed_values import WHITESPACE

# Inside a Java character class: every blank, and every blank but the line feed.
BLANK = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE_BLANK = BLANK.replace(r"\x09-\x0d", r"\x09\x0b-\x0d")


def strip(text: Column) -> Column:
    """Drop blanks at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    """Drop blanks at the end."""
    return F.rtrim(text, F.lit(WHITESPACE))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of ``key`` in a small constant table, null when absent."""
    pairs = ", ".join(f"'{word}', '{value}'" for word, value in table.items())
    return F.element_at(F.expr(f"map({pairs})"), key)


def fill(template: str, **values: Column) -> Column:
    """Put columns in the ``{name}`` places of a template."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
