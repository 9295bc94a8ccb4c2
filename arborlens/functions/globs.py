"""Shell-style patterns as Java regular expressions, built on the driver."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("\\.^$|?*+()[]{}")


def quote(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def bracket(body: str, negations: str) -> str | None:
    """A ``[...]`` class in Java syntax; null when it can match nothing."""
    negated = body[:1] in negations and body[:1] != ""
    if negated:
        body = body[1:]
    pieces, i = [], 0
    while i < len(body):
        low = body[i]
        if i + 2 < len(body) and body[i + 1] == "-":
            high = body[i + 2]
            if low <= high:
                pieces.append(_in_class(low) + "-" + _in_class(high))
            i += 3
        else:
            pieces.append(_in_class(low))
            i += 1
    if not pieces:
        return "." if negated else None
    return "[" + ("^" if negated else "") + "".join(pieces) + "]"


def _in_class(char: str) -> str:
    return "\\" + char if char in "\\[]^-&~|" else char


def close_bracket(pattern: str, start: int, negations: str) -> int:
    """Index of the ``]`` that ends the class opened before ``start``; -1 if none."""
    i = start
    if pattern[i:i + 1] and pattern[i] in negations:
        i += 1
    if pattern[i:i + 1] == "]":
        i += 1
    return pattern.find("]", i)


def glob_regex(pattern: str) -> str:
    """Regex of one glob; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        i += 1
        if char == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            end = close_bracket(pattern, i, "!")
            if end < 0:
                out.append("\\[")
            else:
                out.append(bracket(pattern[i:end], "!") or "(?!)")
                i = end + 1
        else:
            out.append(quote(char))
    return "".join(out)


def normal_pattern(pattern: str) -> str:
    return pattern.replace("\\", "/").lower().strip()


def any_glob(path: Column, name: Column, patterns) -> Column:
    """True if a pattern matches the whole path or the whole name."""
    globs = [glob_regex(normal_pattern(p)) for p in patterns or ()]
    if not globs:
        return F.lit(False)
    regex = r"(?s)\A(?:" + "|".join(globs) + r")\z"
    return path.rlike(regex) | name.rlike(regex)


def literal_regex(text: str) -> str:
    return "".join(quote(c) for c in text)


def one_of(words) -> str:
    """Alternation of literal words, ``*`` standing for any part of a name."""
    return "|".join(
        re.sub(r"\\\*", "[^/]*", "".join(quote(c) for c in w)) for w in words
    )
