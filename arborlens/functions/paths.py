"""Path columns: normal form, names, extensions, ancestors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.functions.text import strip


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalise(path: Column) -> Column:
    """Form used for rule matching: forward slashes, lower case, no outer blanks."""
    return strip(F.lower(forward_slashes(path)))


def relative_to(path: Column, root: Column) -> Column:
    """Path below ``root``; null when the path is not below it."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(path, prefix), F.substr(path, F.length(prefix) + F.lit(1))
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path, '' at the top."""
    return F.regexp_replace(path, r"(?s)(^|/)[^/]*\z", "")


def extension(name: Column) -> Column:
    """Lower-cased ending from the last dot; leading dots do not start one."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1))


def depth(path: Column) -> Column:
    """Number of directories above the path."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def ancestors(path: Column) -> Column:
    """Directories above a path, topmost first; empty for a top-level path."""
    levels = depth(path)
    prefixes = F.transform(
        F.sequence(F.lit(1), levels),
        lambda i: F.call_function("substring_index", path, F.lit("/"), i),
    )
    return F.when(levels > 0, prefixes).otherwise(F.array().cast("array<string>"))


def repository_name(url: Column) -> Column:
    """Last segment of an address without outer slashes and one ``.git``."""
    last = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    return F.regexp_replace(last, r"\.git\z", "")


def source_kind(source: Column) -> Column:
    """``remote`` for an https address at the known host, otherwise ``local``."""
    return F.when(F.startswith(source, F.lit("https://github.com/")), "remote").otherwise("local")
