"""File selection rules as one reason column: null means the file is kept.

Functions whose argument is called ``normal`` expect the result of
:func:`arborlens.functions.paths.normalise`.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.functions import globs, paths
from arborlens.functions.text import BLANK


def check_limit(max_kb: int | None) -> None:
    if max_kb is not None and max_kb < 0:
        raise ValueError(f"the size limit must be non-negative, got {max_kb}")


def default_ignored(normal: Column) -> Column:
    """True for ignored directories, names and endings, found in one search.

    An ending counts only after a character that is not a leading dot.
    """
    directories = globs.one_of(V.IGNORED_DIRS)
    names = globs.one_of(V.IGNORED_FILES)
    endings = globs.one_of(V.IGNORED_EXTENSIONS)
    return normal.rlike(
        rf"(?:\A|/)(?:(?:{directories})(?:/|\z)|(?:{names})\z|\.*[^./][^/]*(?:{endings})\z)"
    )


def names_protected(normal: Column, name: Column, include) -> Column:
    """True if a pattern names this protected file: by name, or by a path it matches."""
    hit = F.lit(False)
    for pattern in (globs.normal_pattern(p) for p in include or ()):
        target = pattern.rsplit("/", 1)[-1]
        if target not in V.PROTECTED_FILES:
            continue
        same = name == F.lit(target)
        if "/" in pattern:
            same = same & normal.rlike(r"(?s)\A" + globs.glob_regex(pattern) + r"\z")
        hit = hit | same
    return hit


def size_reason(length: Column, max_kb: int | None) -> Column:
    """Reason from the size limit alone; equal to the limit still passes."""
    check_limit(max_kb)
    if max_kb is None:
        return F.lit(None).cast("string")
    return F.when(length.isNull(), V.SIZE_UNKNOWN).when(
        length > F.lit(max_kb * 1024).cast("bigint"), V.TOO_LARGE
    )


def size_detail(length: Column, max_kb: int | None) -> Column:
    if max_kb is None:
        return F.lit(None).cast("string")
    return F.when(
        length > F.lit(max_kb * 1024).cast("bigint"),
        F.concat(length.cast("string"), F.lit(f" B > {max_kb * 1024} B limit")),
    )


def name_reason(normal: Column, include=None, exclude=None) -> Column:
    """Reason from the path alone, the first rule that rejects deciding."""
    name = paths.base_name(normal)
    protected = name.isin(*V.PROTECTED_FILES)
    if include:
        protected = protected & ~names_protected(normal, name, include)
    ignored = default_ignored(normal)
    if include:
        ignored = ~globs.any_glob(normal, name, include) & ignored
    reason = F.when(protected, V.PROTECTED).when(ignored, V.DEFAULT_IGNORED)
    if exclude:
        reason = F.when(globs.any_glob(normal, name, exclude), V.EXCLUDED).otherwise(reason)
    return reason


def file_reason(path: Column, length: Column, include=None, exclude=None,
                max_kb: int | None = V.DEFAULT_MAX_KB) -> Column:
    """The whole chain: exclude, protected, include, default rules, size."""
    return F.coalesce(
        name_reason(paths.normalise(path), include, exclude), size_reason(length, max_kb)
    )


def may_lie_in_rejected(normal: Column, exclude=None) -> Column:
    """Cheap test: false if no directory above the path can be rejected by name.

    One search per kind of rule over the whole path, so that most files need no
    look at their directories one by one.
    """
    names = "|".join((
        globs.one_of(V.IGNORED_DIRS + V.IGNORED_FILES),
        r"[^/]*(?:" + globs.one_of(V.IGNORED_EXTENSIONS) + ")",
    ))
    end = f"[{BLANK}]*/"  # blanks at the end of a directory's path do not count
    maybe = normal.rlike(rf"(?:\A|/)(?:{names}){end}")
    for pattern in exclude or ():
        glob = globs.glob_regex(globs.normal_pattern(pattern))
        maybe = maybe | normal.rlike(rf"(?s)(?:\A|/)(?:{glob}){end}")
    return maybe
