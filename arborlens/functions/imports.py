"""Modules named by import statements, read with regular expressions.

Blanks before a keyword are matched within its own line only: that names the
same modules as a class with line feeds and stays linear on blank runs.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.functions.text import BLANK, INLINE_BLANK, strip

# ---- fixed values: statements that name modules ------------------------------
_LINE = f"(?md)^[{INLINE_BLANK}]*"
_IMPORT = _LINE + f"import[{BLANK}]+([^\\n#]+)"
_FROM = _LINE + f"from[{BLANK}]+([^{BLANK}]+)[{BLANK}]+import[{BLANK}]+([^\\n#]+)"
_FROM_DOTS = _LINE + f"from[{BLANK}]+(\\.+)[{BLANK}]+import[{BLANK}]+([^\\n#]+)"

_JS_FROM = f"import[{BLANK}]+[^\\n]*?from[{BLANK}]+[\"']([^\"']+)[\"']"
_JS_CALL = f"import[{BLANK}]*\\([{BLANK}]*[\"']([^\"']+)[\"'][{BLANK}]*\\)"
_JS_REQUIRE = f"require[{BLANK}]*\\([{BLANK}]*[\"']([^\"']+)[\"'][{BLANK}]*\\)"
# Optional statements beyond the default three.
_JS_BARE = f"import[{BLANK}]+[\"']([^\"']+)[\"']"
_JS_WIDE = f"(?:import|export)[{BLANK}]+[^;\"']*?from[{BLANK}]+[\"']([^\"']+)[\"']"


def _all(text: Column, regex: str, word: str, group: int = 1) -> Column:
    """All matches; a text without the pattern's keyword is not searched."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(word)), found).otherwise(none)


def _first_words(names: Column, extra: str = "") -> Column:
    """First word of every comma-separated piece; empty pieces are dropped."""
    words = F.transform(
        F.split(names, ","), lambda p: F.regexp_extract(p, f"([^{BLANK}{extra}]+)", 1)
    )
    return F.filter(words, lambda w: w != "")


def python_imports(text: Column) -> Column:
    """Modules in statement order: all ``import`` statements, then all ``from``."""
    plain = F.flatten(F.transform(_all(text, _IMPORT, "import"), lambda m: _first_words(m)))
    return F.concat(plain, _all(text, _FROM, "from"))


def python_requests(text: Column) -> Column:
    """Modules to resolve, each once.

    ``from . import a, b`` asks for the modules ``.a`` and ``.b``.
    """
    named = F.zip_with(
        _all(text, _FROM_DOTS, "from", 1),
        _all(text, _FROM_DOTS, "from", 2),
        lambda dots, names: F.transform(
            _first_words(names, extra="()"), lambda n: F.concat(dots, n)
        ),
    )
    modules = F.filter(python_imports(text), lambda m: ~m.rlike(r"\A\.+\z"))
    return F.array_distinct(F.concat(modules, F.flatten(named)))


def _script_kinds(text: Column, wide: bool) -> tuple[Column, Column]:
    """Modules of ``import … from``, and those of all other kinds."""
    rest = [_all(text, _JS_CALL, "import"), _all(text, _JS_REQUIRE, "require")]
    if wide:
        rest += [_all(text, _JS_BARE, "import"), _all(text, _JS_WIDE, "from")]
    return (
        F.transform(_all(text, _JS_FROM, "from"), strip),
        F.transform(F.concat(*rest), strip),
    )


def script_imports(text: Column, wide: bool = False) -> Column:
    """Modules of ``import … from``, ``import()`` and ``require()``.

    The later two kinds add only modules that are not listed yet. ``wide`` adds
    bare imports, re-exports and statements that span lines.
    """
    listed, rest = _script_kinds(text, wide)
    return F.concat(listed, F.array_except(rest, listed))


def script_requests(text: Column, wide: bool = False) -> Column:
    """Modules to resolve, each once."""
    return F.array_distinct(F.concat(*_script_kinds(text, wide)))
