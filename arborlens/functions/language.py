"""Language of a file from its ending, name, first line or text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.functions import paths
from arborlens.functions.text import BLANK, lookup, strip


def by_extension(name: Column) -> Column:
    """From the ending; a name that is only a leading dot and letters counts as one."""
    ending = paths.extension(name)
    ending = F.when((ending == "") & F.startswith(name, F.lit(".")), F.lower(name)).otherwise(ending)
    return lookup(ending, V.LANGUAGE_BY_EXTENSION)


def by_name(name: Column) -> Column:
    return lookup(F.lower(paths.base_name(name)), V.LANGUAGE_BY_NAME)


def by_shebang(text: Column) -> Column:
    """From an interpreter named in the first line."""
    line = strip(F.substring_index(text, "\n", 1))
    blank = f"[{BLANK}]"
    chain = F.when(~F.startswith(line, F.lit("#!")), F.lit(None).cast("string"))
    for language, interpreter, places in V.SHEBANGS:
        where = "|".join(p.replace(" ", f"{blank}+") for p in places)
        chain = chain.when(
            line.rlike(rf"\A#!{blank}*(?:{where}){interpreter}(?:{blank}|\z)"), language
        )
    return chain


def sample(text: Column) -> Column:
    """The characters that ``by_content`` looks at."""
    return F.left(text, F.lit(V.SAMPLE_SIZE))


def by_content(sampled: Column) -> Column:
    """From markers: the first language with enough different markers present."""
    chain = None
    for language, markers in V.CONTENT_MARKERS:
        found = sum(
            (F.contains(sampled, F.lit(m)).cast("int") for m in markers), start=F.lit(0)
        )
        test = found >= V.MARKERS_NEEDED
        chain = F.when(test, language) if chain is None else chain.when(test, language)
    return chain


def detect(name: Column, text: Column, sampled: Column | None = None) -> Column:
    """Ending, then name, then first line, then markers, else ``unknown``."""
    return F.coalesce(
        by_extension(name),
        by_name(name),
        by_shebang(text),
        by_content(sample(text) if sampled is None else sampled),
        F.lit(V.UNKNOWN_LANGUAGE),
    )


def graph_language(file_type: Column) -> Column:
    """Language whose imports are read; null for all other files."""
    return lookup(F.lower(file_type), V.GRAPH_LANGUAGES)
