"""Content columns: binary test, decoding, hashes, sizes and tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens import fixed_values as V


def _hex(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def _prefix(content: Column, size: int) -> Column:
    return F.substring(content, 1, size)


def _valid(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def is_binary(content: Column, size: int = V.SAMPLE_SIZE) -> Column:
    """Binary if the first ``size`` bytes hold a NUL, a known signature or no UTF-8.

    ``content`` is the whole file, or at least three bytes more than ``size``: a
    character that straddles the end of the sample is read to its end.
    """
    sample = _prefix(content, size)
    signatures = [s.hex().upper() for s in V.BINARY_SIGNATURES if len(s) <= V.SIGNATURE_PREFIX]
    signed = F.hex(_prefix(content, V.SIGNATURE_PREFIX)).rlike(r"\A(?:" + "|".join(signatures) + ")")
    text = _valid(sample)
    for more in (1, 2, 3):
        text = text | _valid(_prefix(content, size + more))
    return (
        F.when(F.octet_length(content) == 0, False)
        .when(F.contains(sample, _hex(b"\x00")), True)
        .when(signed, True)
        .otherwise(~text)
    )


def decode(content: Column) -> Column:
    """Text of a UTF-8 file with all line ends as LF; null if it is not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), fold_lines(text))


def fold_lines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def language_sample(content: Column, size: int = V.SAMPLE_SIZE) -> Column:
    """Leading bytes as text without bad bytes; null if they hold a NUL.

    Spark marks bad bytes with U+FFFD. A replacement sign that the file itself
    holds is kept: it is set aside as a noncharacter meanwhile.
    """
    sample = _prefix(content, size)
    text = sample.cast("string")
    mark, aside = F.lit("�"), F.lit("\U0010ffff")
    cleaned = F.replace(
        F.replace(F.make_valid_utf8(F.replace(text, mark, aside)), mark, F.lit("")), aside, mark
    )
    return F.when(
        ~F.contains(sample, _hex(b"\x00")),
        F.when(F.is_valid_utf8(text), text).otherwise(cleaned),
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def size_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def tokens(text: Column) -> Column:
    """Estimated tokens of one text, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / V.CHARS_PER_TOKEN)).cast("bigint")


def tenths(value: Column) -> Column:
    """Number with one decimal; exact ties of the binary value go to the even digit."""
    return F.call_function("format_number", value.cast("double"), F.lit("0.0"))


def format_size(size: Column) -> Column:
    """``N B``, ``x.x KB`` or ``x.x MB``."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(tenths(size / 1024), F.lit(" KB")))
        .otherwise(F.concat(tenths(size / (1024 * 1024)), F.lit(" MB")))
    )
