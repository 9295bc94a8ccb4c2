"""Token counts per section by offset-mapped attribution.

A document is encoded once, as a whole. Every token has a span of characters, every section too; tokens are joined to the
sections their spans meet, by two sorted searches per document. A token that meets one section is its. A token that
crosses borders goes by an explicit rule: ``start`` (the section with its first character), ``end`` (its last one) or
``most`` (the longest overlap, ties to the earlier section). So each token counts once and a document's counts add up.
Tokens that meet no section are not counted.

Sections are half-open spans in ascending order that do not overlap. ``lines`` makes one of every line, with the line
feed that ends it.

Defined results: a null or empty text has one empty section without tokens; repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.tokens import blocks, encoder

RULES = ("start", "end", "most")


def lines(text: str) -> np.ndarray:
    """Spans of the lines of a text."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array([[0, *ends[:-1]], ends], np.int64).T


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether its span meets several."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    start, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    low, high = sections[:, 0], sections[:, 1]
    first = np.searchsorted(high, start, "right")  # the first section that ends after the token's start
    last = np.searchsorted(low, end, "left") - 1  # the last one that begins before its end
    found, crossing = first <= last, last > first
    if rule == "end":
        owner = last.copy()
    else:
        owner = first.copy()
        if rule == "most":
            for i in np.flatnonzero(crossing):
                own = np.arange(first[i], last[i] + 1)
                owner[i] = own[np.argmax(np.minimum(high[own], end[i]) - np.maximum(low[own], start[i]))]
    owner[~found] = -1
    return owner, crossing


def section_counts(docs: DataFrame, tokenizer: str, rule: str = "start",
                   sections: Callable[[str], np.ndarray] = lines) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing, doc_tokens``: a row for each section of each document.

    ``n_crossing`` counts those of the section's tokens that meet other sections too.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, offsets=True)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in blocks(texts, 1 << 18):
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                owners = []
                for text, spans in zip(texts[low:high], encode(texts[low:high])):
                    own = sections(text or "")
                    owner, crossing = attribute(spans, own, rule)
                    n = len(own)
                    inside = owner >= 0
                    for column, values in zip(columns, (
                        np.arange(n), own[:, 0], own[:, 1], np.bincount(owner[inside], minlength=n),
                        np.bincount(owner[inside & crossing], minlength=n), np.full(n, len(spans)),
                    )):
                        column.append(values.astype(np.int64))
                    owners.append(n)
                doc = pa.array(ids[low:high], pa.int64()).take(pa.array(np.repeat(np.arange(high - low), owners)))
                yield pa.RecordBatch.from_arrays(
                    [doc, *(pa.array(np.concatenate(c)) for c in columns)],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id bigint, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint")
