"""Quality scores by gradient-boosted trees over document statistics.

Statistics are counts and ratios of characters, words and lines of the whole text. Trees are grown level by level on
histograms (``BINS`` quantile bins per statistic) of the gradients of the logistic loss, and kept as flat arrays: node ``i``
has children ``2i+1`` and ``2i+2``, so that a batch of documents goes down all trees with ``DEPTH`` array look-ups each.

The classifier is fitted on a bounded sample of labelled rows, the ``SAMPLE`` ones with the lowest hash of their id; only
these are broadcast to find their texts, and only their statistics reach the driver. Every document is scored where its text
lies, without a shuffle.

Defined results: null and empty texts have all-zero counts and get a score like any other; labels that are neither 0 nor 1,
or of unknown documents, are ignored; repeated labels or documents count each time; with no label, or one kind only, all
scores are (n1 + 1) / (n + 2); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.llm.tables import quoted

SAMPLE = 20_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
SMOOTH = 1.0
FEWEST = 5.0

NAMES = (
    "characters", "bytes_per_character", "words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_next",
    "distinct_pairs", "letters_only", "capitalised", "upper_words", "lines", "line_length", "distinct_lines", "digits", "upper",
    "lower", "blanks", "beyond_ascii", "stops", "commas", "brackets", "bars", "other_signs", "controls", "byte_entropy", "squeezed",
)


def _bytes(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in text]] = True
    return out


_DIGIT, _UPPER, _LOWER = _bytes("0123456789"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz")
_BLANK, _STOP, _COMMA, _BRACKET, _BAR = _bytes(" \t\n\r\f\v"), _bytes(".!?"), _bytes(",;:"), _bytes("()[]{}<>"), _bytes("|/\\_")
_BEYOND = np.arange(256) >= 128
_CONTROL = (np.arange(256) < 32) & ~_BLANK
_OTHER = ~(_DIGIT | _UPPER | _LOWER | _BLANK | _STOP | _COMMA | _BRACKET | _BAR | _BEYOND | _CONTROL)


def statistics(text: str | None) -> list[float]:
    """The numbers of ``NAMES`` for a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size, rows, chars = len(words), max(len(raw), 1), max(len(lines), 1), max(len(text), 1)
    some = max(n, 1)
    lengths = list(map(len, words))
    counts = Counter(words)
    share = histogram[histogram > 0] / size
    pairs = max(n - 1, 1)
    of = lambda kind: float(histogram[kind].sum()) / size
    return [
        float(len(text)), len(raw) / chars, float(n), sum(lengths) / some, float(max(lengths, default=0)), len(counts) / some,
        max(counts.values(), default=0) / some, sum(map(str.__eq__, words, words[1:])) / pairs,
        len(set(zip(words, words[1:]))) / pairs, sum(map(str.isalpha, words)) / some, sum(map(str.istitle, words)) / some,
        sum(map(str.isupper, words)) / some, float(len(lines)), len(text) / rows, len(set(lines)) / rows,
        of(_DIGIT), of(_UPPER), of(_LOWER), of(_BLANK), of(_BEYOND), of(_STOP) * size / some, of(_COMMA) * size / some, of(_BRACKET),
        of(_BAR), of(_OTHER), of(_CONTROL), float(-(share * np.log2(share)).sum()), len(zlib.compress(raw, 1)) / size,
    ]


@dataclass(frozen=True)
class Trees:
    """A fitted ensemble: for each tree the statistic and threshold of its inner nodes, and the value of its leaves."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        at = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            total += value[node - (len(feature))]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1."""
    inner = 2 ** DEPTH - 1
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    ones = int(labels.sum())
    rate = (ones + 1) / (len(labels) + 2)
    start = float(np.log(rate / (1 - rate)))
    if ones in (0, len(labels)):
        return Trees(start, none.feature, none.threshold, none.value)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], 1)
    total, kept = np.full(len(rows), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - labels, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            gain, choice = np.zeros(width), [(0, np.inf)] * width
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                place = (node - first) * BINS + binned[:, f]
                g = np.bincount(place, gradient, width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(place, weight, width * BINS).reshape(width, BINS).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                better = g ** 2 / (h + SMOOTH) + (all_g - g) ** 2 / (all_h - h + SMOOTH) - all_g ** 2 / (all_h + SMOOTH)
                better[(h < FEWEST / 4) | (all_h - h < FEWEST / 4)] = 0
                better = better[:, :len(e)]
                cut = better.argmax(1)
                for k in np.flatnonzero(better[np.arange(width), cut] > gain + 1e-9):
                    gain[k], choice[k] = better[k, cut[k]], (f, e[cut[k]])
            for k, (f, t) in enumerate(choice):
                feature[first + k], threshold[first + k] = f, t
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + SMOOTH)
        total += value[leaf]
        kept.append((feature, threshold, value))
    return Trees(start, *(np.stack(x) for x in zip(*kept)))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 3


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64())), batch.column(0)], names=["x", "label"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted to labelled rows outside the held-out third; ``sample`` bounds how many labels, and how many rows with them."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & (remainder(F.col("doc_id")) != 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(known), "doc_id").select("label", "text").mapInArrow(_measure, "x array<double>, label int")
    # A labelled id may stand in very many rows; the driver gets no more than the sample.
    table = rows.orderBy(F.xxhash64("x", "label"), "label", "x").limit(sample).toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(NAMES))
    y = np.array(table["label"].to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the rows come in any order
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, columns: list[str]) -> DataFrame:
    """The given columns of the documents with ``score``."""
    return _scored(docs, trees, columns).toDF(*columns, "score")


def keep(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``least``, as they are; a column may be named ``score``, too."""
    return _scored(docs, trees, docs.columns).filter(F.col("_score") >= least).drop("_score").toDF(*docs.columns)


def _scored(docs: DataFrame, trees: Trees, columns: list[str]) -> DataFrame:
    names = [f"_{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(columns, names)], F.col("text").cast("string").alias("_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(len(names)).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(trees.score(x))], names=[*names, "_score"])

    schema = rows.drop("_text").withColumn("_score", F.lit(0.0)).schema
    return rows.mapInArrow(judge, schema)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs, train(docs, labels, sample), ["doc_id"])
    return scored.select(
        F.col("doc_id").cast("bigint"), F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
