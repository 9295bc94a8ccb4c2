"""Benchmark decontamination by exact word windows, in DataFrame functions only.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A benchmark item gives its windows of ``WIDTH``
consecutive words; an item of fewer words, but not none, is one window. The windows become a hash set, which is broadcast
while it has at most ``BROADCAST_WINDOWS`` entries (counted first; some 100 bytes each); beyond, the same join shuffles.
Documents are scanned once: each gives the hashes of its windows, one row each, and one row for the document itself. A hit is
found by the 64-bit hash of the window and verified by its length and by another hash, that of its last four words; two
windows that pass both and differ must share those words and still collide in 64 bits. Only hits and one row per document
are shuffled.

A document word inside any occurrence of a window is hit. A document is contaminated if it has a hit and
``share * hits >= words``.

Defined results: a null or wordless text has no words and is clean; benchmark rows without id or text, or without words,
give no window; items with one id are one item; equal rows give equal results, each; extra columns are ignored; an empty
benchmark leaves every document clean, an empty table gives an empty result. A document's windows are in memory at once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.llm.tables import free, hold, quoted
from arborlens.operators.skew import settle

WIDTH = 13
SHARE = 20
BROADCAST_WINDOWS = 1_000_000
_OTHER = r"[\x00-/:-`{-\x7f]+"
_ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    plain = F.octet_length(text) == F.char_length(text)  # then the faster function does the same
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lower, _OTHER), ""), F.array().cast("array<string>"))


def _hashed(rows: DataFrame) -> DataFrame:
    """Hashes of the words, of all two and of all four neighbouring words, and the number of words, worked out once."""
    rows = rows.withColumn("h", F.transform(words(F.col("text").cast("string")), lambda w: F.xxhash64(w)))
    rows = settle(rows, "h").drop("text").withColumn("n_words", F.size("h").cast("bigint"))
    rows = settle(rows.withColumn("h2", F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1)))), "h2")
    return settle(rows.withColumn("h4", F.transform("h2", lambda x, i: F.xxhash64(x, F.get("h2", i + 2)))), "h4")


def _windows(length: int) -> Column:
    """All windows of a length: place, length, hash of all words, and for the check the hash of the last of them."""
    sizes = [4] * (length // 4) + [2] * (length % 4 // 2) + [1] * (length % 2)
    of = {4: "h4", 2: "h2", 1: "h"}
    lead, *rest = [(of[size], sum(sizes[:k])) for k, size in enumerate(sizes)]
    last = max(w for w in (4, 2, 1) if w <= length)

    def window(x: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.lit(length), x, *[F.get(c, i + at) for c, at in rest]).alias("h1"),
                        F.get(of[last], i + (length - last)).alias("h2"))

    starts = F.slice(lead[0], F.lit(1), F.greatest(F.col("n_words").cast("int") - (length - 1), F.lit(0)))
    return F.transform(starts, window)


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``h1, h2, len, items``: each window once, with the ids of the items that have it."""
    rows = _hashed(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null"))
    own = F.least(F.col("n_words"), F.lit(width))
    windows = F.concat(*[F.when(own == n, _windows(n)).otherwise(F.array().cast("array<struct<pos:int,len:int,h1:bigint,h2:bigint>>"))
                         for n in range(1, width + 1)])
    return rows.select("item", F.inline(windows)).groupBy("h1", "h2", "len").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``doc_id, text_key, n_words, spots, n_hit, items, contaminated`` per document row.

    ``spots`` are the hits, ``(pos, len)`` in words; ``text_key`` tells rows with one id and other texts apart.
    """
    known = hold(benchmark_windows(benchmark, width), "windows")
    lengths = sorted(r[0] for r in known.select("len").distinct().collect())  # 1 to width
    small = known.count() <= BROADCAST_WINDOWS
    rows = _hashed(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), "text"))
    itself = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("h1"), F.lit(None).cast("bigint").alias("h2")))
    places = rows.select("doc_id", "text_key", "n_words", F.inline(F.concat(itself, *map(_windows, lengths))))
    known = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("len").alias("k_len"), "items")
    known = F.broadcast(known) if small else known
    # One long key makes the fastest hash table; the rest is checked on what it finds.
    same = (F.col("h1") == F.col("k1")) & (F.col("h2").bitwiseXOR(F.col("k2")) == 0) & (F.col("len").bitwiseXOR(F.col("k_len")) == 0)
    found = places.join(known, same, "left").filter("pos < 0 or items is not null")
    spot = F.when(F.col("pos") >= 0, F.struct("pos", "len"))
    per = found.groupBy("doc_id", "text_key").agg(
        F.count_if(F.col("pos") < 0).alias("copies"), F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(spot)).alias("spots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def cover(state: Column, x: Column) -> Column:
        end = (x["pos"] + x["len"]).cast("bigint")
        fresh = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(state["end"], x["pos"].cast("bigint")))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["hit"] + fresh).alias("hit"))

    zero = F.lit(0).cast("bigint")
    hit = F.aggregate("spots", F.struct(zero.alias("end"), zero.alias("hit")), cover, lambda s: s["hit"])
    return (
        per.withColumn("n_hit", hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies", "_copy"))


def drop_documents(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The documents that are not contaminated, as they are. The ids to drop are written first, so that their size is known."""
    an_id, key = free(docs.columns, "judged_id", "judged_key")
    bad = hold(judged.filter("contaminated").select("doc_id", "text_key").distinct().toDF(an_id, key), "contaminated")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(an_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    return docs.join(bad, same, "left_anti")


def cut_spans(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """All documents; the words that are hit are removed from their texts, with what follows each up to the next word."""
    an_id, key, spots, of_text, gaps = free(docs.columns, "judged_id", "judged_key", "spots", "words", "gaps")
    hits = judged.filter("n_hit > 0").select("doc_id", "text_key", "spots").distinct().toDF(an_id, key, spots)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(an_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    cut = F.col(spots).isNotNull()
    joined = docs.join(hits, same, "left").drop(an_id, key)
    joined = settle(joined.withColumn(of_text, F.when(cut, F.regexp_extract_all("text", F.lit(_ANY_WORD), F.lit(0)))).withColumn(
        gaps, F.when(cut, F.split("text", _ANY_WORD))), of_text, gaps)

    def kept(i: Column) -> Column:
        hit = F.exists(spots, lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"]))
        return F.when(hit, F.lit("")).otherwise(F.concat(F.get(of_text, i), F.get(gaps, i + 1)))

    rest = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(F.sequence(F.lit(0), F.size(of_text) - 1), kept), ""))
    return joined.withColumn("text", F.when(cut, rest).otherwise(F.col("text"))).select(*map(quoted, docs.columns))
