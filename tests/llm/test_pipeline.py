"""The pipeline's stages, one by one, against their operators and plain checks."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from arborlens.llm import decontaminate, near_dedup, quality
from arborlens.llm.tables import given, hold

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = given(spark, SF, "documents")
    for name in ("score", "_score", "_id", "_key", "_spots", "_words", "_gaps", "group", "copy", "key", "marked_id", "judged_id", "judged_key", "spots", "a.b", "label", "_0"):
        docs = docs.withColumn(name, F.lit(name))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = hold(stage(spark, docs, SF), name)
        assert after.columns == columns
        ids, kept = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality":
            good = quality.score(docs, quality.train(docs, given(spark, SF, "labels")), ["doc_id"]).filter("score >= 0.5")
            assert kept == {r.doc_id for r in good.collect()} and kept < ids
        elif name == "near-dedup":
            groups = near_dedup.near_duplicates(docs)
            assert kept == {r.component_id for r in groups.collect()} and kept < ids
        else:
            judged = decontaminate.contamination(docs, given(spark, SF, "benchmark"))
            cut = decontaminate.cut_spans(docs, judged)
            assert cut.columns == columns and cut.select("judged_id", "spots", "_gaps").distinct().collect() == [("judged_id", "spots", "_gaps")]
            assert ids - kept == {r.doc_id for r in judged.filter("contaminated").collect()}
        assert after.exceptAll(docs).count() == 0
        docs = after
    rows = corpus_pipeline.run(spark, SF)
    whole = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in docs.select("doc_id").collect()} and all(r.n == r.t for r in whole)
    filled = np.array([r.n for r in rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()])
    assert filled.max() <= 1024 and filled.sum() > 0.97 * 1024 * len(filled)


def test_empty_and_repeated(spark):
    docs = given(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    few = docs.limit(5)
    assert corpus_pipeline.keep_one_of_each(spark, few.union(few), SF).count() <= 5
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_rows_without_ids_and_ids_with_several_texts(spark):
    text = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1] + " end"), (None, None), (None, None), (None, " "), (1, text[2]), (1, text[3]),
            (2, text[3].upper()), (0, text[4]), (3, text[4]), (3, text[5]), (3, text[5]), (4, None), (4, None), (4, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, extra string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()]
    ones = [(None, text[1]), (None, text[1] + " end")]
    assert sum(x in ones for x in got) == 1
    want = [(None, text[0]), (None, None), (None, None), (None, " "), (1, text[2]), (1, text[3]), (0, text[4]), (3, text[5]), (4, None), (4, "")]
    assert sorted(map(repr, (x for x in got if x not in ones))) == sorted(map(repr, want))
    same = near_dedup.near_duplicates(docs)
    assert same.count() == len(rows) and same.filter("kept is null").count() == 0
