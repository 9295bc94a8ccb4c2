"""Repeated attempts per key: stop rule, best attempt, and the loop itself."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.fixed_values import GOOD_SCORE, MAX_ROUNDS


def best_attempts(attempts: DataFrame, good: float = GOOD_SCORE, rounds: int = MAX_ROUNDS,
                  keys: list[str] | None = None) -> DataFrame:
    """Rounds that count and the best of them for every key.

    Attempts after the first good score, or after ``rounds``, do not count. The
    best is the highest score above zero, the earliest on ties; else null. At
    most ``rounds`` attempts of a key pass the filter, so the list per key that
    is looked at stays that short.
    """
    keys = keys or ["k"]
    tries = F.array_sort(F.collect_list(F.struct("iteration", "score")))
    grouped = attempts.where(F.col("iteration") <= rounds).groupBy(*keys).agg(tries.alias("tries"))
    stop = F.array_position(F.transform("tries", lambda t: t["score"] >= good), F.lit(True)).cast("int")
    grouped = grouped.withColumn(
        "tries", F.when(stop > 0, F.slice("tries", F.lit(1), stop)).otherwise(F.col("tries"))
    )
    ranked = F.transform(
        F.filter("tries", lambda t: t["score"] > 0),
        lambda t: F.struct(t["score"].alias("score"), (-t["iteration"]).alias("later")),
    )
    best = F.array_max(ranked)
    return grouped.select(
        *keys, F.size("tries").cast("bigint").alias("rounds"),
        (-best["later"]).cast("bigint").alias("best_iteration"), best["score"].alias("best_score"),
    )


def best_texts(attempts: DataFrame, **options) -> DataFrame:
    """The best attempts with their texts; keys without one get an empty text."""
    best = best_attempts(attempts, **options)
    texts = attempts.select("k", F.col("iteration").cast("bigint").alias("best_iteration"), "text")
    return best.join(texts, ["k", "best_iteration"], "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def refine(keys: DataFrame, generate: Callable[[dict], str], review: Callable[[str], tuple[float, str]],
           good: float = GOOD_SCORE, rounds: int = MAX_ROUNDS,
           concurrency: int | None = None) -> DataFrame:
    """Attempts of every key: generate, review, and go on while not good enough.

    ``generate`` gets the row with ``iteration``, ``latest`` (its last text) and
    ``feedback`` (all feedback so far); ``review`` gets the text. Only keys that
    are not done enter the next round. A round is one distributed pass, its
    result checkpointed so that no attempt is made twice; the driver only
    counts rounds. ``concurrency`` sets the number of tasks of a round: rows are
    few and small here, and Spark would put them into few partitions.
    """
    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                row["feedback"] = list(row["feedback"])
                text = generate(row)
                score, feedback = review(text)
                out.append((text, float(score), feedback))
            yield batch.drop(columns=["latest", "feedback"]).assign(
                latest=[o[0] for o in out], score=[o[1] for o in out],
                feedback=[list(f) + [o[2]] for f, o in zip(batch["feedback"], out)],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields)
    if concurrency:
        keys = keys.repartition(concurrency, "k")
    state = keys.withColumns({
        "latest": F.lit(""), "feedback": F.array().cast("array<string>"), "iteration": F.lit(0),
    })
    done = None
    for _ in range(rounds):
        state = state.withColumn("iteration", F.col("iteration") + 1)
        tried = state.mapInPandas(
            attempt,
            schema + ", iteration int, latest string, score double, feedback array<string>",
        ).checkpoint()
        rows = tried.select(
            F.col("k").cast("string").alias("k"), "iteration", "score",
            F.element_at("feedback", -1).alias("feedback"), F.col("latest").alias("text"),
        )
        done = rows if done is None else done.unionByName(rows)
        state = tried.where(F.col("score") < good).drop("score")
        if state.isEmpty():
            break
    return done
