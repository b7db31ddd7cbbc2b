"""Retrieval and answer metrics, and their averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_scores


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    return F.when(F.size(gold) == 0, 1.0).otherwise(found / F.size(F.array_distinct(gold)))


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    n = F.least(F.lit(k), F.size(retrieved))
    return F.when(n <= 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), gold)) / n) if k > 0 else F.lit(0.0)


def hit_at(retrieved: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.arrays_overlap(F.slice(retrieved, 1, k), gold).cast("double"))


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    places = F.filter(F.transform(retrieved, lambda p, i: F.when(F.array_contains(gold, p), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(gold) == 0, 1.0).when(F.size(places) == 0, 0.0).otherwise(1.0 / F.array_min(places))


def retrieval_metrics(df: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """df with `retrieved` (in order) and `gold` (arrays) -> recall@k, precision@k, hit@k, mrr added."""
    r, g = F.col("retrieved"), F.col("gold")
    out = {"mrr": reciprocal_rank(r, g)}
    for k in sorted(set(ks)):
        out |= {f"recall@{k}": recall_at(r, g, k), f"precision@{k}": precision_at(r, g, k), f"hit@{k}": hit_at(r, g, k)}
    return df.withColumns(out)


def answer_metrics(df: DataFrame, prediction: str, answer: str, aliases: str, boundary: str = "unicode") -> DataFrame:
    """exact_match and f1, each the best over the answer and its aliases."""
    golds = F.concat(F.array(answer), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    scored = df.withColumn("_s", best_scores(F.col(prediction), golds, boundary))
    return scored.withColumn("exact_match", F.col("_s.em")).withColumn("f1", F.col("_s.f1")).drop("_s")


def pair_metrics(hits: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """recall, precision, hit and reciprocal rank where gold sets are too large for a row.

    hits: query_id, gold_key, rank, hit (boolean), the top k of each query. sizes: gold_key, n (relevant items).
    """
    each = hits.groupBy("query_id", "gold_key").agg(F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("got"))
    none = F.col("n") == 0
    return each.join(sizes, "gold_key").select(
        "query_id", "gold_key",
        F.when(none, 1.0).otherwise(F.col("hits") / F.when(none, 1).otherwise(F.col("n"))).alias("recall"),
        (F.col("hits") / F.least(F.lit(k), "got")).alias("precision"),
        (none | (F.col("hits") > 0)).cast("double").alias("hit"),
        F.when(none, 1.0).when(F.col("first").isNull(), 0.0).otherwise(1.0 / F.col("first")).alias("rr"),
    )


def summary(samples: DataFrame, k: int, *keys: str) -> DataFrame:
    """Unweighted means over questions, a row for each of `keys`."""
    timed = [c for c in ("retrieval_latency_ms", "total_latency_ms") if c in samples.columns]
    names = list(dict.fromkeys(["exact_match", "f1", "mrr", "recall@1", "recall@2", "recall@3", f"recall@{k}", *timed]))
    means = [F.avg(f"`{c}`").alias(c) for c in names] + [F.avg("diffusion_steps").alias("avg_diffusion_steps")]
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_samples"), *means)


def consolidated(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def pivot(summaries: DataFrame, metric: str, methods: list[str]) -> DataFrame:
    return summaries.groupBy("dataset").pivot("method", methods).agg(F.first(metric))


def latency_by_method(tables: list[DataFrame]) -> DataFrame:
    """method, retrieval_latency_ms: the mean over the datasets' summaries."""
    return consolidated(tables).groupBy("method").agg(F.avg("retrieval_latency_ms").alias("retrieval_latency_ms"))
