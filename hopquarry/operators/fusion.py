"""Fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import top_k

RRF_K = 60


def rrf_scores(lists: list[DataFrame], rrf_k: int = RRF_K) -> DataFrame:
    """``qid, doc_idx, score, first``: sums of 1 / (k + rank); ``first`` is the first list and rank that had it."""
    tagged = [h.select("qid", "doc_idx", "rank", F.lit(n).alias("list_no")) for n, h in enumerate(lists)]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("qid", "doc_idx")
        .agg(F.sum(1 / (rrf_k + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    )


def rrf_fuse(lists: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    return top_k(rrf_scores(lists, rrf_k), k, ties=("first",)).drop("first")


def normalize_scores(hits: DataFrame) -> DataFrame:
    """Scores divided by their question's greatest, where that is above zero."""
    most = F.max("score").over(Window.partitionBy("qid"))
    return hits.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(F.col("score")))


def linear_fuse(first: DataFrame, second: DataFrame, weight: float, k: int) -> DataFrame:
    """Normalised scores of two lists (qid, doc_idx, score, place), the second weighted.

    Ties keep the order of the first list, then of the second.
    """
    a = normalize_scores(first).select("qid", "doc_idx", "score", F.struct(F.lit(0).alias("list_no"), "place").alias("at"))
    b = normalize_scores(second).select("qid", "doc_idx", (F.col("score") * weight).alias("score"), F.struct(F.lit(1).alias("list_no"), "place").alias("at"))
    both = a.unionByName(b).groupBy("qid", "doc_idx").agg(F.sum("score").alias("score"), F.min("at").alias("at"))
    return top_k(both, k, ties=("at",)).drop("at")
