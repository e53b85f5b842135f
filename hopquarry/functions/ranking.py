"""Ranking: explicit ties, padding, and rank columns.

Scores are compared after rounding to nine digits, so that the order of
floating-point sums does not decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(*ties: str | Column) -> list[Column]:
    return [F.round("score", 9).desc(), *(F.col(t) if isinstance(t, str) else t for t in ties)]


def top_k(hits: DataFrame, k: int, ties: tuple = ("doc_idx",), keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The best ``k`` rows of each key with their ``rank``; ``ties`` decide equal scores."""
    window = Window.partitionBy(*keys).orderBy(*by_score(*ties))
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def pad_with_zeros(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Add the first ``k`` documents with a score of zero, as far as they have none.

    Scores are not negative, so no other unscored document can be among the best k.
    """
    first = docs.select("doc_idx").orderBy("doc_idx").limit(k)
    zeros = queries.select("qid").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    return hits.select("qid", "doc_idx", "score").unionByName(zeros).groupBy("qid", "doc_idx").agg(F.max("score").alias("score"))
