"""Vectors of texts, kept by content: a text is encoded once for each model, however many corpora have it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.runs import ordered_digest, output_name
from .dense import encode

CACHED = "digest string, vec array<double>"


def folder(path: str, model: str) -> str:
    return f"{path}/{output_name(model)}"


def cached_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """``digest, vec`` of all texts that this model has encoded; empty where it has none."""
    try:
        return spark.read.schema(CACHED).parquet(f"{folder(path, model)}/*")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHED)


def cached_encode(docs: DataFrame, encoder: Callable[[list[str]], np.ndarray], model: str, path: str, text: str = "text") -> DataFrame:
    """``docs`` with unit vectors ``vec``; only texts that the cache in ``path`` does not have are encoded.

    A text's key is its digest, so neither ids nor order matter, and equal texts
    are encoded once.  The missing ones form a batch whose folder is named by their digest as
    a whole: writing the same batch again replaces it.  A null text counts as empty.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_digest", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    known = cached_vectors(spark, path, model).select(F.col("digest").alias("_digest"))
    missing = keyed.join(known, "_digest", "left_anti").groupBy("_digest").agg(F.first(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    if not missing.isEmpty():
        batch = ordered_digest(missing.select(F.conv(F.substring("_digest", 1, 15), 16, 10).cast("long").alias("at"), F.col("_digest").alias("digest")))
        vectors = encode(missing.select(F.col("_digest").alias("digest"), "text"), encoder).select("digest", "vec")
        vectors.write.mode("overwrite").parquet(f"{folder(path, model)}/{batch[:16]}")
    # two writers at once may both have encoded a text
    vectors = cached_vectors(spark, path, model).groupBy(F.col("digest").alias("_digest")).agg(F.first("vec").alias("vec"))
    return keyed.join(vectors, "_digest").drop("_digest")
