"""A cleaning pipeline over ``documents``: toxicity, near copies, repeated passages, packing.

Each stage takes the rows that the one before kept, written as Parquet and read
again.  All but the last return the columns of ``documents``; the last returns
the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopquarry.llm import jaccard_join, packing, substring_dedup, toxicity
from hopquarry.llm.support import stored, table
from hopquarry.llm.words import likely_members, row_handle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It learns from labels of ``docs``."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the least id (null ids come last), then of the least handle.

    Groups are of rows, not of ids.  Of repeated rows the least by all columns stays.
    """
    rows = stored(jaccard_join.grouped_documents(docs).where("root is not null").select("doc_id", "handle", "root"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "handle"))["handle"].alias("first")
    groups = stored(rows.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    several = rows.join(groups, "root").groupBy("handle").agg(F.first(F.col("handle") == F.col("first")).alias("stays"), F.count("*").alias("n"))
    several = stored(several.where("n > 1 or not stays").select("handle", "stays"), "several")
    keyed = docs.withColumn("handle", row_handle("doc_id", "text"))
    kept = keyed.join(several.select("handle"), "handle", "left_anti").select(*docs.columns)
    again = several.where("stays").select("handle")
    repeated = likely_members(keyed, again, "handle", again.count()).join(again, "handle", "left_semi")
    one = repeated.groupBy("handle").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.unionByName(one)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by windows that occur before are cut out; documents left without words go.

    Untouched documents keep their text as it is; ``n_chars`` follows the text.
    """
    return substring_dedup.cut_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: The classifier and the tokeniser have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
