"""Entity linking by titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_entity, title_aliases


def build_alias_map(titles: DataFrame, title: str = "title", order: str = "doc_idx") -> DataFrame:
    """``alias_key, canonical``: aliases that exactly one title occurrence has."""
    aliases = titles.select(F.col(title).alias("canonical"), F.col(order).alias("at"), F.posexplode(title_aliases(F.col(title))).alias("pos", "alias"))
    keyed = aliases.select("canonical", normalize_entity(F.col("alias"), "simple").alias("alias_key"))
    return keyed.where("alias_key != ''").groupBy("alias_key").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")


def apply_alias_map(entities: DataFrame, aliases: DataFrame | None, mode: str = "none") -> DataFrame:
    """Replace ``entity`` by the title that its key names, then normalise; empty ones go, order and repeats stay."""
    out = entities.where("entity != ''")
    if aliases is not None:
        out = out.withColumn("alias_key", normalize_entity(F.col("entity"), "simple")).join(aliases, "alias_key", "left")
        out = out.withColumn("entity", F.coalesce("canonical", "entity")).drop("alias_key", "canonical")
    return out.withColumn("entity", normalize_entity(F.col("entity"), mode)).where("entity != ''")
