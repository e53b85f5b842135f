"""Analyses over stored runs: coverage, buckets, robustness, costs, summaries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_entity
from ..storage import stored
from . import metrics
from .graph import mentions, without_hubs
from .linking import apply_alias_map

BUCKETS = ("no_entity", "entity_no_gold", "entity_gold")


def entity_buckets(queries: DataFrame, gold_titles: DataFrame, found: DataFrame, mode: str = "none") -> DataFrame:
    """``qid, n_entities, bucket``: whether a question has entities, and one of its gold titles among them."""
    counts = found.groupBy("qid").agg(F.count("*").alias("n_entities"))
    titles = gold_titles.where("title != ''").select("qid", normalize_entity(F.col("title"), mode).alias("entity"))
    matched = found.join(titles, ["qid", "entity"], "left_semi").select("qid").distinct().withColumn("matched", F.lit(True))
    rows = queries.select("qid").join(counts, "qid", "left").join(matched, "qid", "left")
    bucket = F.when(F.col("n_entities").isNull(), BUCKETS[0]).when(F.col("matched"), BUCKETS[2]).otherwise(BUCKETS[1])
    return rows.select("qid", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), bucket.alias("bucket"))


def bucket_metrics(buckets: DataFrame, gold: DataFrame, retrieved: DataFrame, k: int = 10, groups: DataFrame | None = None) -> DataFrame:
    """``bucket, method, count, rate, recall, hit, mrr``; repeated gold counts as often as it stands there."""
    rows = metrics.per_query(gold, retrieved, (k,), dedup=False, keys=("method",), groups=groups).join(buckets, "qid")
    total = buckets.agg(F.count("*").alias("total"))
    out = rows.groupBy("bucket", "method").agg(
        F.count("*").alias("count"), F.avg(f"recall_{k}").alias("recall"), F.avg(f"hit_{k}").alias("hit"), F.avg("rr").alias("mrr")
    )
    return out.crossJoin(F.broadcast(total)).withColumn("rate", F.col("count") / F.col("total")).drop("total")


def hub_coverage(
    docs: DataFrame, gold_titles: DataFrame, aliases: DataFrame | None = None, mode: str = "none", min_df: int = 1, max_df_ratio: float = 1.0, hub_top_ratio: float = 0.01
) -> DataFrame:
    """One row: how many gold titles pruning of hubs removes, and how many questions that affects.  Texts are taken cleaned."""
    found = mentions(docs, aliases, mode)
    table = stored(found.groupBy("entity").agg(F.count("*").alias("df"), F.min(F.struct("doc_idx", "pos")).alias("first")), "entities")
    bound = docs.agg(F.greatest(F.lit(1), F.floor(max_df_ratio * F.greatest(F.lit(1), F.count("*")))).alias("most"))
    window = table.crossJoin(F.broadcast(bound)).where((F.col("df") >= min_df) & (F.col("df") <= F.col("most"))).drop("most")
    firsts = window.select("entity", "df", F.col("first.doc_idx").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    removed = without_hubs(firsts, hub_top_ratio)[1].select("entity")
    mapped = apply_alias_map(gold_titles.select("qid", F.col("title").alias("entity")), aliases, mode)
    titles = mapped.select("entity").distinct()
    gone, kept = titles.join(removed, "entity", "left_semi"), titles.join(window, "entity", "left_semi").join(removed, "entity", "left_anti")
    affected = mapped.join(removed, "entity", "left_semi").select("qid").distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(table, "entities_total").crossJoin(count(window, "entities_filtered")).crossJoin(count(removed, "entities_removed"))
    out = out.crossJoin(count(titles, "gold_titles")).crossJoin(count(gone, "gold_titles_removed")).crossJoin(count(kept, "gold_titles_kept"))
    out = out.crossJoin(count(affected, "queries_affected"))
    rate = F.when(F.col("gold_titles") > 0, F.col("gold_titles_removed") / F.col("gold_titles")).otherwise(0.0)
    return out.withColumn("gold_removed_rate", rate)


def without_tuning(queries: DataFrame, gold: DataFrame, retrieved: DataFrame, n: int = 500, seed: int = 42, k: int = 10) -> DataFrame:
    """Scores per method without the ``n`` questions that tuning may have seen (those with the least hashes)."""
    tuned = queries.select("qid").orderBy(F.xxhash64("qid", F.lit(seed)), "qid").limit(n)
    return metrics.evaluate(gold.join(tuned, "qid", "left_anti"), retrieved, (k,), keys=("method",))


def doc_costs(runs: DataFrame) -> DataFrame:
    """Milliseconds of indexing per document: median, min and max per dataset and method."""
    cost = F.col("index_time_sec") / F.col("docs") * 1000
    rows = runs.where("docs > 0").select("dataset", "method", cost.alias("ms"))
    return rows.groupBy("dataset", "method").agg(F.median("ms").alias("ms_median"), F.min("ms").alias("ms_min"), F.max("ms").alias("ms_max"))


def summarize(results: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Wide rows with ``recall@k`` and ``hit@k`` from the map columns ``recall_at_k`` and ``hit_at_k``."""
    wide = [F.try_element_at(f"{name}_at_k", F.lit(str(k))).alias(f"{name}@{k}") for name in ("recall", "hit") for k in ks]
    return results.select(*[c for c in results.columns if not c.endswith("_at_k")], *wide)


def pivot_metrics(long: DataFrame, keys: list[str], ks: tuple[int, ...]) -> DataFrame:
    """``keys`` and a column per k from rows of (keys, k, value)."""
    return long.groupBy(*keys).pivot("k", list(ks)).agg(F.first("value"))


def latest(runs: DataFrame, keys: tuple[str, ...] = ("dataset", "method"), by: str = "run_mtime") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    return runs.withColumn("place", place).where("place = 1").drop("place")


def best_run(runs: DataFrame, extras: tuple[str, ...]) -> DataFrame:
    """Per dataset the run that has the most of the ``extras`` columns set, then the latest."""
    score = sum((F.max(F.col(c).isNotNull().cast("int")) for c in extras), F.lit(0))
    per_run = runs.groupBy("dataset", "run_dir").agg(score.alias("score"), F.max("run_mtime").alias("at"))
    return per_run.groupBy("dataset").agg(F.max_by("run_dir", F.struct("score", "at")).alias("run_dir"))


def prefer_tag(runs: DataFrame, tags: tuple[str, ...] = ("rev3", "rev2", "rev1", "main3", "main2", "main")) -> DataFrame:
    """Only the rows of the first of these tags that any run has; all rows if none has."""
    present = {r[0] for r in runs.select("tag").where(F.col("tag").isin(*tags)).distinct().collect()}
    chosen = next((t for t in tags if t in present), None)
    return runs.where(F.col("tag") == chosen) if chosen else runs


def main_results(runs: DataFrame) -> DataFrame:
    """The published configurations: full validation of one dataset, the fixed sample of the other."""
    full = (F.col("dataset") == "hotpotqa") & (F.col("split") == "validation") & (F.coalesce("queries", F.lit(0)) >= 7000)
    return latest(prefer_tag(runs).where(full | ((F.col("dataset") == "2wikimultihopqa") & (F.col("max_samples") == 10000))))


def ordered(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Sort by a list of names; unknown ones come last."""
    places = rows.sparkSession.createDataFrame([(n, k) for k, n in enumerate(order)], f"{column} string, place int")
    return rows.join(F.broadcast(places), column, "left").orderBy(F.coalesce("place", F.lit(9999)), column).drop("place")


def maxima(rows: DataFrame, keys: list[str], value: str = "recall@10") -> DataFrame:
    return rows.where(F.col(f"`{value}`").isNotNull()).groupBy(*keys).agg(F.max(f"`{value}`").alias(value))


def maxima_grid(rows: DataFrame, row: str, column: str, value: str = "recall@10") -> DataFrame:
    return rows.where(F.col(f"`{value}`").isNotNull()).groupBy(row).pivot(column).agg(F.max(f"`{value}`"))


def top_configs(rows: DataFrame, by: str = "recall@10", n: int = 10) -> DataFrame:
    return rows.orderBy(F.col(f"`{by}`").cast("double").desc()).limit(n)


def merge_runs(runs: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Rankings (run, method, …) of several runs; of a method in several, the last run's."""
    kept = runs.where(F.col("method").isin(methods)) if methods else runs
    if methods:
        missing = set(methods) - {r[0] for r in kept.select("method").distinct().collect()}
        if missing:
            raise ValueError(f"methods in no run: {sorted(missing)}")
    last = kept.groupBy("method").agg(F.max("run").alias("run"))
    return kept.join(F.broadcast(last), ["method", "run"], "left_semi").drop("run")


def parameter_grid(**values: list) -> list[dict]:
    """All settings of a sweep."""
    return [dict(zip(values, chosen, strict=True)) for chosen in product(*values.values())]


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Settings that a stored sweep does not hold yet."""
    return grid.join(done, keys, "left_anti")
