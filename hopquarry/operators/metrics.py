"""Scores of rankings against gold, and their statistics."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_answer


def per_query(gold: DataFrame, retrieved: DataFrame, ks: tuple[int, ...], cut_rr: int | None = None, dedup: bool = True, keys: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """``(keys, qid), rr, hit_k…, recall_k…`` for questions that have gold; missing rankings count as empty.

    ``retrieved`` has the keys, qid, doc_id and rank.  ``groups`` names the values
    of the keys; without it they are found in ``retrieved``, which is then read twice.
    """
    ks = tuple(sorted(set(ks)))
    truth = gold.select("qid", "doc_id")
    truth = truth.distinct() if dedup else truth
    if keys and groups is None:
        groups = retrieved.select(*keys).distinct()
    wanted = truth.crossJoin(F.broadcast(groups)) if groups is not None else truth
    best = retrieved.groupBy(*keys, "qid", "doc_id").agg(F.min("rank").alias("rank"))
    joined = wanted.join(best, [*keys, "qid", "doc_id"], "left")
    first = F.min("rank")
    rr = F.coalesce(1 / first, F.lit(0.0))
    if cut_rr is not None:
        rr = F.when(first <= cut_rr, 1 / first).otherwise(0.0)
    hits = [(F.count_if(F.col("rank") <= k) > 0).cast("double").alias(f"hit_{k}") for k in ks]
    recalls = [(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks]
    return joined.groupBy(*keys, "qid").agg(rr.alias("rr"), *hits, *recalls)


def evaluate(gold: DataFrame, retrieved: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), keys: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """Averages over questions: ``n, mrr, hit_k…, recall_k…``; zeros without questions."""
    rows = per_query(gold, retrieved, ks, keys=keys, groups=groups)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    values = [c for c in rows.columns if c.startswith(("hit_", "recall_"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), mean("rr").alias("mrr"), *[mean(c).alias(c) for c in values])


def nearest_rank(values: Column, share: float) -> Column:
    """The element at the half-even rounded place of a share, of a collected list."""
    ordered = F.sort_array(values)
    at = F.least(F.size(values) - 1, F.bround(F.lit(float(share)) * (F.size(values) - 1)).cast("int"))
    return F.coalesce(F.try_element_at(ordered, at + 1).cast("double"), F.lit(0.0))


def latency_stats(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """``total, mean, p50, p95, p99`` by nearest rank.

    A list of values is bounded by the distinct ones: equal values are counted first.
    """
    counts = samples.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("v")
    total = Window.partitionBy(*keys)
    ranked = counts.select(*keys, "v", "n", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(total).alias("all"))
    place = lambda p: F.least(F.col("all") - 1, F.bround(F.lit(float(p)) * (F.col("all") - 1)))
    pick = lambda p: F.min(F.when(F.col("upto") > place(p), F.col("v")))
    out = ranked.groupBy(*keys) if keys else ranked
    return out.agg(
        F.sum(F.col("v") * F.col("n")).alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), F.sum("n").alias("n"),
    )


def paired(per_method: DataFrame, metric: str) -> DataFrame:
    """``baseline, method, qid, d``: differences of a metric between all pairs of methods."""
    a = per_method.select("qid", F.col("method").alias("method"), F.col(metric).alias("x"))
    b = per_method.select("qid", F.col("method").alias("baseline"), F.col(metric).alias("y"))
    return a.join(b, "qid").where("method != baseline").select("baseline", "method", "qid", (F.col("x") - F.col("y")).alias("d"))


def compare_methods(per_method: DataFrame, metric: str) -> DataFrame:
    return paired(per_method, metric).groupBy("baseline", "method").agg(
        F.avg("d").alias("mean_diff"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"),
        F.count_if(F.col("d") < 0).alias("losses"), F.count("*").alias("n"),
    )


def bootstrap(differences: DataFrame, iters: int = 1000, seed: int = 42) -> DataFrame:
    """Paired bootstrap intervals of the mean difference: ``baseline, method, mean_diff, lo, hi, n``.

    A group holds one number per question; each group starts from the same seed.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("qid")["d"].tolist()
        rng = random.Random(seed)
        means = sorted(sum(d[rng.randrange(len(d))] for _ in d) / len(d) for _ in range(iters))
        return pd.DataFrame([{
            "baseline": pdf["baseline"].iloc[0], "method": pdf["method"].iloc[0], "mean_diff": sum(d) / len(d),
            "lo": means[int(0.025 * iters)], "hi": means[min(iters - 1, int(0.975 * iters))], "n": len(d),
        }])

    return differences.groupBy("baseline", "method").applyInPandas(run, "baseline string, method string, mean_diff double, lo double, hi double, n long")


def answer_scores(pairs: DataFrame, compat: bool = False) -> DataFrame:
    """``em`` and token ``f1`` of each row's ``pred`` and ``gold``, added to the row (keyed by ``qid``)."""
    p, g = normalize_answer(F.col("pred"), compat), normalize_answer(F.col("gold"), compat)
    words = lambda c: F.filter(F.split(c, " +"), lambda w: w != "")
    rows = pairs.select("*", p.alias("_p"), g.alias("_g"), words(p).alias("_pw"), words(g).alias("_gw"))
    # shared tokens with multiplicity: the lesser count of each distinct word
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    same = F.aggregate(F.array_distinct("_pw"), F.lit(0), lambda s, w: s + F.least(count(F.col("_pw"), w), count(F.col("_gw"), w)))
    np_, ng = F.size("_pw"), F.size("_gw")
    f1 = F.when((np_ == 0) & (ng == 0), 1.0).when((np_ == 0) | (ng == 0) | (F.col("_same") == 0), 0.0).otherwise(2.0 * F.col("_same") / (np_ + ng))
    return rows.withColumn("_same", same).withColumn("em", (F.col("_p") == F.col("_g")).cast("double")).withColumn("f1", f1).drop("_p", "_g", "_pw", "_gw", "_same")
