"""A whole experiment: methods, their scores, and what is stored of them."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, ppr
from ..sources import runs
from ..storage import stored
from .methods import GRAPH_SETTINGS, METHODS, Engine, entity_start, fallback_queries, fallback_start, hybrid_start, with_settings

#: Parts that are built once and serve several methods.
BUILT = {"index", "graph", "term_graph"}


def evaluate_methods(engine: Engine, retrieved: DataFrame) -> DataFrame:
    return metrics.evaluate(engine.corpus.gold, retrieved, engine.settings.top_ks, keys=("method",))


def run_experiment(engine: Engine, methods: list[str], path: str, config: dict | None = None) -> DataFrame:
    """Retrieve by each method, store rankings, metrics and a manifest entry; return the metrics.

    Times are those of whole batches.  What building indexes and graphs took is the
    index time of the method that first needs them; the rest is query time, with the
    parts of seeds and PageRank where a method has them.  A question has no time of its own
    here: the mean is the batch's time divided by the questions, percentiles are null.
    """
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    spark = engine.corpus.docs.sparkSession
    ids = engine.corpus.docs.select("doc_idx", "doc_id")
    docs, queries = engine.corpus.docs.count(), engine.corpus.queries.count()
    took, built, ranked, fallbacks = {}, {}, {}, {}
    for name in methods:
        before, began = set(engine.times) & BUILT, time.time()
        for part in ("seed", "ppr"):
            engine.times.pop(part, None)
        hits = METHODS[name](engine).join(ids, "doc_idx").select("qid", "rank", "doc_id", "score")
        hits.write.mode("overwrite").parquet(f"{path}/retrieved/method={name}")
        built[name] = sum(engine.times[part] for part in (set(engine.times) & BUILT) - before)
        took[name] = time.time() - began - built[name]
        ranked[name] = (engine.times.get("seed"), engine.times.get("ppr"))
        fallbacks[name] = fallback_queries(engine).count() if name == "graph_bm25_fallback" else None
    retrieved = runs.read_retrieved(spark, path)
    table = evaluate_methods(engine, retrieved)
    results = []
    for row in table.collect():
        r = row.asDict()
        seconds, (seed, ppr), lost = took[r["method"]], ranked[r["method"]], fallbacks[r["method"]]
        results.append({
            "method": r["method"], "index_time_sec": built[r["method"]], "query_time_sec": seconds, "docs": docs, "queries": queries,
            "metrics": {"mrr": r["mrr"], **{f"{n}_at_k": {str(k): r[f"{n}_{k}"] for k in engine.settings.top_ks} for n in ("recall", "hit")}},
            "latency_stats": {"total": seconds, "mean": seconds / max(1, queries), "p50": None, "p95": None, "p99": None},
            "seed_time_sec": seed, "ppr_time_sec": ppr, "fallback_count": lost, "fallback_rate": None if lost is None else lost / max(1, queries),
        })
    config = {"tag": None, **(config or {})}
    runs.write_metrics(spark, config, results, path)
    runs.append_manifest(spark, {"run_id": runs.run_id(), "path": path, **config, "settings": asdict(engine.settings)}, f"{path}/../manifest")
    return table


#: Settings that a batch of settings can differ in: weights of seeds, and the share that returns to them.
PER_QUESTION = {
    "alpha", "seed_docs_k", "seed_k_bm25", "seed_weighting", "seed_temp", "seed_mix_mode", "seed_mix_alpha", "seed_entity_df_power", "fallback_k", "compat_fallback",
}
#: Graph methods by what they rank from, for settings in one batch.
SEEDED = {"graph": entity_start, "graph_bm25_fallback": fallback_start, "graph_hybrid": hybrid_start}


def _batches(grid: list[dict]) -> list[list[int]]:
    """Places of settings that differ only in ``PER_QUESTION``."""
    found: dict[tuple, list[int]] = {}
    for at, setting in enumerate(grid):
        key = tuple(sorted((k, repr(v)) for k, v in setting.items() if k not in PER_QUESTION))
        found.setdefault(key, []).append(at)
    return list(found.values())


def sweep_rankings(engine: Engine, grid: list[dict], method: str = "graph") -> DataFrame:
    """``config, qid, rank, doc_idx, score`` of one method for all settings of a grid; ``config`` is the place in the grid.

    Settings that differ only in ``PER_QUESTION`` share the graph, the hits and one walk: a question under a setting
    is a question of its own, keyed by both, so rounds do not grow in number with the settings.  Other settings, other
    methods and other kinds of walk have a plan for each batch, over whatever parts ``with_settings`` keeps.
    """
    if method not in METHODS:
        raise ValueError(f"unknown methods: {[method]}")
    out, graphs = None, {}
    for batch in _batches(grid):
        first = with_settings(engine, **grid[batch[0]])
        relational = first.settings.mode == "power" and first.settings.backend == "relational" and first.settings.tol is None
        if method in SEEDED:
            # a graph is built once for all batches that agree in its settings
            wanted = tuple(repr(getattr(first.settings, name)) for name in GRAPH_SETTINGS)
            first.__dict__.setdefault("graph", graphs.get(wanted) or first.graph)
            graphs[wanted] = first.graph
        if method in SEEDED and relational:
            hits = _walk_together(first, {at: grid[at] for at in batch}, method)
        else:
            hits = None
            for at in batch:
                one = METHODS[method](with_settings(first, **grid[at])).select(F.lit(at).alias("config"), "qid", "rank", "doc_idx", "score")
                hits = one if hits is None else hits.unionByName(one)
        out = hits if out is None else out.unionByName(hits)
    return out


def _walk_together(engine: Engine, settings: dict[int, dict], method: str) -> DataFrame:
    """One walk for settings that differ only in ``PER_QUESTION``: questions are keyed (config, qid)."""
    if method != "graph":
        engine.bm25_hits()  # stored once, for all settings
    seeds, alphas = None, []
    for at, setting in settings.items():
        one = with_settings(engine, **setting)
        alphas += [F.lit(at), F.lit(float(one.settings.alpha))]
        rows = SEEDED[method](one).select(F.struct(F.lit(at).alias("config"), "qid").alias("qid"), "node", "s")
        seeds = rows if seeds is None else seeds.unionByName(rows)
    seeds = stored(seeds, "seeds")
    configs = F.explode(F.array(*[F.lit(at) for at in settings])).alias("config")
    queries = engine.corpus.queries.select("qid", configs).select(F.struct("config", "qid").alias("qid"))
    alpha = F.element_at(F.create_map(*alphas), F.col("qid.config"))
    r = ppr.power_iteration(engine.graph.edges, seeds, alpha, engine.settings.max_iter, seeds_stored=True)
    ranked = ppr.ranked_documents(r, engine.graph, queries, seeds, engine.k)
    return ranked.select("qid.config", "qid.qid", "rank", "doc_idx", "score")


def sweep(engine: Engine, grid: list[dict], method: str = "graph") -> DataFrame:
    """Metrics of one method for each setting of a grid, keyed by the settings, which all name the same parameters.

    Rankings are stored once and scored in one plan.
    """
    names = list(grid[0])
    if any(set(setting) != set(names) for setting in grid):
        raise ValueError("settings of a grid must name the same parameters")
    hits = stored(sweep_rankings(engine, grid, method), "sweep").join(engine.corpus.docs.select("doc_idx", "doc_id"), "doc_idx")
    spark = engine.corpus.docs.sparkSession
    configs = spark.createDataFrame([(at,) for at in range(len(grid))], "config int")
    table = metrics.evaluate(engine.corpus.gold, hits, engine.settings.top_ks, keys=("config",), groups=configs)
    values = [F.element_at(F.array(*[F.lit(setting[name]) for setting in grid]), F.col("config") + 1).alias(name) for name in names]
    return table.select(*values, F.lit(method).alias("method"), *[c for c in table.columns if c != "config"])
