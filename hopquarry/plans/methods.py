"""The retrieval methods as one registry of plans over shared, memoised indexes.

A method is a function of an ``Engine`` that returns ``qid, rank, doc_idx,
score``.  What several methods need (tokens, BM25 hits, graphs) is built and
stored once per engine and setting; unknown names raise at once.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from ..operators import dense, fusion, graph, lexical, ppr, walk
from ..operators.linking import build_alias_map
from ..sources.corpus import Corpus
from ..storage import stored


@dataclass(frozen=True)
class Settings:
    """All parameters with their defaults."""

    top_ks: tuple[int, ...] = (1, 3, 5, 10)
    entity_normalize: str = "none"
    use_aliases: bool = False
    min_df: int = 1
    max_df_ratio: float = 1.0
    hub_penalty: float = 0.0
    hub_top_ratio: float = 0.0
    edge_cap: int | None = None
    norm: str = "row"
    term_min_df: int = 5
    term_max_df_ratio: float = 0.2
    term_norm: str = "row"
    alpha: float = 0.15
    max_iter: int = 10
    tol: float | None = None
    mode: str = "power"
    push_eps: float = 1e-4
    push_max_steps: int = 200_000
    backend: str = "relational"
    seed_docs_k: int = 5
    seed_k_bm25: int | None = None
    seed_k_dense: int | None = None
    seed_k_rrf: int | None = None
    seed_weighting: str = "raw"
    seed_temp: float = 1.0
    seed_mix_mode: str = "l1"
    seed_mix_alpha: float | None = None
    seed_entity_df_power: float = 0.0
    fallback_k: int = 1
    #: Seed fallbacks from entities as they stand in the question, unlike the graph's.
    compat_fallback: bool = False
    rrf_k: int = 60
    fusion_weight: float = 1.0
    rm3_docs: int = 10
    rm3_terms: int = 20
    rm3_orig_weight: float = 0.5
    two_step_docs: int = 10
    two_step_expand: int = 5
    two_step_terms: int = 30
    two_step_normalize: str = "simple"
    two_step_query_weight: float = 1.0
    rerank_candidates: int = 100

    def __post_init__(self):
        for name, known in (
            ("mode", ("power", "push")), ("backend", ("relational", "kernel")), ("norm", graph.NORMALIZATIONS), ("term_norm", graph.NORMALIZATIONS),
            ("seed_weighting", ppr.SEED_WEIGHTINGS), ("seed_mix_mode", ppr.MIX_MODES), ("entity_normalize", ("none", "lower", "simple")),
        ):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")


#: The settings that the graphs depend on.
GRAPH_SETTINGS = ("use_aliases", "entity_normalize", "min_df", "max_df_ratio", "hub_penalty", "hub_top_ratio", "edge_cap", "norm")
TERM_GRAPH_SETTINGS = ("term_min_df", "term_max_df_ratio", "term_norm")


@dataclass
class Engine:
    """A corpus with settings; ``doc_vectors`` (doc_idx, vec) and ``query_vectors`` (qid, vec) where dense methods are used."""

    corpus: Corpus
    settings: Settings = field(default_factory=Settings)
    doc_vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None
    scorer: Callable = dense.overlap_scorer
    #: Loads a tagger; without it, entities are found by the pattern.
    ner: Callable | None = None
    #: Seconds that parts took: ``index``, ``graph`` and ``term_graph`` once, ``seed`` and ``ppr`` for the last rank.
    times: dict[str, float] = field(default_factory=dict)

    @contextlib.contextmanager
    def timed(self, part: str) -> Iterator[None]:
        began = time.time()
        yield
        self.times[part] = time.time() - began

    @property
    def k(self) -> int:
        return max(self.settings.top_ks)

    @cached_property
    def index(self) -> lexical.LexicalIndex:
        with self.timed("index"):
            return lexical.build_index(self.corpus.docs)

    @cached_property
    def aliases(self) -> DataFrame | None:
        return build_alias_map(self.corpus.docs) if self.settings.use_aliases else None

    @cached_property
    def graph(self) -> graph.Graph:
        s = self.settings
        with self.timed("graph"):
            return graph.build_graph(
                self.corpus.docs, self.aliases, s.entity_normalize, min_df=s.min_df, max_df_ratio=s.max_df_ratio, hub_penalty=s.hub_penalty,
                hub_top_ratio=s.hub_top_ratio, edge_cap=s.edge_cap, normalization=s.norm, ner=self.ner,
            )

    @cached_property
    def term_graph(self) -> graph.Graph:
        s = self.settings
        with self.timed("term_graph"):
            return graph.build_term_graph(self.corpus.docs, s.term_min_df, s.term_max_df_ratio, s.term_norm)

    @cached_property
    def _bm25(self) -> dict[int, DataFrame]:
        return {}

    def bm25_hits(self, k: int | None = None) -> DataFrame:
        k = k or self.k
        if k not in self._bm25:
            self._bm25[k] = stored(lexical.search(self.index, lexical.query_terms(self.corpus.queries), self.corpus.queries, k), "hits")
        return self._bm25[k]

    @cached_property
    def dense_hits(self) -> DataFrame:
        if self.doc_vectors is None or self.query_vectors is None:
            raise ValueError("dense methods need doc_vectors and query_vectors")
        return dense.exact_search(self.doc_vectors, self.query_vectors, self.k)

    @cached_property
    def rrf_hits(self) -> DataFrame:
        return fusion.rrf_fuse([self.bm25_hits(), self.dense_hits], self.k, self.settings.rrf_k)

    @cached_property
    def entity_seeds(self) -> DataFrame:
        found = ppr.question_entities(self.corpus.queries, self.aliases, self.settings.entity_normalize, self.ner)
        return ppr.entity_seeds(found, self.graph.entities, self.settings.seed_entity_df_power)

    def page_rank(self, over: graph.Graph, seeds: DataFrame, k: int | None = None) -> DataFrame:
        s, k = self.settings, k or self.k
        whole = s.backend == "kernel" and (over.entities.agg(F.sum("df")).first()[0] or 0) * 2 <= ppr.WHOLE_EDGES
        by_blocks = s.mode == "power" and over.has_blocks and not whole
        if by_blocks and "blocks" not in over.__dict__:
            part = "graph" if over is self.__dict__.get("graph") else "term_graph"
            before = self.times.get(part, 0.0)
            with self.timed(part):
                over.blocks  # noqa: B018
            self.times[part] += before
        with self.timed("seed"):
            seeds = stored(seeds, "seeds")
        with self.timed("ppr"):
            if by_blocks:
                r = walk.best_documents(over.blocks, seeds, s.alpha, s.max_iter, k, s.tol)
            elif s.backend == "kernel":
                r = stored(ppr.kernel(over.edges, seeds, s.alpha, s.max_iter, s.tol, s.mode, s.push_eps, s.push_max_steps, keep=k), "vectors")
            elif s.mode == "push":
                r = ppr.forward_push(over.edges, seeds, s.alpha, s.push_eps, s.push_max_steps)
            elif s.tol is not None:
                r = ppr.converging_iteration(over.edges, seeds, s.alpha, s.max_iter, s.tol)
            else:
                r = ppr.power_iteration(over.edges, seeds, s.alpha, s.max_iter, seeds_stored=True)
        return ppr.ranked_documents(r, over, self.corpus.queries, seeds, k)

    def start(self, hits: DataFrame | None, k: int | None = None) -> DataFrame:
        """Seeds from entities and, where given, the first ``k`` hits."""
        s = self.settings
        docs = None
        if hits is not None:
            docs = ppr.doc_seeds(hits.where(F.col("rank") <= (k or s.seed_docs_k)), s.seed_weighting, s.seed_temp)
        return ppr.mix_seeds(self.entity_seeds, docs, s.seed_mix_mode, s.seed_mix_alpha)

    def seeded(self, hits: DataFrame | None, k: int | None = None) -> DataFrame:
        """Documents by PageRank from these seeds."""
        return self.page_rank(self.graph, self.start(hits, k))


def bm25(e: Engine) -> DataFrame:
    return e.bm25_hits()


def rm3(e: Engine) -> DataFrame:
    s = e.settings
    weights = lexical.rm3_weights(e.index, e.corpus.queries, e.bm25_hits(s.rm3_docs), s.rm3_docs, s.rm3_terms, s.rm3_orig_weight)
    return lexical.search(e.index, weights, e.corpus.queries, e.k)


def bm25_2step(e: Engine) -> DataFrame:
    s = e.settings
    weights = lexical.two_step_weights(
        e.index, e.corpus.queries, e.bm25_hits(s.two_step_docs), s.two_step_docs, s.two_step_expand, s.two_step_terms, s.two_step_normalize, s.two_step_query_weight
    )
    return lexical.search(e.index, weights, e.corpus.queries, e.k)


def dense_method(e: Engine) -> DataFrame:
    return e.dense_hits


def rrf(e: Engine) -> DataFrame:
    return e.rrf_hits


def rerank(e: Engine) -> DataFrame:
    return dense.rerank(e.bm25_hits(e.settings.rerank_candidates), e.corpus.docs, e.corpus.queries, e.scorer, e.k)


def rrf_rerank(e: Engine) -> DataFrame:
    """Candidates come from lists of ``max(top_ks)``, so they are twice as many at most."""
    scores = fusion.rrf_scores([e.bm25_hits(), e.dense_hits], e.settings.rrf_k)
    candidates = top_k(scores, e.settings.rerank_candidates, ties=("first",)).drop("first")
    return dense.rerank(candidates, e.corpus.docs, e.corpus.queries, e.scorer, e.k)


def entity_start(e: Engine) -> DataFrame:
    return e.start(None)


def graph_method(e: Engine) -> DataFrame:
    return e.page_rank(e.graph, entity_start(e))


def fallback_queries(e: Engine) -> DataFrame:
    """Questions without any extracted entity."""
    mode = "none" if e.settings.compat_fallback else e.settings.entity_normalize
    found = ppr.question_entities(e.corpus.queries, e.aliases, mode, e.ner)
    return e.corpus.queries.select("qid").join(found.select("qid").distinct(), "qid", "left_anti")


def fallback_start(e: Engine) -> DataFrame:
    """Entities, and for questions without any the first hits."""
    s = e.settings
    hits = e.bm25_hits().where(F.col("rank") <= max(1, s.fallback_k)).join(fallback_queries(e), "qid", "left_semi")
    found = ppr.question_entities(e.corpus.queries, e.aliases, "none" if s.compat_fallback else s.entity_normalize, e.ner)
    entity = ppr.entity_seeds(found, e.graph.entities, s.seed_entity_df_power)
    return ppr.mix_seeds(entity, ppr.doc_seeds(hits, s.seed_weighting, s.seed_temp), s.seed_mix_mode, s.seed_mix_alpha)


def graph_bm25_fallback(e: Engine) -> DataFrame:
    return e.page_rank(e.graph, fallback_start(e))


def tfidf_graph(e: Engine) -> DataFrame:
    seeds = ppr.mix_seeds(ppr.entity_seeds(ppr.question_terms(e.corpus.queries), e.term_graph.entities), None)
    return e.page_rank(e.term_graph, seeds)


def hybrid_start(e: Engine) -> DataFrame:
    return e.start(e.bm25_hits(), e.settings.seed_k_bm25)


def graph_hybrid(e: Engine) -> DataFrame:
    return e.page_rank(e.graph, hybrid_start(e))


def graph_rrf(e: Engine) -> DataFrame:
    return e.seeded(e.rrf_hits, e.settings.seed_k_rrf)


def graph_dense(e: Engine) -> DataFrame:
    return e.seeded(e.dense_hits, e.settings.seed_k_dense)


def rrf_ppr_fusion(e: Engine) -> DataFrame:
    scores = fusion.rrf_scores([e.bm25_hits(), e.dense_hits], e.settings.rrf_k)
    first = scores.select("qid", "doc_idx", "score", F.struct(F.lit(0).alias("rank"), F.col("first.list_no").alias("a"), F.col("first.rank").alias("b")).alias("place"))
    place = F.struct(F.col("rank"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    second = graph_method(e).select("qid", "doc_idx", "score", place.alias("place"))
    first = first.withColumn("place", F.struct(F.lit(0).alias("rank"), (-F.round("score", 9)).alias("s"), "place.a", "place.b"))
    second = second.withColumn("place", F.struct("place.rank", F.lit(0.0).alias("s"), "place.a", "place.b"))
    return fusion.linear_fuse(first, second, e.settings.fusion_weight, e.k)


METHODS: dict[str, Callable[[Engine], DataFrame]] = {
    "bm25": bm25, "rm3": rm3, "bm25_2step": bm25_2step, "dense": dense_method, "rrf": rrf, "rerank": rerank, "rrf_rerank": rrf_rerank,
    "graph": graph_method, "graph_bm25_fallback": graph_bm25_fallback, "tfidf_graph": tfidf_graph, "graph_hybrid": graph_hybrid,
    "graph_rrf": graph_rrf, "rrf_ppr_fusion": rrf_ppr_fusion, "graph_dense": graph_dense,
}


def retrieve(engine: Engine, methods: list[str]) -> DataFrame:
    """``method, qid, rank, doc_idx, doc_id, score`` of several methods."""
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    ids = engine.corpus.docs.select("doc_idx", "doc_id")
    out = None
    for name in methods:
        hits = METHODS[name](engine).select(F.lit(name).alias("method"), "qid", "rank", "doc_idx", "score")
        out = hits if out is None else out.unionByName(hits)
    return out.join(ids, "doc_idx")


def with_settings(engine: Engine, **changes) -> Engine:
    """The same corpus and models with other settings; what does not depend on the changed ones is kept."""
    out = Engine(engine.corpus, replace(engine.settings, **changes), engine.doc_vectors, engine.query_vectors, engine.scorer, engine.ner)
    changed = {name for name, value in changes.items() if getattr(engine.settings, name) != value}
    kept = {"index": (), "_bm25": (), "aliases": ("use_aliases",), "graph": GRAPH_SETTINGS, "term_graph": TERM_GRAPH_SETTINGS}
    for name, needs in kept.items():
        if name in engine.__dict__ and not set(needs) & changed:
            out.__dict__[name] = engine.__dict__[name]
    return out
