"""The retrieval queries: one per operator and method, each with its SQL in ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, vectors
from .operators import analysis, dense, embedding_cache, fusion, graph, lexical, linking, metrics, ppr, qa, tagging
from .oracle import _entities, _simple, hits_sql, sql
from .operators.vector_index import VectorIndex, build_index
from .plans import methods
from .sources import runs
from .sources.corpus import read_tables, sample_queries
from .storage import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SETTINGS = methods.Settings(hub_penalty=0.5, max_iter=5, term_min_df=3, term_max_df_ratio=0.1)


def query(oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def engine(spark: SparkSession, sf_dir: str, **changes) -> methods.Engine:
    """The test tables with vectors: those of ``embeddings`` stand for documents, by number, and for questions."""
    corpus = read_tables(spark, sf_dir)
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = vecs.join(corpus.queries.select("qid"), vecs["vec_id"] == F.col("qid")).select("qid", F.col("embedding").alias("vec"))
    out = methods.Engine(corpus, SETTINGS, vecs.select(F.col("vec_id").alias("doc_idx"), F.col("embedding").alias("vec")), asked)
    return methods.with_settings(out, **changes) if changes else out


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "doc_idx", F.round("score", 6).alias("score"))


# text


@query(sql("SELECT doc_idx, text FROM docs"))
def t1_normalize_whitespace(spark, sf_dir):
    return read_tables(spark, sf_dir).docs.select("doc_idx", "text")


@query(sql("SELECT doc_idx, coalesce(string_agg(term, ' '), '') AS tokens FROM (SELECT doc_idx, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS l FROM docs) CROSS JOIN LATERAL (SELECT unnest(l) AS term) GROUP BY doc_idx UNION ALL SELECT doc_idx, '' FROM docs WHERE len(regexp_extract_all(text, '[A-Za-z0-9]+')) = 0"))
def t2_tokenize(spark, sf_dir):
    return read_tables(spark, sf_dir).docs.select("doc_idx", F.array_join(text.tokenize(F.col("text")), " ").alias("tokens"))


@query(sql(f"SELECT doc_idx, {_simple('title')} AS simple, lower(trim(title)) AS low, title AS plain FROM titled"))
def t3_normalize_entity(spark, sf_dir):
    t = F.col("title")
    return read_tables(spark, sf_dir).docs.select("doc_idx", text.normalize_entity(t, "simple").alias("simple"), text.normalize_entity(t, "lower").alias("low"), text.normalize_entity(t).alias("plain"))


@query(sql(f"SELECT doc_idx, array_to_string({_entities('text')}, '|') AS entities FROM docs"))
def t4_entities(spark, sf_dir):
    return read_tables(spark, sf_dir).docs.select("doc_idx", F.array_join(text.extract_entities(F.col("text"), dedup=False), "|").alias("entities"))


@query(sql("SELECT doc_idx, count(*) AS n, string_agg(alias, '|' ORDER BY length(alias) DESC) AS aliases FROM alias_rows GROUP BY doc_idx"))
def t7_title_aliases(spark, sf_dir):
    a = text.title_aliases(F.col("title"))
    return read_tables(spark, sf_dir).docs.select("doc_idx", F.size(a).cast("long").alias("n"), F.array_join(a, "|").alias("aliases"))


TURNS = "SELECT conv_id, turn, text AS pred, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations"
NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(
    f"""WITH pairs AS (SELECT conv_id, turn, {NORM.format('pred')} AS p, {NORM.format('gold')} AS g FROM ({TURNS}) WHERE gold IS NOT NULL),
    words AS (SELECT *, list_filter(string_split(p, ' '), lambda w: w <> '') AS pw, list_filter(string_split(g, ' '), lambda w: w <> '') AS gw FROM pairs),
    pc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(pw) AS w FROM words) GROUP BY ALL),
    gc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(gw) AS w FROM words) GROUP BY ALL),
    same AS (SELECT conv_id, turn, sum(least(pc.c, gc.c)) AS same FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY ALL)
    SELECT conv_id, turn, CAST(p = g AS DOUBLE) AS em, round(CASE WHEN len(pw) = 0 AND len(gw) = 0 THEN 1.0 ELSE coalesce(2.0 * same / (len(pw) + len(gw)), 0) END, 6) AS f1
    FROM words LEFT JOIN same USING (conv_id, turn)"""
)
def t9_t10_answer_scores(spark, sf_dir):
    from pyspark.sql import Window

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("pred"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("gold"))
    return metrics.answer_scores(pairs.where("gold is not null")).select("conv_id", "turn", "em", F.round("f1", 6).alias("f1"))


@query(sql("SELECT qid, substring(string_agg(text, chr(10) ORDER BY rank), 1, 4000) AS context FROM hits JOIN docs USING (doc_idx) WHERE rank <= 5 AND text <> '' GROUP BY qid"))
def t12_context(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = e.bm25_hits().where("rank <= 5").join(e.corpus.docs, "doc_idx").where("text != ''")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return rows.groupBy("qid").agg(F.substring(F.array_join(texts, "\n"), 1, 4000).alias("context"))


ANSWERS = f"SELECT qid, question, {_entities('question')}[1] AS gold FROM qs WHERE len({_entities('question')}) > 0"


@query(sql(f"""SELECT method, avg(em) AS em, round(avg(f1), 6) AS f1, count(*) AS n FROM (
    SELECT method, qid, CAST(p = g AS DOUBLE) AS em, CASE WHEN len(pw) = 0 AND len(gw) = 0 THEN 1.0
        ELSE coalesce(2.0 * list_sum(list_transform(list_distinct(pw), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(gw, lambda y: y = x))))) / (len(pw) + len(gw)), 0) END AS f1
    FROM (SELECT method, qid, {NORM.format('pred')} AS p, {NORM.format('gold')} AS g, list_filter(string_split({NORM.format('pred')}, ' '), lambda w: w <> '') AS pw,
        list_filter(string_split({NORM.format('gold')}, ' '), lambda w: w <> '') AS gw
    FROM (SELECT method, a.qid, gold, coalesce(pred, '') AS pred FROM ({ANSWERS}) a CROSS JOIN (VALUES ('bm25'), ('rm3')) m(method) LEFT JOIN (
        SELECT method, qid, arg_min(pred, (-score, place)) AS pred FROM (
            SELECT method, qid, place, coalesce({_entities('w')}[1], '') AS pred, CASE WHEN len({_entities('w')}) = 0 THEN -1
                ELSE len(list_intersect(qw, list_distinct(string_split_regex(lower(w), '[ \n]+')))) / greatest(len(qw), 1) END AS score
            FROM (SELECT method, qid, place, substr(context, place * 750 + 1, 1000) AS w, list_filter(list_distinct(string_split(lower(question), ' ')), lambda x: x <> '') AS qw
                FROM (SELECT method, qid, question, context, unnest(range(0, CAST(greatest(0, ceil((length(context) - 1000) / 750.0)) AS BIGINT) + 1)) AS place
                    FROM (SELECT method, h.qid, substr(string_agg(substr(text, 1, 4000), chr(10) ORDER BY rank), 1, 4000) AS context
                        FROM (SELECT 'bm25' AS method, qid, doc_idx, rank FROM hits UNION ALL SELECT 'rm3', qid, doc_idx, rank FROM rm3) h JOIN docs USING (doc_idx)
                        WHERE rank <= 5 AND text <> '' GROUP BY ALL) JOIN qs USING (qid)))) GROUP BY ALL) r USING (method, qid))))
    GROUP BY method"""))
def e11_qa_eval(spark, sf_dir):
    """Stand-ins: the first entity of a question is its answer, and ``entity_reader`` reads."""
    e = engine(spark, sf_dir)
    answers = e.corpus.queries.select("qid", F.get(text.extract_entities(F.col("question")), F.lit(0)).alias("answer"))
    scored = qa.evaluate_answers(lexical_runs(e), e.corpus.docs, e.corpus.queries, answers, qa.entity_reader, names(e))
    return qa.answer_means(scored).select("method", "em", F.round("f1", 6).alias("f1"), "n")


# taggers


@query(sql(f"""SELECT doc_idx, row_number() OVER (PARTITION BY doc_idx ORDER BY min(pos)) - 1 AS place, entity FROM (
    SELECT doc_idx, pos, {_simple('entity')} AS entity FROM ment_raw WHERE length(entity) % 5 <> 0) WHERE entity <> '' GROUP BY doc_idx, entity"""))
def t5_tagged_entities(spark, sf_dir):
    docs = read_tables(spark, sf_dir).docs
    found = docs.select("doc_idx", F.posexplode(tagging.tagged_entities(F.col("text"), tagging.pattern_tagger, "simple")).alias("place", "entity"))
    return found.select("doc_idx", F.col("place").cast("long").alias("place"), "entity")


@query(sql("SELECT doc_idx, entity, count(*) AS tf FROM ment_raw WHERE length(entity) >= 2 AND length(entity) % 5 <> 0 GROUP BY ALL"))
def g1b_tagged_mentions(spark, sf_dir):
    return graph.mentions(read_tables(spark, sf_dir).docs, ner=tagging.pattern_tagger).select("doc_idx", "entity", "tf")


# the content key and the cache


T14 = """SELECT substr(sha256('model' || chr(31) || CASE WHEN count(*) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY bucket)) END), 1, 16) AS key FROM (
    SELECT place // 1000 AS bucket, sha256(string_agg(digest, '' ORDER BY place)) AS digest
    FROM (SELECT doc_idx - (SELECT min(doc_idx) FROM docs) AS place, sha256(doc_id || chr(31) || text) AS digest FROM docs) GROUP BY bucket)"""


@query(sql(T14))
def t14_content_key(spark, sf_dir):
    """One key for all documents in order; the SQL has two levels of the tree, enough for a million documents."""
    return spark.createDataFrame([(runs.content_key("model", read_tables(spark, sf_dir).docs),)], "key string")


@query(sql("SELECT count(*) AS docs, CAST(count(DISTINCT text) AS BIGINT) AS texts, true AS same FROM docs"))
def s13_embedding_cache(spark, sf_dir):
    """All documents encoded into a new cache, and read from it again with an encoder that would fail."""
    docs, path = read_tables(spark, sf_dir).docs, scratch(spark, "cache")
    first = embedding_cache.cached_encode(docs, dense.hashing_encoder(), "hashed words", path).select("doc_idx", "vec")

    def none_left(texts: list[str]):
        raise AssertionError("a text was encoded again")

    again = embedding_cache.cached_encode(docs, none_left, "hashed words", path).select("doc_idx", F.col("vec").alias("again"))
    held = embedding_cache.cached_vectors(spark, path, "hashed words").agg(F.count("*").alias("texts"))
    same = first.join(again, "doc_idx").agg(F.count("*").alias("docs"), F.bool_and(F.col("vec") == F.col("again")).alias("same"))
    return same.crossJoin(F.broadcast(held)).select("docs", "texts", "same")


# linking


@query(sql("SELECT alias_key, canonical FROM aliases"))
def a1_alias_map(spark, sf_dir):
    return linking.build_alias_map(read_tables(spark, sf_dir).docs)


@query(sql(f"SELECT doc_idx, pos, {_simple('coalesce(canonical, entity)')} AS entity FROM ment_raw LEFT JOIN aliases ON alias_key = {_simple('entity')} WHERE {_simple('coalesce(canonical, entity)')} <> ''"))
def a2_apply_alias_map(spark, sf_dir):
    docs = read_tables(spark, sf_dir).docs
    found = docs.select("doc_idx", F.posexplode(text.extract_entities(F.col("text"), dedup=False)).alias("pos", "entity"))
    return linking.apply_alias_map(found, linking.build_alias_map(docs), "simple").select("doc_idx", F.col("pos").cast("long").alias("pos"), "entity")


# lexical


@query(sql("SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs CROSS JOIN st"))
def l1_l2_terms_idf(spark, sf_dir):
    index = lexical.build_index(read_tables(spark, sf_dir).docs)
    return index.terms.crossJoin(F.broadcast(index.stats)).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(sql("SELECT doc_idx, dl, n, round(avgdl, 6) AS avgdl FROM lens CROSS JOIN st"))
def l1_lengths(spark, sf_dir):
    index = lexical.build_index(read_tables(spark, sf_dir).docs)
    return index.lengths.crossJoin(F.broadcast(index.stats)).select("doc_idx", "dl", "n", F.round("avgdl", 6).alias("avgdl"))


@query(sql("SELECT qid, term, round(weight, 6) AS weight FROM rm3w"))
def l5_rm3_weights(spark, sf_dir):
    e = engine(spark, sf_dir)
    return lexical.rm3_weights(e.index, e.corpus.queries, e.bm25_hits()).select("qid", "term", F.round("weight", 6).alias("weight"))


@query(sql("SELECT qid, term, round(weight, 6) AS weight FROM stepw"))
def l6_two_step_weights(spark, sf_dir):
    e = engine(spark, sf_dir)
    return lexical.two_step_weights(e.index, e.corpus.queries, e.bm25_hits()).select("qid", "term", F.round("weight", 6).alias("weight"))


# dense


@query("SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")
def d2_l2_normalize(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("u"), F.col("u"))), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query()
def d4_ann_search(spark, sf_dir):
    e = engine(spark, sf_dir)
    return shown(dense.ann_search(e.doc_vectors, e.query_vectors, 10))


@query(hits_sql("dense"))
def s14_stored_index(spark, sf_dir):
    """The index of all vectors, written, opened again and searched: in all lists and with a thousand candidates, so answers are the exact ones."""
    e, path = engine(spark, sf_dir), scratch(spark, "index")
    build_index(e.doc_vectors, path)
    index = VectorIndex.open(spark, path)
    return shown(index.search(e.query_vectors, 10, probes=len(index.codes.centres), depth=1000))


@query()
def d1_encoded_search(spark, sf_dir):
    e = engine(spark, sf_dir)
    encoder = dense.hashing_encoder()
    docs = dense.encode(e.corpus.docs, encoder).select("doc_idx", "vec")
    asked = dense.encode(e.corpus.queries, encoder, "question").select("qid", "vec")
    return shown(dense.exact_search(docs, asked, 10))


# fusion


@query(sql("SELECT qid, doc_idx, round(score, 6) AS score FROM rrf_scores"))
def f2_rrf_scores(spark, sf_dir):
    e = engine(spark, sf_dir)
    return fusion.rrf_scores([e.bm25_hits(), e.dense_hits]).select("qid", "doc_idx", F.round("score", 6).alias("score"))


@query(sql("SELECT qid, doc_idx, round(CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE score END, 6) AS score FROM hits"))
def f3_normalize_scores(spark, sf_dir):
    return fusion.normalize_scores(engine(spark, sf_dir).bm25_hits()).select("qid", "doc_idx", F.round("score", 6).alias("score"))


# graph


@query(sql("SELECT doc_idx, entity, tf, pos FROM ment"))
def g1_mentions(spark, sf_dir):
    return graph.mentions(read_tables(spark, sf_dir).docs).select("doc_idx", "entity", "tf", F.col("pos").cast("long").alias("pos"))


def _entities_query(name: str, cte: str, **options):
    @query(sql(f"SELECT entity, df, ent_idx FROM {cte}_ent"))
    def run(spark, sf_dir):
        docs = read_tables(spark, sf_dir).docs
        return graph.entity_table(graph.mentions(docs), docs, **options).select("entity", "df", F.col("ent_idx").cast("long").alias("ent_idx"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_entities_query("g2_df_window", "gwin", min_df=2, max_df_ratio=0.1)
_entities_query("g3_hub_pruning", "ghub", hub_top_ratio=0.01)


def _edges_query(name: str, cte: str, **options):
    @query(sql(f"SELECT src, dst, round(p, 6) AS p FROM {cte}_edges"))
    def run(spark, sf_dir):
        edges = graph.build_graph(read_tables(spark, sf_dir).docs, **options).edges
        return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("p", 6).alias("p"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_edges_query("g4_g5_g7a_row_transition", "g", hub_penalty=0.5)
_edges_query("g7b_sym_transition", "gsym", hub_penalty=0.5, normalization="sym")
_edges_query("g7c_raw_transition", "gnone", normalization="none")
_edges_query("g6_edge_cap", "gcap", edge_cap=3)


@query(sql("SELECT src, dst, round(p, 6) AS p FROM gt_edges"))
def g8_term_graph(spark, sf_dir):
    edges = graph.build_term_graph(read_tables(spark, sf_dir).docs, 3, 0.1).edges
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("p", 6).alias("p"))


@query(
    sql(
        """SELECT count(*) + (SELECT count(*) FROM docs) AS nodes, count(*) AS entities, (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM g_pairs) AS edges,
        round(avg(deg), 6) AS entity_avg, round(quantile_cont(deg, 0.95), 6) AS entity_p95, max(deg) AS entity_max,
        (SELECT round(avg(d), 6) FROM (SELECT count(ent_idx) AS d FROM docs LEFT JOIN g_pairs USING (doc_idx) GROUP BY doc_idx)) AS doc_avg,
        (SELECT round(quantile_cont(d, 0.95), 6) FROM (SELECT count(ent_idx) AS d FROM docs LEFT JOIN g_pairs USING (doc_idx) GROUP BY doc_idx)) AS doc_p95,
        (SELECT max(d) FROM (SELECT count(ent_idx) AS d FROM docs LEFT JOIN g_pairs USING (doc_idx) GROUP BY doc_idx)) AS doc_max
        FROM (SELECT ent_idx, count(doc_idx) AS deg FROM g_ent LEFT JOIN g_pairs USING (ent_idx) GROUP BY ent_idx)"""
    )
)
def g9_graph_stats(spark, sf_dir):
    stats = graph.graph_stats(engine(spark, sf_dir).graph)
    rounded = [F.round(f"{n}_{v}", 6).alias(f"{n}_{v}") for n in ("entity", "doc") for v in ("avg", "p95")]
    return stats.select("nodes", "entities", "docs", "edges", "entity_max", "doc_max", *rounded)


# seeds


@query(sql("SELECT qid, node, round(s, 6) AS s FROM es_df"))
def p1_p2_entity_seeds(spark, sf_dir):
    seeds = engine(spark, sf_dir, seed_entity_df_power=0.5).entity_seeds
    return seeds.select("qid", F.col("node").cast("long").alias("node"), F.round("s", 6).alias("s"))


def _doc_seeds_query(weighting: str):
    name = f"p3_doc_seeds_{weighting}"

    @query(sql(f"SELECT qid, node, round(s, 6) AS s FROM ds_{weighting}"))
    def run(spark, sf_dir):
        hits = engine(spark, sf_dir).bm25_hits().where("rank <= 5")
        return ppr.doc_seeds(hits, weighting).select("qid", "node", F.round("s", 6).alias("s"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


def _mix_query(mode: str):
    name = f"p5_mix_{mode}"

    @query(sql(f"SELECT qid, node, round(s, 6) AS s FROM s_{mode}"))
    def run(spark, sf_dir):
        e = engine(spark, sf_dir, seed_entity_df_power=0.5)
        docs = ppr.doc_seeds(e.bm25_hits().where("rank <= 5"), "rank")
        return ppr.mix_seeds(e.entity_seeds, docs, mode).select("qid", F.col("node").cast("long").alias("node"), F.round("s", 6).alias("s"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _weighting in ppr.SEED_WEIGHTINGS:
    _doc_seeds_query(_weighting)
for _mode in ppr.MIX_MODES:
    _mix_query(_mode)


@query(hits_sql("m_push"))
def p8_push(spark, sf_dir):
    return shown(methods.METHODS["graph"](engine(spark, sf_dir, mode="push")))


@query(hits_sql("m_graph"))
def p7_kernel(spark, sf_dir):
    return shown(methods.METHODS["graph"](engine(spark, sf_dir, backend="kernel")))


@query(hits_sql("m_tol"))
def p7_tolerance(spark, sf_dir):
    return shown(methods.METHODS["graph"](engine(spark, sf_dir, tol=1e-4)))


@query(hits_sql("m_tol_early"))
def p7_tolerance_early(spark, sf_dir):
    return shown(methods.METHODS["graph"](engine(spark, sf_dir, tol=0.4)))


# methods


def _method_query(name: str, method: str, cte: str | None):
    @query(hits_sql(cte) if cte else None)
    def run(spark, sf_dir):
        return shown(methods.METHODS[method](engine(spark, sf_dir)))

    QUERIES[name] = QUERIES.pop("run")
    if cte:
        ORACLE_SQL[name] = ORACLE_SQL.pop("run")


for _name, _method, _cte in (
    ("m1_bm25", "bm25", "hits"), ("m2_rm3", "rm3", "rm3"), ("m3_bm25_2step", "bm25_2step", "step"), ("m4_dense", "dense", "dense"),
    ("m5_rrf", "rrf", "rrf"), ("m6_rerank", "rerank", "rerank"), ("m7_rrf_rerank", "rrf_rerank", "rrf_rerank"), ("m8_graph", "graph", "m_graph"),
    ("m9_graph_bm25_fallback", "graph_bm25_fallback", "m_fallback"), ("m10_tfidf_graph", "tfidf_graph", "m_term"),
    ("m11_graph_hybrid", "graph_hybrid", "m_hybrid"), ("m12_graph_rrf", "graph_rrf", "m_rrf"), ("m13_rrf_ppr_fusion", "rrf_ppr_fusion", "m_fusion"),
    ("m14_graph_dense", "graph_dense", "m_dense"),
):
    _method_query(_name, _method, _cte)


# evaluation and analysis


LEXICAL = ["bm25", "rm3"]


def lexical_runs(e: methods.Engine) -> DataFrame:
    return methods.retrieve(e, LEXICAL)


def names(e: methods.Engine) -> DataFrame:
    return e.corpus.docs.sparkSession.createDataFrame([(m,) for m in LEXICAL], "method string")


BOTH = "(SELECT 'bm25' AS method, * FROM {0} UNION ALL SELECT 'rm3' AS method, * FROM {0}_rm3)"
MEANS = ", ".join(f"round(avg({n}_{k}), 6) AS {n}_{k}" for n in ("hit", "recall") for k in (1, 3, 5, 10))


@query(sql(f"SELECT method, count(*) AS n, round(avg(rr), 6) AS mrr, {MEANS} FROM {BOTH.format('sc')} GROUP BY method"))
def e1_metrics(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = metrics.evaluate(e.corpus.gold, lexical_runs(e), keys=("method",), groups=names(e))
    return rows.select("method", "n", *[F.round(c, 6).alias(c) for c in rows.columns if c not in ("method", "n")])


@query(
    """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(l[CAST(least(count(*) - 1, round_even(0.5 * (count(*) - 1), 0)) AS BIGINT) + 1], 6) AS p50,
    round(l[CAST(least(count(*) - 1, round_even(0.95 * (count(*) - 1), 0)) AS BIGINT) + 1], 6) AS p95, round(l[CAST(least(count(*) - 1, round_even(0.99 * (count(*) - 1), 0)) AS BIGINT) + 1], 6) AS p99
    FROM (SELECT event_type, value, list(value ORDER BY value) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events WHERE value IS NOT NULL) GROUP BY event_type, l"""
)
def e2_latency(spark, sf_dir):
    rows = metrics.latency_stats(spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null"), "value", "event_type")
    return rows.select("event_type", "n", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query(sql("SELECT round(avg(c), 6) AS mean, list_sort(list(c))[CAST(least(count(*) - 1, round_even(0.5 * (count(*) - 1), 0)) AS BIGINT) + 1] AS p50, list_sort(list(c))[CAST(least(count(*) - 1, round_even(0.95 * (count(*) - 1), 0)) AS BIGINT) + 1] AS p95 FROM (SELECT qid, count(entity) AS c FROM qs LEFT JOIN qent USING (qid) GROUP BY qid)"))
def e4_entity_counts(spark, sf_dir):
    e = engine(spark, sf_dir)
    found = ppr.question_entities(e.corpus.queries).groupBy("qid").agg(F.count("*").alias("c"))
    counts = e.corpus.queries.select("qid").join(found, "qid", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    return metrics.latency_stats(counts, "c").select(F.round("mean", 6).alias("mean"), "p50", "p95")


E6 = """(SELECT q.qid, CASE WHEN n IS NULL THEN 'no_entity' WHEN m.qid IS NOT NULL THEN 'entity_gold' ELSE 'entity_no_gold' END AS bucket FROM qs q
    LEFT JOIN (SELECT qid, count(*) AS n FROM qent GROUP BY qid) c ON c.qid = q.qid
    LEFT JOIN (SELECT DISTINCT e.qid FROM qent e JOIN gold g ON g.qid = e.qid JOIN titled t ON t.doc_idx = g.doc_idx AND regexp_replace(t.title, ' \\([^)]*\\)$', '') = e.entity) m ON m.qid = q.qid)"""


@query(sql(f"SELECT bucket, method, count(*) AS count, round(avg(recall_10), 6) AS recall, round(avg(hit_10), 6) AS hit, round(avg(rr), 6) AS mrr, round(count(*) / (SELECT count(*) FROM qs), 6) AS rate FROM {BOTH.format('sc')} JOIN {E6} USING (qid) GROUP BY ALL"))
def e5_e6_bucket_metrics(spark, sf_dir):
    e = engine(spark, sf_dir)
    titles = e.corpus.gold.join(e.corpus.docs.select("doc_idx", F.regexp_replace("title", r" \([^)]*\)$", "").alias("title")), "doc_idx").select("qid", "title")
    buckets = analysis.entity_buckets(e.corpus.queries, titles, ppr.question_entities(e.corpus.queries))
    rows = analysis.bucket_metrics(buckets, e.corpus.gold, lexical_runs(e), groups=names(e))
    return rows.select("bucket", "method", "count", *[F.round(c, 6).alias(c) for c in ("recall", "hit", "mrr", "rate")])


@query(sql(f"SELECT method, qid, round(rr, 6) AS rr, hit_10, round(recall_10, 6) AS recall_10 FROM {BOTH.format('sc10')}"))
def e7_per_query(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = metrics.per_query(e.corpus.gold, lexical_runs(e), (10,), cut_rr=10, keys=("method",), groups=names(e))
    return rows.select("method", "qid", F.round("rr", 6).alias("rr"), "hit_10", F.round("recall_10", 6).alias("recall_10"))


@query()
def e8_bootstrap(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = metrics.per_query(e.corpus.gold, lexical_runs(e), (10,), cut_rr=10, keys=("method",), groups=names(e))
    return metrics.bootstrap(metrics.paired(rows, "rr"), 1000)


@query(sql(f"SELECT a.method AS baseline, b.method AS method, round(avg(b.rr - a.rr), 6) AS mean_diff, count(*) FILTER (b.rr > a.rr) AS wins, count(*) FILTER (b.rr = a.rr) AS ties, count(*) FILTER (b.rr < a.rr) AS losses, count(*) AS n FROM {BOTH.format('sc10')} a JOIN {BOTH.format('sc10')} b ON a.qid = b.qid AND a.method <> b.method GROUP BY ALL"))
def e9_comparison(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = metrics.compare_methods(metrics.per_query(e.corpus.gold, lexical_runs(e), (10,), cut_rr=10, keys=("method",), groups=names(e)), "rr")
    return rows.withColumn("mean_diff", F.round("mean_diff", 6))


HUBS = "(SELECT entity FROM g_df ORDER BY df DESC, f LIMIT (SELECT CAST(floor(count(*) * 0.01) AS BIGINT) FROM g_df))"
GOLD_TITLES = "(SELECT g.qid, regexp_replace(t.title, ' \\([^)]*\\)$', '') AS entity FROM gold g JOIN titled t USING (doc_idx))"


@query(sql(f"""SELECT (SELECT count(*) FROM g_df) AS entities_total, (SELECT count(*) FROM g_df) AS entities_filtered, (SELECT count(*) FROM {HUBS}) AS entities_removed,
    count(DISTINCT entity) AS gold_titles, count(DISTINCT entity) FILTER (entity IN {HUBS}) AS gold_titles_removed,
    count(DISTINCT entity) FILTER (entity NOT IN {HUBS} AND entity IN (SELECT entity FROM g_df)) AS gold_titles_kept, count(DISTINCT qid) FILTER (entity IN {HUBS}) AS queries_affected,
    round(count(DISTINCT entity) FILTER (entity IN {HUBS}) / greatest(count(DISTINCT entity), 1), 6) AS gold_removed_rate FROM {GOLD_TITLES}"""))
def e10_hub_coverage(spark, sf_dir):
    e = engine(spark, sf_dir)
    titles = e.corpus.gold.join(e.corpus.docs.select("doc_idx", F.regexp_replace("title", r" \([^)]*\)$", "").alias("title")), "doc_idx").select("qid", "title")
    return analysis.hub_coverage(e.corpus.docs, titles).withColumn("gold_removed_rate", F.round("gold_removed_rate", 6))


@query()
def e12_without_tuning(spark, sf_dir):
    e = engine(spark, sf_dir)
    return analysis.without_tuning(e.corpus.queries, e.corpus.gold, lexical_runs(e), n=5)


@query("SELECT o_orderstatus AS dataset, o_orderpriority AS method, round(median(o_totalprice / o_custkey * 1000), 4) AS ms_median, round(min(o_totalprice / o_custkey * 1000), 4) AS ms_min, round(max(o_totalprice / o_custkey * 1000), 4) AS ms_max FROM orders WHERE o_custkey > 0 GROUP BY ALL")
def e13_doc_costs(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = orders.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("index_time_sec"), F.col("o_custkey").alias("docs"))
    rows = analysis.doc_costs(runs)
    return rows.select("dataset", "method", *[F.round(c, 4).alias(c) for c in ("ms_median", "ms_min", "ms_max")])


@query(sql(f"SELECT method, round(avg(recall_1), 6) AS \"1\", round(avg(recall_5), 6) AS \"5\", round(avg(recall_10), 6) AS \"10\" FROM {BOTH.format('sc')} GROUP BY method"))
def e14_pivot(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = metrics.evaluate(e.corpus.gold, lexical_runs(e), keys=("method",), groups=names(e))
    long = rows.select("method", F.explode(F.map_from_arrays(F.array(F.lit(1), F.lit(5), F.lit(10)), F.array("recall_1", "recall_5", "recall_10"))).alias("k", "value"))
    return analysis.pivot_metrics(long.withColumn("value", F.round("value", 6)), ["method"], (1, 5, 10))


@query("SELECT dataset, method, run_dir, run_mtime FROM (SELECT event_type AS dataset, user_id AS method, event_id AS run_dir, event_id AS run_mtime, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS place FROM events) WHERE place = 1")
def r5_latest(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = events.select(F.col("event_type").alias("dataset"), F.col("user_id").alias("method"), F.col("event_id").alias("run_dir"), F.col("event_id").alias("run_mtime"))
    return analysis.latest(runs)


@query("SELECT event_type AS a, max(value) AS \"recall@10\" FROM events WHERE value IS NOT NULL GROUP BY event_type")
def e16_maxima(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("a"), F.col("value").alias("recall@10"))
    return analysis.maxima(rows, ["a"])


@query(sql("SELECT count(*) AS fallback_count, round(count(*) / greatest(1, (SELECT count(*) FROM qs)), 6) AS fallback_rate FROM qs ANTI JOIN qent USING (qid)"))
def e17_fallback_rate(spark, sf_dir):
    e = engine(spark, sf_dir)
    total = e.corpus.queries.agg(F.count("*").alias("n"))
    rows = methods.fallback_queries(e).agg(F.count("*").alias("fallback_count")).crossJoin(F.broadcast(total))
    return rows.select("fallback_count", F.round(F.col("fallback_count") / F.greatest("n", F.lit(1)), 6).alias("fallback_rate"))


@query(sql("SELECT method, qid, CAST(rank AS BIGINT) AS rank, doc_idx FROM (SELECT 'bm25' AS method, qid, rank, doc_idx FROM rm3 UNION ALL SELECT 'rm3', qid, rank, doc_idx FROM rm3)"))
def u1_merge_runs(spark, sf_dir):
    e = engine(spark, sf_dir)
    first = lexical_runs(e).withColumn("run", F.lit(0))
    second = first.where("method = 'rm3'").withColumn("method", F.lit("bm25")).withColumn("run", F.lit(1))
    merged = analysis.merge_runs(first.unionByName(second))
    return merged.select("method", "qid", F.col("rank").cast("long").alias("rank"), "doc_idx")


@query()
def s12_sample(spark, sf_dir):
    return sample_queries(read_tables(spark, sf_dir).queries, 10)
