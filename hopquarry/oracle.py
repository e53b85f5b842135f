"""DuckDB SQL for the retrieval queries, put together from named table expressions."""

from __future__ import annotations

import re

ENT = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b"


def _entities(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace({text}, '[^\x00-\x7F]', '_', 'g'), '{ENT}')"


def _simple(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim({text})), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


#: Table expressions; each may use the others by name.
CTES: dict[str, str] = {
    "docs": r"""SELECT doc_id AS doc_idx, CAST(doc_id AS VARCHAR) AS doc_id, lang, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f]+', ' ', 'g')) AS text FROM documents""",
    "qs": r"""SELECT item_id AS qid, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f]+', ' ', 'g')) AS question FROM benchmark""",
    "gold": "SELECT qid, doc_idx, doc_id FROM docs JOIN qs ON contains(docs.text, qs.question)",
    "titled": f"SELECT doc_idx, doc_id, coalesce({_entities('text')}[1], 'Untitled') || ' (' || lang || ')' AS title FROM docs",
    "toks": "SELECT doc_idx, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM docs",
    "postings": "SELECT term, doc_idx, count(*) AS tf FROM toks GROUP BY ALL",
    "lens": "SELECT d.doc_idx, count(t.term) AS dl FROM docs d LEFT JOIN toks t USING (doc_idx) GROUP BY ALL",
    "dfs": "SELECT term, count(*) AS df FROM postings GROUP BY ALL",
    "st": "SELECT count(*) AS n, sum(dl) / greatest(count(*), 1) AS avgdl FROM lens",
    "qtoks": "SELECT qid, unnest(list_transform(regexp_extract_all(question, '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM qs",
    "qw": "SELECT qid, term, CAST(count(*) AS DOUBLE) AS weight FROM qtoks GROUP BY ALL",
    "ment_raw": f"SELECT doc_idx, unnest(l) AS entity, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_idx, {_entities('text')} AS l FROM docs)",
    "ment": "SELECT doc_idx, entity, count(*) AS tf, min(pos) AS pos FROM ment_raw WHERE length(entity) >= 2 GROUP BY ALL",
    "tment": """SELECT doc_idx, entity, count(*) AS tf, min(pos) AS pos FROM (SELECT doc_idx, unnest(l) AS entity, generate_subscripts(l, 1) - 1 AS pos
        FROM (SELECT doc_idx, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS l FROM docs)) GROUP BY ALL""",
    "qent": f"SELECT qid, unnest(list_distinct({_entities('question')})) AS entity FROM qs",
    "dvec": "SELECT vec_id AS doc_idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "qvec": "SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings JOIN benchmark ON vec_id = item_id",
    "dense_all": "SELECT qid, doc_idx, list_inner_product(q.vec, d.vec) AS score FROM qvec q CROSS JOIN dvec d",
    "dense": "SELECT * FROM (SELECT qid, doc_idx, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM dense_all) WHERE rank <= 10",
    "alias_rows": rf"""SELECT title, doc_idx, unnest(CASE WHEN bare <> '' AND bare <> title THEN [title, bare] ELSE [title] END) AS alias
        FROM (SELECT title, doc_idx, trim(regexp_replace(title, '\s*\([^)]*\)\s*$', '')) AS bare FROM titled)""",
    "aliases": f"SELECT alias_key, min(title) AS canonical FROM (SELECT {_simple('alias')} AS alias_key, title FROM alias_rows) WHERE alias_key <> '' GROUP BY alias_key HAVING count(*) = 1",
}


def bm25(name: str, weights: str, k: int) -> None:
    """Hits of weighted questions, padded: table expression ``name`` (qid, rank, doc_idx, score)."""
    CTES[f"{name}_scored"] = f"""SELECT qid, doc_idx, sum(w.weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 /
        (tf + 1.5 * (0.25 + 0.75 * dl / (avgdl + 1e-9)) + 1e-9)) AS score
        FROM {weights} w JOIN postings USING (term) JOIN dfs USING (term) JOIN lens USING (doc_idx) CROSS JOIN st WHERE weight <> 0 GROUP BY ALL"""
    padded(name, f"{name}_scored", "qs", k)


def padded(name: str, scored: str, queries: str, k: int) -> None:
    CTES[name] = f"""SELECT * FROM (SELECT qid, doc_idx, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM (
        SELECT qid, doc_idx, max(score) AS score FROM (SELECT qid, doc_idx, score FROM {scored} UNION ALL
        SELECT qid, doc_idx, 0 FROM {queries} CROSS JOIN (SELECT doc_idx FROM docs ORDER BY doc_idx LIMIT {k})) GROUP BY ALL)) WHERE rank <= {k}"""


def graph(name: str, mentions: str = "ment", min_df: int = 1, ratio: float = 1.0, penalty: float = 0.0, hubs: float = 0.0, cap: int = 0, norm: str = "row") -> None:
    """Expressions ``name_ent`` (entity, df, ent_idx), ``name_pairs`` and ``name_edges`` (src, dst, p)."""
    CTES[f"{name}_df"] = f"""SELECT entity, count(*) AS df, min((doc_idx, pos)) AS f FROM {mentions} GROUP BY entity
        HAVING count(*) BETWEEN {min_df} AND (SELECT greatest(1, floor({ratio} * greatest(1, count(*)))) FROM docs)"""
    CTES[f"{name}_ent"] = f"""SELECT entity, df, row_number() OVER (ORDER BY f) - 1 AS ent_idx FROM (SELECT *, row_number() OVER (ORDER BY df DESC, f) AS hub
        FROM {name}_df) WHERE hub > floor((SELECT count(*) FROM {name}_df) * {hubs})"""
    capped = f"QUALIFY row_number() OVER (PARTITION BY ent_idx ORDER BY round(w, 9) DESC, doc_idx) <= {cap}" if cap else ""
    back = f"pow(df + 1e-9, -{penalty})" if penalty else "1.0"
    CTES[f"{name}_pairs"] = f"""SELECT ent_idx, doc_idx, w, w * hub AS back FROM (SELECT ent_idx, doc_idx, tf * (ln((n + 1.0) / (df + 1)) + 1) AS w, {back} AS hub
        FROM {mentions} JOIN {name}_ent USING (entity) CROSS JOIN (SELECT greatest(1, count(*)) AS n FROM docs)) {capped}"""
    CTES[f"{name}_adj"] = f"SELECT -1 - ent_idx AS src, doc_idx AS dst, w AS p FROM {name}_pairs UNION ALL SELECT doc_idx, -1 - ent_idx, back FROM {name}_pairs"
    table = f"{name}_adj"
    if norm == "sym":
        CTES[f"{name}_deg"] = f"SELECT src AS node, sum(p) AS deg FROM {name}_adj GROUP BY src"
        CTES[f"{name}_sym"] = f"SELECT src, dst, p / sqrt(a.deg) / sqrt(b.deg) AS p FROM {name}_adj JOIN {name}_deg a ON a.node = src JOIN {name}_deg b ON b.node = dst"
        table = f"{name}_sym"
    CTES[f"{name}_edges"] = f"SELECT src, dst, p FROM {table}" if norm == "none" else f"SELECT src, dst, p / sum(p) OVER (PARTITION BY src) AS p FROM {table}"


def entity_seeds(name: str, over: str, found: str = "qent", power: float = 0.0) -> None:
    weight = f"pow(greatest(1, df), -{power})" if power else "1.0"
    CTES[name] = f"SELECT qid, -1 - ent_idx AS node, max({weight}) AS s FROM {found} JOIN {over}_ent USING (entity) GROUP BY ALL"


def doc_seeds(name: str, hits: str, k: int, weighting: str = "raw") -> None:
    weight = {"rank": "1.0 / rank", "softmax": "exp(greatest(score, 0) - max(greatest(score, 0)) OVER w)", "raw": "CASE WHEN sum(greatest(score, 0)) OVER w > 0 THEN greatest(score, 0) ELSE 1 END"}[weighting]
    CTES[name] = f"SELECT qid, doc_idx AS node, {weight} AS s FROM {hits} WHERE rank <= {k} WINDOW w AS (PARTITION BY qid)"


def mix(name: str, entity: str, doc: str | None, mode: str = "l1") -> None:
    both = f"SELECT *, 1 AS e FROM {entity}" + (f" UNION ALL SELECT *, 0 AS e FROM {doc}" if doc else "")
    if mode == "l1" or not doc:
        CTES[name] = f"SELECT qid, node, sum(s) AS s FROM (SELECT qid, node, s / sum(s) OVER (PARTITION BY qid) AS s FROM ({both})) WHERE s > 0 GROUP BY ALL"
        return
    m = "0.5" if mode == "fixed" else "(ne + 1.0) / (ne + nd + 2.0)"
    CTES[name] = f"""SELECT qid, node, sum(s) AS s FROM (SELECT qid, node, CASE WHEN se <= 0 OR sd <= 0 THEN 1 WHEN e = 1 THEN {m} ELSE 1 - {m} END * s /
        CASE WHEN e = 1 THEN se ELSE sd END AS s FROM (SELECT *, sum(CASE WHEN e = 1 THEN s ELSE 0 END) OVER w AS se, sum(CASE WHEN e = 0 THEN s ELSE 0 END) OVER w AS sd,
        count(*) FILTER (e = 1 AND s > 0) OVER w AS ne, count(*) FILTER (e = 0 AND s > 0) OVER w AS nd FROM ({both}) WINDOW w AS (PARTITION BY qid))) WHERE s > 0 GROUP BY ALL"""


def page_rank(name: str, over: str, seeds: str, k: int = 10, alpha: float = 0.15, rounds: int = 5) -> None:
    """Hits by so many rounds, with padding, and uniform ones for questions without seeds."""
    CTES[f"{name}_r0"] = f"SELECT qid, node, s AS v FROM {seeds}"
    for i in range(rounds):
        CTES[f"{name}_r{i + 1}"] = f"""SELECT qid, node, sum(v) AS v FROM (SELECT r.qid, e.dst AS node, (1 - {alpha}) * r.v * e.p AS v FROM {name}_r{i} r JOIN {over}_edges e ON r.node = e.src
            UNION ALL SELECT qid, node, {alpha} * s FROM {seeds}) GROUP BY ALL"""
    ranked_documents(name, f"{name}_r{rounds}", seeds, k)


def converging_page_rank(name: str, over: str, seeds: str, tol: float, k: int = 10, rounds: int = 5) -> None:
    """The same, but each question stops at its first round that moves the vector by less than ``tol``."""
    page_rank(name, over, seeds, k, rounds=rounds)
    for i in range(1, rounds + 1):
        CTES[f"{name}_m{i}"] = f"""SELECT qid, {i} AS round, sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS moved FROM {name}_r{i} a FULL JOIN {name}_r{i - 1} b USING (qid, node) GROUP BY qid"""
    moves = " UNION ALL ".join(f"SELECT * FROM {name}_m{i}" for i in range(1, rounds + 1))
    CTES[f"{name}_stop"] = f"SELECT qid, coalesce(min(round) FILTER (moved < {tol}), {rounds}) AS round FROM ({moves}) GROUP BY qid"
    CTES[f"{name}_all"] = " UNION ALL ".join(f"SELECT qid, node, v FROM {name}_r{i} SEMI JOIN (SELECT qid FROM {name}_stop WHERE round = {i}) USING (qid)" for i in range(1, rounds + 1))
    ranked_documents(name, f"{name}_all", seeds, k)


def pushed(name: str, over: str, seeds: str, eps: float, k: int = 10, alpha: float = 0.15, rounds: int = 80) -> None:
    """Estimates by pushes in rounds; rounds without a rest above ``eps`` change nothing."""
    CTES[f"{name}_p0"] = f"SELECT qid, node, CAST(0 AS DOUBLE) AS v, CAST(s AS DOUBLE) AS rest FROM {seeds}"
    for i in range(rounds):
        at = f"{name}_p{i}"
        CTES[f"{name}_p{i + 1}"] = f"""SELECT qid, node, sum(v) AS v, sum(rest) AS rest FROM (
            SELECT qid, node, v + CASE WHEN rest > {eps} THEN {alpha} * rest ELSE 0 END AS v, CASE WHEN rest > {eps} THEN 0 ELSE rest END AS rest FROM {at}
            UNION ALL SELECT qid, e.dst, 0, (1 - {alpha}) * rest * e.p FROM {at} JOIN {over}_edges e ON node = e.src WHERE rest > {eps}) GROUP BY ALL"""
    CTES[f"{name}_end"] = f"SELECT qid, node, v FROM {name}_p{rounds} WHERE v > 0"
    ranked_documents(name, f"{name}_end", seeds, k)


def ranked_documents(name: str, vectors: str, seeds: str, k: int) -> None:
    CTES[f"{name}_docs"] = f"SELECT qid, node AS doc_idx, v AS score FROM {vectors} WHERE node >= 0"
    CTES[f"{name}_seeded"] = f"SELECT DISTINCT qid FROM {seeds} JOIN qs USING (qid)"
    padded(f"{name}_top", f"{name}_docs", f"{name}_seeded", k)
    CTES[name] = f"""SELECT qid, doc_idx, score, rank FROM {name}_top UNION ALL SELECT qid, doc_idx, 1.0 / (SELECT count(*) FROM docs), row_number() OVER (PARTITION BY qid ORDER BY doc_idx)
        FROM qs ANTI JOIN {seeds} USING (qid) CROSS JOIN (SELECT doc_idx FROM docs ORDER BY doc_idx LIMIT {k})"""


def fused(name: str, first: str, second: str) -> None:
    CTES[f"{name}_scores"] = f"""SELECT qid, doc_idx, sum(1.0 / (60 + rank)) AS score, min((l, rank)) AS f FROM (SELECT qid, doc_idx, rank, 0 AS l FROM {first}
        UNION ALL SELECT qid, doc_idx, rank, 1 FROM {second}) GROUP BY ALL"""
    CTES[name] = f"SELECT * FROM (SELECT qid, doc_idx, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, f) AS rank FROM {name}_scores) WHERE rank <= 10"


def reranked(name: str, candidates: str, k: int = 10) -> None:
    """Candidates by the share of the question's words that the text has; ties keep their rank."""
    CTES[name] = f"""SELECT * FROM (SELECT qid, doc_idx, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, before) AS rank FROM (
        SELECT qid, doc_idx, c.rank AS before, len(list_intersect(w, string_split(lower(text), ' '))) / greatest(len(w), 1) AS score FROM {candidates} c JOIN docs USING (doc_idx)
        JOIN (SELECT qid, list_filter(list_distinct(string_split(lower(question), ' ')), lambda x: x <> '') AS w FROM qs) USING (qid))) WHERE rank <= {k}"""


def scores(name: str, hits: str, gold: str = "gold", ks: tuple[int, ...] = (1, 3, 5, 10), cut: int | None = None) -> None:
    """Per question with gold: rr, hit_k and recall_k."""
    columns = ", ".join(f"CAST(count(*) FILTER (rank <= {k}) > 0 AS DOUBLE) AS hit_{k}, count(*) FILTER (rank <= {k}) / count(*) AS recall_{k}" for k in ks)
    rr = "coalesce(1.0 / min(rank), 0)" if cut is None else f"CASE WHEN min(rank) <= {cut} THEN 1.0 / min(rank) ELSE 0 END"
    CTES[name] = f"SELECT g.qid, {rr} AS rr, {columns} FROM (SELECT DISTINCT qid, doc_idx FROM {gold}) g LEFT JOIN {hits} h USING (qid, doc_idx) GROUP BY g.qid"


bm25("hits", "qw", 10)
CTES["qmodel"] = "SELECT qid, term, weight / sum(weight) OVER (PARTITION BY qid) AS p FROM qw"
CTES["fbdocs"] = "SELECT qid, doc_idx, CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0 / count(*) OVER w END AS w FROM (SELECT qid, doc_idx, greatest(score, 0) AS s FROM hits) WINDOW w AS (PARTITION BY qid)"
CTES["fbterms"] = """SELECT qid, term, w / sum(w) OVER (PARTITION BY qid) AS p FROM (SELECT qid, term, w, row_number() OVER (PARTITION BY qid ORDER BY round(w, 9) DESC, term) AS place
    FROM (SELECT qid, term, sum(w * tf / dl) AS w FROM fbdocs JOIN postings USING (doc_idx) JOIN lens USING (doc_idx) GROUP BY ALL)) WHERE place <= 20"""
CTES["rm3w"] = "SELECT qid, term, sum(p) AS weight FROM (SELECT qid, term, CASE WHEN qid IN (SELECT qid FROM fbterms) THEN 0.5 * p ELSE p END AS p FROM qmodel UNION ALL SELECT qid, term, 0.5 * p FROM fbterms) GROUP BY ALL"
bm25("rm3", "rm3w", 10)
CTES["dent"] = "SELECT doc_idx, entity, row_number() OVER (PARTITION BY doc_idx ORDER BY min(pos)) AS place FROM ment_raw GROUP BY doc_idx, entity"
CTES["steptoks"] = f"SELECT doc_idx, unnest(list_transform(regexp_extract_all({_simple('entity')}, '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM dent WHERE place <= 5"
CTES["stepw"] = """SELECT qid, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(weight, 9) DESC, term) AS place FROM (SELECT qid, term, sum(v) AS weight FROM (
    SELECT qid, term, 1.0 / rank AS v FROM hits JOIN steptoks USING (doc_idx) UNION ALL SELECT qid, term, weight FROM qw) GROUP BY ALL)) WHERE place <= 30"""
bm25("step", "stepw", 10)
fused("rrf", "hits", "dense")
graph("g", penalty=0.5)
graph("gsym", penalty=0.5, norm="sym")
graph("gnone", norm="none")
graph("gcap", cap=3)
graph("ghub", hubs=0.01)
graph("gwin", min_df=2, ratio=0.1)
graph("gt", "tment", 3, 0.1)
entity_seeds("es", "g")
entity_seeds("es_df", "g", power=0.5)
CTES["qterms"] = "SELECT qid, term AS entity FROM qtoks"
entity_seeds("ts", "gt", "qterms")
for _w in ("raw", "softmax", "rank"):
    doc_seeds(f"ds_{_w}", "hits", 5, _w)
doc_seeds("ds_rrf", "rrf", 5)
doc_seeds("ds_dense", "dense", 5)
mix("s_ent", "es", None)
mix("s_term", "ts", None)
for _m in ("l1", "fixed", "auto"):
    mix(f"s_{_m}", "es_df", "ds_rank", _m)
mix("s_hybrid", "es", "ds_raw")
mix("s_rrf", "es", "ds_rrf")
mix("s_dense", "es", "ds_dense")
CTES["fb_hits"] = "SELECT * FROM hits WHERE rank <= 1 AND qid NOT IN (SELECT qid FROM qent)"
doc_seeds("ds_fb", "fb_hits", 1)
mix("s_fb", "es", "ds_fb")
page_rank("m_graph", "g", "s_ent")
page_rank("m_fallback", "g", "s_fb")
page_rank("m_term", "gt", "s_term")
page_rank("m_hybrid", "g", "s_hybrid")
page_rank("m_rrf", "g", "s_rrf")
page_rank("m_dense", "g", "s_dense")
CTES["m_fusion"] = """SELECT * FROM (SELECT qid, doc_idx, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, f) AS rank FROM (SELECT qid, doc_idx, sum(score) AS score, min(f) AS f FROM (
    SELECT qid, doc_idx, score / max(score) OVER (PARTITION BY qid) AS score, (0, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, f)) AS f FROM rrf_scores
    UNION ALL SELECT qid, doc_idx, CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE score END, (1, rank) FROM m_graph) GROUP BY ALL)) WHERE rank <= 10"""
converging_page_rank("m_tol", "g", "s_ent", 1e-4)
converging_page_rank("m_tol_early", "g", "s_ent", 0.4)
pushed("m_push", "g", "s_ent", 1e-4)
bm25("hits100", "qw", 100)
CTES["rrf100"] = "SELECT * FROM (SELECT qid, doc_idx, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, f) AS rank FROM rrf_scores) WHERE rank <= 100"
reranked("rerank", "hits100")
reranked("rrf_rerank", "rrf100")
scores("sc", "hits")
scores("sc_rm3", "rm3")
scores("sc10", "hits", ks=(10,), cut=10)
scores("sc10_rm3", "rm3", ks=(10,), cut=10)


def sql(final: str) -> str:
    """``final`` with all table expressions that it needs, each once, in order."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\w+", text)):
            if word in CTES and word not in needed:
                visit(CTES[word])
                needed[word] = None

    visit(final)
    if not needed:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed) + "\n" + final


def hits_sql(name: str) -> str:
    return sql(f"SELECT qid, CAST(rank AS BIGINT) AS rank, doc_idx, round(score, 6) AS score FROM {name}")
