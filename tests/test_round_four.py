"""Walks by blocks of documents, and URL rules on odd URLs."""

import random

import pytest
from pyspark.sql import functions as F

from hopquarry.llm import queries, url_filter
from hopquarry.operators import graph, ppr, walk

from test_retrieval import engine_of


def small_blocks(monkeypatch):
    """Several blocks, and groups of few questions."""
    monkeypatch.setattr(walk, "BLOCK_DOCS", 4)
    monkeypatch.setattr(walk, "COLUMNS", 6)


def best(rows, k):
    out = {}
    for r in rows:
        out.setdefault(r.qid, []).append((-round(r.r, 9), r.node))
    return {q: sorted(v)[:k] for q, v in out.items()}


@pytest.mark.parametrize("rounds", [0, 4, 5])
@pytest.mark.parametrize("tol", [None, 0.3])
def test_blocks_equal_joins(spark, monkeypatch, rounds, tol):
    small_blocks(monkeypatch)
    rng = random.Random(5)
    names = ["Ann", "Ben", "Cara", "Dan", "Eve", "Finn", "Gus", "Hal"]
    texts = [". ".join(rng.choices(names, k=rng.randint(0, 4))) for _ in range(23)]
    e = engine_of(spark, texts, ["Ann. Ben", "Eve", "Hal", "nobody", "Gus. Dan"], max_iter=rounds, hub_penalty=0.5)
    entity = e.entity_seeds
    # seeds of documents with and without entities
    docs = spark.createDataFrame([(q, d, 1.0) for q in range(5) for d in range(q, 23, 5)], "qid long, node long, s double")
    seeds = ppr.mix_seeds(entity.withColumn("qid", F.col("qid").cast("long")), docs).localCheckpoint()
    got = walk.best_documents(e.graph.blocks, seeds, 0.15, rounds, 7, tol).collect()
    joins = ppr.power_iteration if tol is None else ppr.converging_iteration
    args = () if tol is None else (tol,)
    want = joins(e.graph.edges, seeds, 0.15, rounds, *args).where("node >= 0 and r > 0").collect()
    assert best(got, 7) == best(want, 7) and want


def test_term_graph_of_repeated_ids_and_blocks(spark, monkeypatch):
    small_blocks(monkeypatch)
    rows = [(i % 9, f"alpha beta w{i % 4} w{i % 5} gamma") for i in range(12)] + [(20, None), (None, "alpha w1")]
    docs = spark.createDataFrame(rows, "doc_idx long, text string")
    for table in (docs, docs.where("doc_idx > 2")):
        g = graph.build_term_graph(table, 1, 1.0)
        seeds = g.entities.where("entity in ('w1', 'w3')").select(F.lit("q").alias("qid"), (-1 - F.col("ent_idx")).cast("long").alias("node"), F.lit(0.5).alias("s")).localCheckpoint()
        got = walk.best_documents(g.blocks, seeds, 0.15, 3, 5).collect()
        want = ppr.power_iteration(g.edges, seeds, 0.15, 3).where("node >= 0").collect()
        assert best(got, 5) == best(want, 5) and want


def test_entities_travel_many_in_a_row(spark, monkeypatch):
    monkeypatch.setattr(walk, "BLOCK_DOCS", 60)
    written, keep = [], walk.stored
    monkeypatch.setattr(walk, "stored", lambda df, label: written.append((label, keep(df, label))) or written[-1][1])
    monkeypatch.setattr(walk, "_forget", lambda rows: None)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 40)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_idx long, text string").repartition(3)
    g = graph.build_term_graph(docs, 2, 0.5)
    assert g.blocks.n_blocks == 4 and g.blocks.rows > 500
    seeds = g.entities.where("entity in ('w1', 'w3', 'w5')").select(F.lit("q").alias("qid"), (-1 - F.col("ent_idx")).cast("long").alias("node"), F.lit(0.5).alias("s")).localCheckpoint()
    got = walk.best_documents(g.blocks, seeds, 0.15, 5, 7).collect()
    want = ppr.power_iteration(g.edges, seeds, 0.15, 5).where("node >= 0").collect()
    assert best(got, 7) == best(want, 7) and want
    # not a row for each entity and block
    assert all(df.count() < 50 for label, df in written if label == "rows")


def test_kernel_of_a_larger_graph_goes_by_blocks(spark, monkeypatch):
    from hopquarry.plans import methods

    monkeypatch.setattr(ppr, "WHOLE_EDGES", 3)
    e = engine_of(spark, ["Ann. Ben", "Ben. Cara", "Cara. Dan"], ["Ann"], top_ks=(3,), max_iter=3)
    plain = [tuple(r) for r in methods.graph_method(e).orderBy("rank").collect()]
    assert plain == [tuple(r) for r in methods.graph_method(methods.with_settings(e, backend="kernel")).orderBy("rank").collect()] and plain


def url_judged(url):
    """The contract of op1, read word by word."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h + p), h + p, verdict) for verdict, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_by_their_contract(spark):
    hosts = ["com", "example.com", "www.EXAMPLE.com", "xexample.com", "example.net", ".net", "net.", "a..org", "com:80", "u@com", "İ.com", "a\n.com", "\0.com", "𝒳.net", "", "....com", "com."]
    paths = ["", "/", "/en/", "/en/7", "/EN/7", "/de/8", "/de/", "/es/x", "en/", "//en/", "/en/𝒳", "?/en/", "#/en/", "/en/7?x://example.net/de/8", "/a://com/en/", "/en\\/"]
    urls = [s + h + p for s in ("http://", "://", "http:///", "http:/", "a://b://", "\n://") for h in hosts for p in paths] + [None, "", "x"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: url_judged(u) for i, u in enumerate(urls)}
