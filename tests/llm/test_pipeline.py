"""The pipeline's stages on a small fixture, against what each must keep."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        text = words(60) + (" vilething" if i % 6 == 0 else "")
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    near = rows[1][1].split()
    near[30] = "other"
    passage = words(40)
    for i, text in ((400, " ".join(near)), (401, rows[2][1]), (402, f"{words(10)} {passage}"), (403, f"{passage} {words(12)}")):
        rows.append((i, text, "en", "s", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and len(ids & set(range(0, 300, 6))) <= 2 and len(ids & {i for i in range(300) if i % 6}) >= 248
    single = stages["ngram_jaccard"](spark, clean, str(tmp_path)).cache()
    assert ids - {r.doc_id for r in single.collect()} == {400, 401}
    cut = {r.doc_id: r for r in stages["substring_dedup"](spark, single, str(tmp_path)).collect()}
    assert cut[403].text.split() == rows[-1][1].split()[40:] and cut[403].n_chars == len(cut[403].text)
    assert all(cut[r.doc_id].text == r.text for r in single.collect() if r.doc_id != 403)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(cut) and max(r.offset + r.length for r in out) <= 2048


def test_near_copies_go_by_rows(spark):
    """An id of two texts, repeated rows of the least id, rows without an id."""
    rng = random.Random(10)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (None, a), (2, b), (5, c), (5, d), (7, c), (7, d), (None, "no id has these words but null")]
    rows += [(None, rows[-1][1]), (8, ""), (8, ""), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, a), (2, b), (5, c), (5, d), rows[9], (8, ""), (8, ""), (9, None), (None, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))
