"""Each operator against a brute-force version, with nulls, empty and repeated rows, ties and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hopquarry.llm import (
    byte_bpe,
    embedding_dedup,
    html_extract,
    jaccard_join,
    packing,
    substring_dedup,
    toxicity,
    url_filter,
    warc,
    winnowing,
)
from hopquarry.llm.components import connected_components

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/"), ("block", "x.net", "/a")]


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): copies, near copies, shared passages, odd and very long texts."""
    rng = random.Random(3)
    passage = sentence(rng, 60, 5000)
    base = [sentence(rng, rng.choice([3, 12, 40, 120, 300])) for _ in range(40)]
    near = []
    for text in base[:15]:
        words = text.split()
        for _ in range(3):
            changed = list(words)
            changed[rng.randrange(len(changed))] = "changed"
            near.append(" ".join(changed))
    hot = sentence(rng, 150, 5000).split()
    group = []
    for _ in range(25):
        changed = list(hot)
        changed[rng.randrange(150)] = f"own{rng.random()}"
        group.append(" ".join(changed))
    rows = base + near + group + base[:5]
    rows += [f"{sentence(rng, 30)} {passage} {sentence(rng, 9)}" for _ in range(6)]
    rows += [None, "", " \t\n", "one", "Über Straße\u00a0naïve 中文 😀", "In. " * 300, sentence(rng, 6000, 9000)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, f"s{i % 3}", "x") for i, t in texts]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, handle string, key string")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    results = [
        url_filter.filter_urls(pages, RULES), toxicity.score_documents(docs, labels), warc.archive_and_reassemble(spark, pages),
        packing.pack_documents(docs, WORD_FILE), substring_dedup.dedup_substrings(docs), embedding_dedup.near_duplicates(vectors),
        byte_bpe.encode_documents(docs, BYTE_FILE, public_tokenizers.PATTERN), jaccard_join.similar_documents(docs),
        winnowing.fingerprint_documents(docs), html_extract.extract_pages(pages),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_url_rules(spark):
    urls = [
        None, "no scheme", "http://A.Example.COM/en/781?x=1", "http://example.com/en/8", "https://z.com/EN/", "ftp://net", "x://net/",
        "http://a.b.x.net/a/b#c", "http://x.net/b", "http://com.org/en/", "http://notexample.com/en/7", "http://net?/a", "http://h/" + "p" * 5000, "http://com/en/",
    ]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(2, urls[2], "h", "r"), (None, urls[3], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")

    def brute(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    got = sorted(((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.filter_urls(pages, RULES).collect()))
    want = sorted(((i is None, i or 0, h, p, rule or "", v) for (i, u, *_), (h, p, rule, v) in ((row, brute(row[1])) for row in rows)))
    assert got == want


def test_warc_round_trip(spark):
    big, other = "é" * 700, "y" * 1200
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (4, "http://a/4 x\n", "small"), (6, "u", "small"), (7, "u", None), (8, "u", other), (8, "u", other), (9, "u", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_and_reassemble(spark, pages).collect()
    assert len(got) == len(rows)
    by = {r.metadata.page_id: r for r in got}
    assert {i for i, r in by.items() if r.response.record_type == "revisit"} == {1, 3}
    assert by[1].metadata.refers_to == "5" and by[1].response.refers_to == by[5].response.record_id
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (by[page_id].response.payload_bytes, by[page_id].response.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert by[page_id].request is not None
    assert sum(r.metadata.page_id == 8 for r in got) == 2


def test_warc_payload_comes_back(spark):
    from hopquarry.llm.support import scratch

    folder = scratch(spark, "warc-test")
    pages = spark.createDataFrame([(1, "http://a/", "WARC/1.1\r\n\r\nnot a record\r\n\r\n")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages, folder), folder, keep_payload=True).where("record_type = 'response'").collect()
    assert [bytes(r.payload).decode() for r in rows] == ["WARC/1.1\r\n\r\nnot a record\r\n\r\n"]


def test_packing(spark, documents, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_FILE)
    tokenizer.encode_special_tokens = True
    capacity = 64
    rows = packing.pack_documents(documents, WORD_FILE, capacity).collect()
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = collections.Counter()
    for i, t in [*texts, texts[3]]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), capacity):
            want[i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())] += 1
    assert pieces == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / capacity + 2


def test_best_two_fit_exchanges_the_smallest():
    # greedy takes 6 + 3; the gap of 1 and the 3 make room for 2 + 2
    bins = [sorted(n for _, n in b) for b in packing.best_two_fit([6, 3, 2, 2], 10)]
    assert bins == [[2, 2, 6], [3]]
    lengths = [random.Random(1).randint(1, 50) for _ in range(500)]
    rows = sorted(row for b in packing.best_two_fit(lengths, 50) for row, _ in b)
    assert rows == list(range(500))


def brute_windows(texts, window=20):
    seen, out = set(), {}
    for i, t in sorted(texts):
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(documents, texts):
    rows = substring_dedup.dedup_substrings(documents).collect()
    assert len(rows) == len(texts) + 1
    want = brute_windows(texts)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in rows)


def test_substring_dedup_keeps_ids_of_other_texts_apart(spark):
    rng = random.Random(1)
    a, b = sentence(rng, 40), sentence(rng, 40)
    docs = spark.createDataFrame([(1, a), (1, b), (2, f"x {a}"), (None, b)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect())
    assert got == [(-1, 40, 0), (1, 40, 0), (1, 40, 40), (2, 41, 40)]


def test_cut_documents_keeps_columns(spark):
    rng = random.Random(1)
    a = sentence(rng, 30)
    docs = spark.createDataFrame([(1, a, "n", 5), (2, f"keep {a}", "n", 6), (3, a, None, 7), (4, None, "n", 0)], "doc_id long, text string, cut_text string, n_chars long")
    rows = {r.doc_id: r for r in substring_dedup.cut_documents(docs).collect()}
    assert set(rows) == {1, 2, 4} and rows[2].text == "keep" and rows[2].n_chars == 4 and rows[1].text == a and rows[1].n_chars == 5


def brute_jaccard(texts):
    sets = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i in sets if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(documents, texts):
    rows = jaccard_join.similar_documents(documents).collect()
    want = brute_jaccard(texts)
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_jaccard_join_of_chains_in_large_buckets(spark):
    """Near copies that drift: neighbours are similar, the ends are not, and strays share the words."""
    rng = random.Random(8)
    words, rows = [f"v{rng.randrange(10**6)}" for _ in range(120)], []
    for i in range(60):
        words = list(words)
        for _ in range(1 + i % 3):
            words[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(words[: 70 + i] + [f"s{i}{k}" for k in range(45)])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs).collect()}
    assert got == brute_jaccard(rows)


@pytest.mark.parametrize("salted", [jaccard_join.SALTED, 24])
def test_jaccard_join_of_near_copies_that_differ_from_all_leaders(spark, salted):
    """300 near copies of a text that is not there: most are not similar to one another, some are through shared changes."""
    rng = random.Random(21)
    base, rows = [f"v{k}" for k in range(150)], []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([2, 3, 4, 5, 6])):
            at = rng.randrange(150)
            words[at] = f"x{at}" if i % 3 else f"y{rng.random()}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.grouped_documents(docs, salted=salted).collect()
    want = brute_jaccard(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert 20 < len({c for _, c in want.values()}) < 250


def test_suffix_filter_and_verification_at_the_threshold():
    rng = np.random.default_rng(4)
    for size in (1, 5, 40, 700):
        a = np.unique(rng.integers(0, 1 << 48, size).astype(np.uint64))
        for shared in range(len(a) + 1):
            b = np.unique(np.r_[a[:shared], rng.integers(0, 1 << 48, len(a) - shared).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            assert jaccard_join.linked(a, b) == (100 * both >= 75 * (len(a) + len(b) - both))


def test_jaccard_join_of_null_ids(spark):
    """A null id is never the least one, within a set's copies or in a component of several sets."""
    rng = random.Random(12)
    words = [f"u{rng.randrange(10**6)}" for _ in range(60)]
    near = " ".join(words[:30] + ["other"] + words[31:])
    copy, alone = " ".join(words), "only rows without an id have these words"
    rows = [(2, copy), (None, copy), (1, copy), (0, near), (None, near), (None, alone), (None, alone)]
    for some, least in ((rows[:3], 1), (rows, 0)):
        got = jaccard_join.similar_documents(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert sorted(r.component_id for r in got if r.n_shingles != 4) == [least] * min(len(some), 5)
    assert [r.component_id for r in got if r.n_shingles == 4] == [None, None]


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in up}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    copies = np.repeat(base[:20], 6, axis=0) + 0.05 * rng.standard_normal((120, 16))
    vectors = np.concatenate([base, copies, base[:4], 3 * base[5:6]]).astype("f4")
    rows = [(i, v.tolist(), i % 2, "k") for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    rows += [(n + k, v, 0, "k") for k, v in enumerate(odd)] + [(n + 10, vectors[0].tolist(), None, "k"), (n + 11, vectors[0].tolist(), None, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    unit = vectors.astype("f8") / np.linalg.norm(vectors.astype("f8"), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & ((np.arange(n)[:, None] - np.arange(n)) % 2 == 0)
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(n))
    assert found <= link.sum() and found >= 0.9 * link.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in got if i >= n)


def test_embeddings_of_several_lengths(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.01], 0), (3, [1.0, 2.0], 1), (4, [1.0, 2.0, 0.0], 0), (5, [1.0, 2.0, 0.01], 0), (6, [0.0, 0.0, 1.0], 0), (7, [-5.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_embeddings_of_a_large_group_of_near_copies(spark, tmp_path):
    """Far more lists than a few lie in the group, and each member links across all of them."""
    rng = np.random.default_rng(6)
    n, hot, dim = 40_000, 9_000, 64
    vectors = rng.standard_normal((n, dim))
    centre = rng.standard_normal(dim)
    vectors[:hot] = centre + 0.2 * np.linalg.norm(centre) / np.sqrt(dim) * vectors[:hot]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.concatenate([(unit[k : k + 1000] @ unit.T >= 0.93).sum(1) for k in range(0, n, 1000)]) - 1
    columns = {"vec_id": np.arange(n), "label": np.zeros(n, "i4"), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), dim).cast(pa.list_(pa.float64()))}
    pq.write_table(pa.table(columns), f"{tmp_path}/embeddings.parquet")
    got = embedding_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).orderBy("vec_id").toPandas()
    links = got["n_links"].to_numpy()
    assert want[:hot].sum() > 10 * hot
    # cosines within rounding of the threshold may fall on either side
    assert abs(int(links.sum()) - int(want.sum())) <= 1e-6 * want.sum() and np.abs(links - want).max() <= 2


def test_probes_are_learnt(spark):
    """At 200,000 vectors, nearly all links are found by comparing a few of a hundred pairs; with more recall asked for, lists are added."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((4_000, 48))
    x = centres[rng.integers(0, 4_000, 200_000)] + 0.27 * rng.standard_normal((200_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius = float(np.sqrt(2 - 2 * embedding_dedup.COSINE))
    lists = int(np.sqrt(len(x)) / 2)
    quantiser = embedding_dedup.Quantiser(x[: embedding_dedup.SAMPLE], lists, radius)
    rows = [(0, k, v.astype("<f8").tobytes()) for k, v in enumerate(x[:60_000])]
    classes = spark.createDataFrame(rows, "label long, key long, vector binary").repartition(4)
    asked = (x[: embedding_dedup.ASKED], np.zeros(embedding_dedup.ASKED, int), np.arange(embedding_dedup.ASKED))
    margins = []
    for recall in (0.5, embedding_dedup.RECALL):
        embedding_dedup.learn_margins(classes, {48: quantiser}, {48: asked}, embedding_dedup.COSINE, recall)
        margins.append(quantiser.margin)
    assert radius * embedding_dedup.LEAST_MARGIN <= margins[0] < margins[1] < radius / 2
    home = np.concatenate([quantiser.margins(x[k : k + 5000])[0] for k in range(0, len(x), 5000)])
    sizes, found, links, compared = np.bincount(home, minlength=len(quantiser.coarse)), 0, 0, 0
    for k in range(100_000, 102_000, 500):  # none of these was asked
        reached = quantiser.place(x[k : k + 500])[1]
        near = x[k : k + 500] @ x.T >= embedding_dedup.COSINE
        for row, probes in zip(near, reached, strict=True):
            compared += sizes[probes].sum()
            links += row.sum() - 1
            found += np.isin(home[row], probes).sum() - 1
    assert links > 20_000 and found >= 0.99 * links and compared <= 0.05 * 2_000 * len(x)


def test_all_links_on_request(spark):
    rng = np.random.default_rng(9)
    vectors = np.repeat(rng.standard_normal((150, 12)), 4, axis=0) + 0.16 * rng.standard_normal((600, 12))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, recall=1).collect()}
    assert [got[i] for i in range(600)] == want.tolist()


def test_every_frequent_length_is_coded(spark):
    """Two lengths, both coded; list numbers of one do not mix with those of the other."""
    rng = np.random.default_rng(10)
    rows, want = [], {}
    for dim in (8, 12):
        base = rng.standard_normal((800, dim))
        vectors = np.concatenate([base, base + 0.01 * rng.standard_normal(base.shape), base + 0.01 * rng.standard_normal(base.shape)])
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        n = (unit @ unit.T >= 0.93).sum(1) - 1
        want |= {len(rows) + i: int(k) for i, k in enumerate(n)}
        rows += [(len(rows) + i, v.tolist(), 3) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_byte_bpe(spark, documents, texts):
    import tiktoken

    coder = byte_bpe.loaded(BYTE_FILE, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rows = byte_bpe.encode_documents(documents, BYTE_FILE, public_tokenizers.PATTERN, keep_ids=True).collect()
    by = dict(texts)
    for r in rows:
        text = by[r.doc_id] or ""
        assert r.ids == other.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
    rng = random.Random(5)
    pools = ["abcdefghij '", "éèñß的中文한국어 ", "0123456789.,!?-_ \t\n\r \u2028'sdt", "😀🏽абв ابت"]
    for _ in range(2000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def brute_selected(text):
    import re

    units = re.findall(r"[^ \t-\r]{1,6}", text)
    grams = [tuple(units[k : k + 4]) for k in range(max(1, len(units) - 3))] if units else []
    return grams


def test_fingerprints(spark, documents, texts):
    rows = {r.doc_id: r for r in winnowing.fingerprint_documents(documents).collect()}
    ordered = sorted([*texts, texts[3]], key=lambda x: x[0])
    for k, (i, t) in enumerate(ordered):
        text, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        if ordered[k - 1][0] != i and ordered[(k + 1) % len(ordered)][0] != i:
            assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(text)
        grams = brute_selected(text)
        places = [int(e.split(":")[1]) for e in rows[i].fingerprint.split(",") if e]
        assert places == sorted(set(places))
        if grams:  # every window of 16 grams has a selected place
            assert all(any(k <= p < k + 16 for p in places) for k in range(max(1, len(grams) - 15)))
            if len(set(grams)) > 100 and "In." not in text:
                assert len(places) < 0.3 * len(grams)
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    equal = collections.defaultdict(set)
    for i, t in texts:
        equal[t or ""].add(rows[i].fingerprint)
    assert all(len(own) == 1 for own in equal.values())
    long = [rows[i] for i, t in texts if len(t or "") > 800 and "In." not in t]
    assert np.mean([r.near_edited for r in long]) > 0.45


def test_fingerprints_take_the_rightmost_of_equal_hashes(spark):
    docs = spark.createDataFrame([(1, "aaaa " * 40)], "doc_id long, text string")
    row = winnowing.fingerprint_documents(docs).first()
    # 37 equal grams: each window of 16 selects its last one
    assert [int(e.split(":")[1]) for e in row.fingerprint.split(",")] == list(range(15, 37))
    assert row.near_next == 1.0


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        words = sentence(rng, rng.choice([5, 40, 200]), 900).split()
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Vilestone", "vilerag!", "grotz"])
        rows.append((i, " ".join(words), "s"))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (10**6, 1), labels[0]]
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, f"{sentence(rng, 30000, 900)} grotz {sentence(rng, 3000, 900)}", "s"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.95
    assert by[1002].predicted == 1 and by[1000].predicted == 0 and by[1000].score == by[1001].score
    clean = toxicity.clean_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if r.predicted == 0}


def test_a_long_text_costs_no_other_its_place(spark):
    """Texts of 10 MB, first in hash order of their kind: all short texts are learnt from, and a kind with long texts only keeps one."""
    labelled = [(i, i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    ids = spark.createDataFrame(labelled, "doc_id long, toxic int").orderBy(F.xxhash64("doc_id")).collect()
    first = {kind: next(r.doc_id for r in ids if r.toxic == kind) for kind in (0, 1)}
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    short = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    text = F.when(F.col("doc_id").isin(*first.values()), F.repeat(F.lit("long words "), 1_000_000)).otherwise(F.col("text"))
    texts, toxic, share = toxicity.labelled_sample(short.withColumn("text", text), labels, "doc_id", "text", "toxic")
    assert sorted(texts) == sorted(f"text {i}" for i, _ in labelled if i not in first.values())
    assert set(toxic) == {0, 1} and share == sum(t for _, t in labelled) / len(labelled)
    text = F.when(F.col("doc_id") % 2 == 1, F.repeat(F.lit("long words "), 1_000_000)).otherwise(F.col("text"))
    texts, toxic, _ = toxicity.labelled_sample(short.withColumn("text", text), labels, "doc_id", "text", "toxic")
    assert sum(toxic) == 1 and toxic.count(0) == sum(1 - t for _, t in labelled)


def test_toxicity_is_learnt_in_context():
    """Both kinds of texts have the same words, as often: only their order tells, so no word's statistics can."""
    rng = random.Random(16)

    def text(toxic):
        words = sentence(rng, 20, 60).split()
        for _ in range(3):
            at = rng.randrange(len(words))
            words[at:at] = ["quick", "brown"] if toxic else ["brown", "quick"]
        return " ".join(words)

    labels = [k % 2 for k in range(700)]
    net = toxicity.train([text(y) for y in labels], labels)
    logits, _, _, best = net.scores(toxicity.Vocabulary([toxicity.words_of(text(k % 2)) for k in range(200)]))
    assert np.mean((logits[best] >= 0) == np.arange(200) % 2) > 0.9


def test_toxicity_without_both_kinds():
    assert toxicity.train([], []) == 0.0 and toxicity.train(["a", "b"], [1, 1]) == 1.0
    assert toxicity.train(["a", ""], [0, 0]) == 0.0


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng)
    net.w = {k: w.astype("f8") for k, w in net.w.items()}
    x = np.r_[rng.standard_normal((5, 2 * toxicity.PARTS)), np.zeros((1, 2 * toxicity.PARTS))]
    ids = rng.integers(0, 5, (3, toxicity.WINDOW))
    ids[1, 9:] = -1
    _, kept = net.forward(x, ids, keep=True)
    grads, x_slope = net.backward(x, ids, kept, np.ones(3))
    for name in ("Wf", "Ub", "bf", "attend", "out"):
        w, at = net.w[name], (0,) * net.w[name].ndim
        old, out = w[at], []
        for step in (1e-4, -1e-4):
            w[at] = old + step
            out.append(net.forward(x, ids)[0].sum())
        w[at] = old
        assert grads[name][at] == pytest.approx((out[0] - out[1]) / 2e-4, rel=0.05, abs=2e-3)


def test_html_extraction(spark):
    article = "<h1>The title of it</h1><p>First  paragraph, with &lt;marks&gt; &amp; more\nwords in it.<p><b>Second one, never closed, goes on for a while.<br><p>Third paragraph of the article, the last.</p>"
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- <p>hidden</p> --><div class=\"ad\">Buy this thing now.</div>"
        f"<article>{article}</article><section class='comments'><div class='comment'><p>I agree with this.</p></div></section>"
        "<aside class='sidebar'><p>Other stories you may like to read.</p></aside><form><label>Mail</label><button>Send</button></form>"
        "<div class='cookie-notice'>We use cookies here.</div><footer>&copy; 2020 Site</footer></body></html>"
    )
    want = "The title of it\nFirst paragraph, with <marks> & more words in it.\nSecond one, never closed, goes on for a while.\nThird paragraph of the article, the last."
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x"), (4, "u", "<div>" * 5000 + "deep" + "<a href='" * 50, "x")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == want and texts[2] == texts[3] == ""
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<p>one</p><svg width='1'/><p>two</p>", "one|two"),
        ("<p>one</p><svg><text>no</text></svg><p>two</p>", "one|two"),
        ("<p>one</p><template><p>two</p>", "one|two"),
        ("<p>one</p><!--><p>two</p><!---><p>three</p><!-- <p>no</p> --><p>four", "one|two|three|four"),
        ("<p>one</p><script>no", "one"),
        ("<p><a href=/x/>one</a> two</p>", "one two"),
    ],
)
def test_text_beside_odd_tags(html, texts):
    from hopquarry.llm.dom import Page, joined_text

    page = Page(html)
    assert joined_text(page.pieces, [True] * len(page.tags)).split("\n") == texts.split("|")


def test_an_unquoted_slash_leaves_the_link_open():
    from hopquarry.llm.dom import Page

    page = Page("<p><a href=/x/>one</a><br/>two")
    assert [page.tags[node] for node, _, text in page.pieces if text.strip()] == ["a", "p"]


def test_end_tags_find_their_elements_below_many_open_ones():
    page = html_extract.Page("<article><p>" + "<span>" * 1000 + "story</p><p>more</article><footer>foot</footer>")
    chain = {}
    for node, _, text in page.pieces:
        chain[text] = []
        while node > 0:
            chain[text].append(page.tags[node])
            node = page.parents[node]
    assert chain["story"] == ["span"] * 1000 + ["p", "article"]
    assert chain["more"] == ["p", "article"] and chain["foot"] == ["footer"]
    table = html_extract.Page("<div><table><tr><td>" + "<b>" * 1000 + "a</div><td>b</table>c")
    where = {text: table.tags[node] for node, _, text in table.pieces}
    assert where == {"a": "b", "b": "td", "c": "div"}


def test_html_extraction_on_held_out_pages():
    model, rng = html_extract.train(), random.Random(1234)
    good = total = 0
    for _ in range(120):
        marked = html_extract.training_page(rng)
        page = html_extract.Page(marked)
        inside = {k for k, (_, _, t) in enumerate(page.pieces) if html_extract.MARK in t}
        want = sum((p[2].replace(html_extract.MARK, "").split() for k, p in enumerate(page.pieces) if k in inside), [])
        got = html_extract.extract([marked.replace(html_extract.MARK, "")], model)[0].split()
        same = sum((collections.Counter(got) & collections.Counter(want)).values())
        good += 2 * same
        total += len(got) + len(want)
    assert good / total > 0.95


def test_boosted_trees_fit():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > -0.1)).astype(float)
    model = html_extract.BoostedTrees(trees=30, depth=3).fit(x[:1500], y[:1500])
    assert (((model.margins(x[1500:]) > 0) == (y[1500:] > 0)).mean()) > 0.95
