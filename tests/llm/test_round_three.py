"""License scans, importance resampling and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopquarry.llm import importance, license_scan, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lowered_words(text):
    return WORDS.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["Zug", "été", "the", "of", "License", "MIT", "Apache", "cc", "by", "naïve", "数据", "it", "is", "free", "x1"]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    odd = [
        None, "", " ", "\n\n", "word", "MIT License, mit license! MIT-LICENSE", "gnu general public licensee", "a▁b", "tab\tand  two  spaces ",
        "nul \x00 byte", "😀 emoji 👩‍👩‍👧", "<|endoftext|> and <s> </s> <unk> <0x41>", "CC BY-NC 4.0", "ÀÉ ÄÖ", "licensed under CC by nc",
    ]
    long = " ".join(rng.choices(words, k=40_000))
    return [*made, *odd, long, made[0], made[0], made[1]]


@pytest.fixture(scope="module")
def documents(spark, texts):
    schema = "doc_id long, text string, row long, pair long, n_words long, digest string, score double"
    rows = [(k if k % 9 else 9, t, 1, 2, 3, "x", 0.5) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "the mit license of null", 1, 2, 3, "x", 0.5)], schema).repartition(3)


def rows_of(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def same(found, expected):
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert license_scan.scan_documents(none).collect() == []
    assert importance.resample_documents(none, none).collect() == []
    assert token_alignment.align_documents(none, A, B).collect() == []


# --- licences


def brute_base(text):
    words, phrases = lowered_words(text), {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    found = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def test_license_places(documents):
    out = license_scan.scan_documents(documents)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    same(out.drop("labels", "score").collect(), [(i, *brute_base(t)) for i, t in rows_of(documents)])
    for row in out.collect():
        assert set(row["base_labels"].split(",")) <= {*row["labels"].split(","), ""} and 0 <= row["score"] <= 1
        assert row["score"] == 1 or not row["n_base"]


def test_license_texts_in_blocks(monkeypatch):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    text = ("größe the MIT license ünder " * 50).encode()
    whole = scanner.scan(text)
    for block in (1, 7, 64):
        monkeypatch.setattr(license_scan, "BLOCK", block)
        assert scanner.scan(text) == whole


def brute_matches(words, templates):
    """Longest ends that a template has, where they cannot go on."""
    inside = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    reach = []
    for end in range(1, len(words) + 1):
        reach.append(next((n for n in range(end, 0, -1) if tuple(words[end - n : end]) in inside), 0))
    ends = [k + 1 for k in range(len(words)) if reach[k] >= license_scan.LEAST_MATCH and (k + 1 == len(words) or reach[k + 1] <= reach[k])]
    return [(end - reach[end - 1], end) for end in ends]


def brute_chain(matches, template):
    """The most words of a chain of disjoint matches that goes up in text and template."""
    pieces = [(s, e, p) for s, e, words in matches for p in range(len(template) - (e - s) + 1) if template[p : p + e - s] == words]
    best = []
    for s, e, p in pieces:
        best.append(e - s + max((best[k] for k, (s2, e2, p2) in enumerate(pieces[: len(best)]) if e2 <= s and p2 + e2 - s2 <= p), default=0))
    return max(best, default=0)


def test_matching_statistics_and_chains():
    rng = random.Random(3)
    for _ in range(150):
        letters = [c.encode() for c in "abcd"[: rng.randint(2, 4)]]
        templates = [rng.choices(letters, k=rng.randint(1, 14)) for _ in range(rng.randint(1, 4))]
        phrases = [rng.choices(letters, k=rng.randint(1, 3)) for _ in range(2)]
        automaton = license_scan.Automaton(templates, phrases)
        words = rng.choices([*letters, b"z"], k=rng.randint(0, 40))
        for t in templates:
            words += t[: rng.randint(0, len(t))] + rng.choices([*letters, b"z"], k=3)
        n, found, matches = automaton.scan(words)
        assert n == len(words)
        assert sorted(found) == sorted((i, k) for i in range(n) for k, p in enumerate(phrases) if words[i : i + len(p)] == p)
        strings = [*templates, *phrases]
        assert [(m.start, m.end) for m in matches] == brute_matches(words, strings)
        for which, template in enumerate(templates):
            got = [s.covered for s in automaton.chains(matches) if s.template == which]
            runs, reach = [], None
            for m in matches:
                words_in = words[m.start : m.end]
                if not any(template[p : p + len(words_in)] == words_in for p in range(len(template))):
                    continue
                if reach is None or m.start > reach + license_scan.GAP:
                    runs.append([])
                runs[-1].append((m.start, m.end, words_in))
                reach = m.end
            assert got == [brute_chain(run, template) for run in runs]


def test_license_templates_with_changes(spark):
    text = dict(license_scan.TEMPLATES[::-1])["bsd"].split()
    changed = " ".join(["Copyright 2020 by us.", *text[:15], "und", *text[16:]])
    isc = next(t for label, t in license_scan.TEMPLATES if label == "isc")
    rows = [(1, changed), (2, " ".join(text[:10])), (3, f"x {isc.upper()} y\n" * 3), (4, "Licensed under CC BY-NC 4.0."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.scan_documents(docs, keep_spans=True).collect()}
    assert out[1]["labels"] == "bsd" and 0.9 < out[1]["score"] < 1 and out[1]["spans"][0]["first_word"] == 4
    assert out[2]["labels"] == "" and 0 < out[2]["score"] < license_scan.COVERED
    assert out[3]["labels"] == "isc" and out[3]["score"] == 1 and out[3]["spans"][0]["covered"] == out[3]["spans"][0]["words"]
    assert out[4]["labels"] == "cc-by,cc-by-nc" and out[4]["n_base"] == 1
    assert (out[5]["n_words"], out[5]["first_word"], out[5]["labels"], out[5]["score"], out[5]["spans"]) == (0, None, "", 0, [])


# --- importance resampling


def brute_resample(rows, target, percent=25, least=20, buckets=10_000):
    def features(text):
        words = lowered_words(text)
        return len(words), [zlib.crc32(f.encode()) % buckets for f in [*words, *map(" ".join, zip(words, words[1:]))]]  # noqa: B905

    found, wanted = [features(t) for _, t in rows], [features(t)[1] for t in target]
    s, t = Counter(b for _, f in found for b in f), Counter(b for f in wanted for b in f)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (doc_id, _), (n_words, f) in zip(rows, found, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    long = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(long[: len(long) * percent // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("share", [1000, 20])
def test_importance(spark, documents, monkeypatch, share):
    monkeypatch.setattr(importance, "HOT_SHARE", share)
    target = [None, "the mit license is free", "été of the ZUG", "", "the mit license is free"]
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = importance.resample_documents(documents, wanted)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in out.dtypes} == {"bigint"}
    same(out.collect(), brute_resample(rows_of(documents), target))


def test_importance_of_a_hot_text(spark):
    rows = [(k, "one text that many documents share " * 4) for k in range(400)] + [(k, f"text {k} of its own " * 5) for k in range(400, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(importance.resample_documents(docs, docs.where("doc_id >= 590")).collect(), brute_resample(rows, [t for i, t in rows if i >= 590]))
    none = spark.createDataFrame([], "item_id long, text string")
    same(importance.resample_documents(docs, none, percent=100).collect(), brute_resample(rows, [], percent=100))


# --- alignment


def brute_align(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    done, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in b_model.encode(text) if text else []:
            piece = b_model.id_to_piece(i)
            b.append((i, bytes([int(piece[1:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        groups, links = [], []
        i = j = a_at = b_at = 0
        while i < len(a):
            left, right = [a[i]], [b[j]]
            a_at, b_at, i, j = a_at + len(a[i][1]), b_at + len(b[j][1]), i + 1, j + 1
            while a_at != b_at:
                if a_at < b_at:
                    left.append(a[i])
                    a_at, i = a_at + len(a[i][1]), i + 1
                else:
                    right.append(b[j])
                    b_at, j = b_at + len(b[j][1]), j + 1
            groups.append(",".join(str(t) for t, _ in left) + "|" + ",".join(str(t) for t, _ in right))
            links.append((left[-1][0], right[-1][0], a_at))
        counts.update(link[:2] for link in links)
        done.append((doc_id, len(a), len(b), groups, links))
    most = {}
    for (_, b_id), n in counts.items():
        most[b_id] = max(n, most.get(b_id, 0))
    for doc_id, n_a, n_b, groups, links in done:
        own = [counts[link[:2]] for link in links]
        best = sum(n == most[link[1]] for n, link in zip(own, links, strict=True))
        text = ";".join(groups)
        yield (doc_id, n_a, n_b, len(groups), len(links), best, sum(own), hashlib.sha256(text.encode()).hexdigest() if groups else ""), text, [link[2] - 1 for link in links]


@pytest.mark.parametrize(("hot", "run", "piece"), [(100_000, 1 << 20, 1 << 17), (40, 300, 50)])
def test_alignment(spark, documents, monkeypatch, hot, run, piece):
    monkeypatch.setattr(token_alignment, "HOT", hot)
    rows = rows_of(documents)
    expected = list(brute_align(rows))
    assert any(row[1] == 0 and text for (row, _, _), (_, text) in zip(expected, rows, strict=True))
    out = token_alignment.align_documents(documents, A, B, keep_groups=True)
    same(out.drop("groups", "ends").collect(), [row for row, _, _ in expected])
    # pieces and runs of other sizes give the same tokens
    monkeypatch.setattr(token_alignment, "PIECE", piece)
    aligner = token_alignment.Aligner(A, B)
    assert not aligner.whole
    part = token_alignment.Aligned(aligner, [aligner.ids(t or "") for _, t in rows])
    assert part.group_texts() == [text for _, text, _ in expected]
    assert part.byte_ends().tolist() == [e for _, _, ends in expected for e in ends]
    digests = {(r["doc_id"], r["groups_sha256"]): (r["groups"], r["ends"]) for r in out.collect()}
    assert digests == {(row[0], row[-1]): (text, ends) for row, text, ends in expected}


def test_queries_are_registered():
    from hopquarry.llm.queries import QUERIES

    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "the mit license of all things", "x", 5)]
    for names in (["doc_id", "text", "pairs", "times"], ["doc_id", "text", "labels", "best"], ["doc_id", "text", "salt", "parts"]):
        kinds = [T.LongType(), T.StringType(), T.StringType(), T.IntegerType()]
        docs = spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
        assert license_scan.scan_documents(docs).first()["n_base"] == 1
        assert importance.resample_documents(docs, docs).first()["n_features"] == 11
        assert token_alignment.align_documents(docs, A, B).agg(F.sum("n_links")).first()[0] > 3
