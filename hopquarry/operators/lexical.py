"""BM25 and its query expansions, for all questions at once.

Texts are read and cut once: the index stores the terms of each document with their
counts, and no text is shuffled.  A search scans it in blocks of documents: each block has its postings
by term with the greatest impact first, so the best that a question can get there is
known before any posting is scored, and a block that cannot reach the question's best
``k`` so far is skipped.  Every task hands on ``k`` rows a question at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship_code
from ..functions.ranking import pad_with_zeros, top_k
from ..functions.text import TO_TOKENS, extract_entities, normalize_entity, tokenize
from ..storage import stored

K1, B = 1.5, 0.75
#: Documents of a block.
BLOCK = 128
#: Terms of questions, and questions, that are broadcast at once; more are searched in groups.
QUESTION_TERMS, QUESTIONS = 500_000, 8192


@dataclass
class LexicalIndex:
    """``counts`` (doc_idx, dl, terms: array of term and tf), stored; ``terms`` (term, df), ``stats`` (n, avgdl; one row)."""

    counts: DataFrame
    docs: DataFrame

    def postings(self, only: DataFrame | None = None, by: str = "term") -> DataFrame:
        """``doc_idx, dl, term, tf``; with ``only``, of the values that its column ``by`` has."""
        rows = self.counts
        if by == "doc_idx":
            rows = rows.join(only.select(by).distinct(), by, "left_semi")
        rows = rows.select("doc_idx", "dl", F.inline("terms"))
        return rows.join(only.select(by).distinct(), by, "left_semi") if only is not None and by == "term" else rows

    @property
    def lengths(self) -> DataFrame:
        return self.counts.select("doc_idx", "dl")

    @property
    def terms(self) -> DataFrame:
        return self.postings().groupBy("term").agg(F.count("*").alias("df"))

    @property
    def stats(self) -> DataFrame:
        return self.lengths.agg(F.count("*").alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def build_index(docs: DataFrame) -> LexicalIndex:
    """Tokens (as ``tokenize`` cuts them) are counted where the texts are read; only the counts are dealt evenly."""
    kind = dict(docs.dtypes)["doc_idx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lengths, terms, tf = [0], [], [], []
            for text in batch.column(1).to_pylist():
                counts = Counter((text or b"").translate(TO_TOKENS).split())
                terms += counts.keys()
                tf += counts.values()
                sizes.append(len(terms))
                lengths.append(sum(counts.values()))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)], ["doc_idx", "dl", "terms"])

    ship_code(docs.sparkSession)
    rows = docs.select("doc_idx", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(run, f"doc_idx {kind}, dl long, terms array<struct<term string, tf long>>")
    return LexicalIndex(stored(counts.repartition("doc_idx"), "counts"), docs)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid, term, weight``: how often the question has the term."""
    terms = queries.select("qid", F.explode(tokenize(F.col("question"))).alias("term"))
    return terms.groupBy("qid", "term").agg(F.count("*").cast("double").alias("weight"))


def term_weights(index: LexicalIndex, weights: DataFrame, k1: float = K1) -> DataFrame:
    """``qid, term, w, mean``: what depends on the term alone, once per question and term, and the mean length."""
    wanted = weights.where("weight != 0")
    df = index.postings(wanted).groupBy("term").agg(F.count("*").alias("df"))
    terms = wanted.join(df, "term").crossJoin(F.broadcast(index.stats))
    return terms.select("qid", "term", (F.col("weight") * idf(F.col("n"), F.col("df")) * (k1 + 1)).alias("w"), (F.col("avgdl") + 1e-9).alias("mean"))


def score_terms(index: LexicalIndex, weights: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``qid, doc_idx, score`` of all documents that share a term with the weighted question."""
    tf = F.col("tf")
    part = F.col("w") * tf / (tf + k1 * (1 - b + b * F.col("dl") / F.col("mean")) + 1e-9)
    parts = index.postings(weights.where("weight != 0")).join(term_weights(index, weights, k1), "term")
    return parts.groupBy("qid", "doc_idx").agg(F.sum(part).alias("score"))


class BlockSearch:
    """The best ``k`` documents of each question among the blocks seen so far.

    Questions are numbers; their terms come sorted by the term's number.  Weights
    may have any sign: a block's bound adds the greatest impacts of terms with
    positive weights only.
    """

    def __init__(self, question: np.ndarray, term: np.ndarray, weight: np.ndarray, n_questions: int, k: int):
        self.question, self.term, self.weight, self.n, self.k = question, term, weight, n_questions, k
        self.q, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # a question with k documents only takes scores from its k-th on
        self.floor = np.full(n_questions, -np.inf)
        self.seen = self.skipped = 0

    def add(self, doc: np.ndarray, place: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """A block: its documents, and postings (place of the document, term, impact)."""
        order = np.lexsort((-impact, term))
        place, term, impact = place[order], term[order], impact[order]
        held, first, size = np.unique(term, return_index=True, return_counts=True)
        low, high = np.searchsorted(self.term, held, "left"), np.searchsorted(self.term, held, "right")
        which, at = spread(low, high - low)
        bound = np.bincount(self.question[at], np.maximum(self.weight[at], 0) * impact[first[which]], self.n)
        live = bound >= self.floor - 1e-9
        asks = live[self.question[at]]
        self.seen += int(size[which].sum())
        self.skipped += int(size[which[~asks]].sum())
        which, at = which[asks], at[asks]
        own, posting = spread(first[which], size[which])
        # accumulators of the live questions only
        row = np.cumsum(live) - 1
        cell = row[self.question[at]][own] * len(doc) + place[posting]
        score = np.bincount(cell, self.weight[at][own] * impact[posting], int(live.sum()) * len(doc))
        hit = np.unique(cell)
        q, found = np.flatnonzero(live)[hit // len(doc)], score[hit]
        good = np.round(found, 9) >= self.floor[q]
        self._keep(q[good], doc[hit[good] % len(doc)], found[good])

    def _keep(self, q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        q, doc, score = np.r_[self.q, q], np.r_[self.doc, doc], np.r_[self.score, score]
        order = np.lexsort((doc, -np.round(score, 9), q))
        q, doc, score = q[order], doc[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.q, self.doc, self.score = q[kept], doc[kept], score[kept]
        last = rank[kept] == self.k - 1
        self.floor[self.q[last]] = np.round(self.score[last], 9)


def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges one after the other, each with the place of its range."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]


def block_search(index: LexicalIndex, terms: pd.DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """``qid, doc_idx, score``: the best ``k`` of each task for the questions of ``terms`` (qid, term, w, mean)."""
    question, qids = pd.factorize(terms["qid"])
    term, vocabulary = pd.factorize(terms["term"])
    order = np.argsort(term, kind="stable")
    mean = terms["mean"].iloc[0] if len(terms) else 1.0
    context = index.counts.sparkSession.sparkContext
    shared = context.broadcast((np.asarray(qids), question[order], term[order], terms["w"].to_numpy()[order], pa.array(vocabulary, pa.string()), mean))
    kinds = dict(index.counts.dtypes)
    qid_kind = "long" if pd.api.types.is_integer_dtype(terms["qid"]) else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, question, term, weight, vocabulary, mean = shared.value
        search = BlockSearch(question, term, weight, len(names), k)
        for batch in batches:
            terms = batch.column(2)
            held = pc.index_in(terms.flatten().field(0), value_set=vocabulary).fill_null(-1).to_numpy()
            tf = terms.flatten().field(1).to_numpy()
            owner = np.repeat(np.arange(len(batch)), pc.list_value_length(terms).to_numpy())
            wanted = np.flatnonzero(held >= 0)
            held, tf, owner = held[wanted], tf[wanted], owner[wanted]
            doc, dl = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            impact = tf / (tf + k1 * (1 - b + b * dl[owner] / mean) + 1e-9)
            for start in range(0, len(doc), BLOCK):
                i, j = np.searchsorted(owner, (start, start + BLOCK))
                if i < j:
                    search.add(doc[start : start + BLOCK], owner[i:j] - start, held[i:j], impact[i:j])
        yield pa.RecordBatch.from_arrays([pa.array(names[search.q].tolist(), qid_type), pa.array(search.doc, pa.int64()), pa.array(search.score)], ["qid", "doc_idx", "score"])

    qid_type = pa.int64() if qid_kind == "long" else pa.string()
    found = index.counts.select("doc_idx", "dl", "terms").mapInArrow(run, f"qid {qid_kind}, doc_idx long, score double")
    return found.withColumn("doc_idx", F.col("doc_idx").cast(kinds["doc_idx"]))


def search(index: LexicalIndex, weights: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` documents of each question, padded with zero scores: ``qid, rank, doc_idx, score``.

    The questions' terms are the small side.  Up to ``QUESTION_TERMS`` of them (and ``QUESTIONS``)
    are broadcast at once; more are searched in groups of questions.
    """
    terms = term_weights(index, weights)
    some = terms.limit(QUESTION_TERMS + 1).toPandas()
    if len(some) <= QUESTION_TERMS and some["qid"].nunique() <= QUESTIONS:
        best = block_search(index, some, k)
    else:
        terms = stored(terms, "terms")
        size = terms.agg(F.count("*").alias("n"), F.countDistinct("qid").alias("questions")).first()
        groups = max(-(-2 * size["n"] // QUESTION_TERMS), -(-2 * size["questions"] // QUESTIONS))
        best = None
        for group in range(groups):
            found = block_search(index, terms.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == group).toPandas(), k)
            best = found if best is None else best.unionByName(found)
    return top_k(pad_with_zeros(best, queries, index.docs, k), k)


def rm3_weights(index: LexicalIndex, queries: DataFrame, hits: DataFrame, fb_docs: int = 10, fb_terms: int = 20, orig_weight: float = 0.5) -> DataFrame:
    """Question and feedback models mixed; equal feedback weights are cut in order of the term."""
    q = query_terms(queries)
    model = q.select("qid", "term", (F.col("weight") / F.sum("weight").over(Window.partitionBy("qid"))).alias("p"))
    per_query = Window.partitionBy("qid")
    feedback = hits.where(F.col("rank") <= fb_docs).select("qid", "doc_idx", F.greatest("score", F.lit(0.0)).alias("s"))
    total = F.sum("s").over(per_query)
    feedback = feedback.select("qid", "doc_idx", F.when(total > 0, F.col("s") / total).otherwise(1 / F.count("*").over(per_query)).alias("w"))
    terms = (
        index.postings(feedback, "doc_idx")
        .join(feedback, "doc_idx")
        .groupBy("qid", "term")
        .agg(F.sum(F.col("w") * F.col("tf") / F.col("dl")).alias("score"))
    )
    kept = top_k(terms, fb_terms, ties=("term",))
    all_kept = F.sum("score").over(per_query)
    fb = kept.select("qid", "term", F.when(all_kept > 0, F.col("score") / all_kept).otherwise(0.0).alias("p"))
    some = fb.select("qid").distinct().withColumn("has", F.lit(True))
    own = model.join(some, "qid", "left").select("qid", "term", F.when(F.col("has"), orig_weight * F.col("p")).otherwise(F.col("p")).alias("p"))
    return own.unionByName(fb.select("qid", "term", ((1 - orig_weight) * F.col("p")).alias("p"))).groupBy("qid", "term").agg(F.sum("p").alias("weight"))


def two_step_weights(
    index: LexicalIndex, queries: DataFrame, hits: DataFrame, k1: int = 10, expand_per_doc: int = 5, max_terms: int = 30,
    entity_normalize: str = "simple", query_weight: float = 1.0,
) -> DataFrame:
    """Tokens of the first entities of the best documents, by 1/rank, and the question's own."""
    seeds = hits.where(F.col("rank") <= k1).select("qid", "rank", "doc_idx")
    texts = index.docs.join(seeds.select("doc_idx").distinct(), "doc_idx", "left_semi")
    entities = texts.select("doc_idx", F.posexplode(extract_entities(F.col("text"))).alias("pos", "entity"))
    if expand_per_doc > 0:
        entities = entities.where(F.col("pos") < expand_per_doc)
    tokens = entities.select("doc_idx", F.explode(tokenize(normalize_entity(F.col("entity"), entity_normalize))).alias("term"))
    added = tokens.join(seeds, "doc_idx").select("qid", "term", (1 / F.col("rank")).alias("score"))
    own = query_terms(queries).select("qid", "term", (F.col("weight") * query_weight).alias("score"))
    weights = added.unionByName(own).groupBy("qid", "term").agg(F.sum("score").alias("score"))
    if max_terms > 0:
        weights = top_k(weights, max_terms, ties=("term",))
    return weights.select("qid", "term", F.col("score").alias("weight"))
