"""Dense retrieval: exact search, hashed approximate search, and pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from ..functions.vectors import l2_normalize
from ..storage import scratch
from .vector_index import build_index

#: Questions are sent to every task up to this many bytes; beyond, they are dealt in blocks.
BROADCAST_BYTES = 64 << 20


def encode(docs: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """Add unit vectors ``vec``; ``encoder`` (any model) gets a batch of texts in a Python worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(batch.fillna("").tolist()), "f4")))

    return docs.withColumn("vec", l2_normalize(run(F.col(text))))


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in model: counts of hashed tokens."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), "f4")
        for k, text in enumerate(texts):
            for token in text.lower().split():
                out[k, zlib.crc32(token.encode()) % dim] += 1
        return out

    return run


def exact_search(vectors: DataFrame, queries: DataFrame, k: int, round_to: int = 9) -> DataFrame:
    """Best ``k`` by dot product: ``qid, rank, doc_idx, score``.

    ``vectors`` (doc_idx, vec) stream through blocked matrix products; each
    block keeps its own best ``k`` of every question, which a window then merges.
    Questions (qid, vec) are the small side: their size is checked, and where it
    exceeds ``BROADCAST_BYTES`` they are dealt in groups that are joined with the
    vectors one after the other.
    """
    rows = queries.count()
    dim = (queries.select(F.size("vec")).first() or [0])[0]
    groups = max(1, -(-rows * max(dim, 1) * 8 // BROADCAST_BYTES))
    out = None
    for group in range(groups):
        own = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == group)
        block = own.select("qid", "vec").toPandas()
        found = _block_search(vectors, block, k, round_to)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k)


def _block_search(vectors: DataFrame, block: pd.DataFrame, k: int, round_to: int) -> DataFrame:
    """Each task's best ``k`` rows of each question: one matrix product a batch, and one frame a batch."""
    q = np.array(block["vec"].tolist(), "f8").reshape(len(block), -1)
    shared = vectors.sparkSession.sparkContext.broadcast((block["qid"].to_numpy(), q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = shared.value
        for batch in batches:
            if not len(batch) or not len(qids):
                continue
            scores = q @ np.array(batch["vec"].tolist(), "f8").T
            idx = batch["doc_idx"].to_numpy()
            if len(idx) > k:
                # all that are not below the k-th, so ties are decided by the number
                order = np.round(scores, round_to)
                floor = -np.partition(-order, k - 1, 1)[:, k - 1]
                row, at = np.nonzero(order >= floor[:, None])
                best = np.lexsort((idx[at], -order[row, at], row))
                row, at = row[best], at[best]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, at = row[kept], at[kept]
            else:
                row, at = (c.ravel() for c in np.indices(scores.shape))
            yield pd.DataFrame({"qid": qids[row], "doc_idx": idx[at], "score": scores[row, at]})

    kinds = dict(vectors.dtypes)
    integer = block["qid"].dtype.kind == "i"
    return vectors.select("doc_idx", "vec").mapInPandas(run, f"qid {'long' if integer else 'string'}, doc_idx {kinds['doc_idx']}, score double")


def ann_search(vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.97, path: str | None = None) -> DataFrame:
    """Best ``k`` by an index of coded lists (see ``vector_index``), probed for this recall; it is built in ``path``, or in a folder of its own.

    This is never a silent stand-in for exact search: callers choose it.
    """
    index = build_index(vectors, path or scratch(vectors.sparkSession, "ann"), k, recall, queries)
    return index.search(queries, k)


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int) -> DataFrame:
    """Order candidates (qid, rank, doc_idx) by a model's scores of question and text; ties keep their rank."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            yield pd.Series(scorer(questions.tolist(), texts.tolist()), dtype="float64")

    pairs = candidates.select("qid", "doc_idx", F.col("rank").alias("before")).join(docs.select("doc_idx", "text"), "doc_idx").join(queries, "qid")
    scored = pairs.select("qid", "doc_idx", "before", run(F.col("question"), F.col("text")).alias("score"))
    return top_k(scored, k, ties=("before",)).drop("before")


def overlap_scorer(questions: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a cross-encoder: the share of the question's words that the text has."""
    out = []
    for question, text in zip(questions, texts, strict=True):
        words = set(question.lower().split())
        out.append(len(words & set(text.lower().split())) / max(1, len(words)))
    return out
