"""A stored index of vectors: coarse lists, residual codes, and probes learnt for a recall.

Each vector lies in the list of its nearest centroid; what is left of it is coded
by a codebook per group of components.  A search scans the codes of the lists that
a question probes, from tables of its products with the codewords, and
reranks the best of them by the exact product.  How many lists are probed and how
many rows are reranked is learnt when the index is built, from sample questions whose exact answers
among all rows are found first.

An index is a folder of Parquet tables: it is built once and opened again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship_code
from ..functions.ranking import top_k
from ..functions.vectors import dot

#: Rows that centroids and codebooks are fitted on, and questions that probes are learnt from.
SAMPLE, ASKED = 50_000, 200
#: The root of the rows, in these bounds.
LISTS = (1, 4096)
GROUP, CODEWORDS, FIT_ROUNDS = 4, 256, 8
#: Questions that are broadcast at once, with their tables; more are searched in groups.
QUESTIONS = 2048
SEED = 42


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = [((centres * centres).sum(1) - 2 * points[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(points), 4096)]
    return np.concatenate(own) if own else np.zeros(0, np.int64)


def k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Codes:
    """Centroids and codebooks, and what was learnt: lists to probe and rows to rerank."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int = 0
    depth: int = 0

    @classmethod
    def fitted(cls, sample: np.ndarray, lists: int) -> Codes:
        rng = np.random.default_rng(SEED)
        centres = k_means(sample, lists, rng)
        left = sample - centres[nearest(sample, centres)]
        return cls(centres, [k_means(left[:, p], CODEWORDS, rng) for p in cls.groups(sample.shape[1])])

    @staticmethod
    def groups(dim: int) -> list[np.ndarray]:
        return np.array_split(np.arange(dim), max(1, -(-dim // GROUP)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centres)
        left = x - self.centres[own]
        return own, np.stack([nearest(left[:, p], book) for p, book in zip(self.groups(x.shape[1]), self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each question with all codewords: question, group, codeword."""
        out = np.zeros((len(q), len(self.books), CODEWORDS), "f4")
        for k, (p, book) in enumerate(zip(self.groups(q.shape[1]), self.books, strict=True)):
            out[:, k, : len(book)] = q[:, p] @ book.T
        return out


class Best:
    """The best rows of each question so far, ``depth`` at most."""

    def __init__(self, depth: int):
        self.depth = depth
        self.q, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "f4")
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append((q, doc, score))
        self.held += len(q)
        if self.held > 2_000_000:
            self.settle()

    def settle(self) -> None:
        parts = [(self.q, self.doc, self.score), *self.waiting]
        q, doc, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((doc, -score, q))
        q, doc, score = q[order], doc[order], score[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.depth
        self.q, self.doc, self.score = q[kept], doc[kept], score[kept]
        self.waiting, self.held = [], 0


def matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), "f8").reshape(len(rows), -1)


@dataclass
class VectorIndex:
    """``rows`` (doc_idx, list, code, vec), stored in order of their lists, and the codes that they stand in."""

    rows: DataFrame
    codes: Codes | None

    def coded_search(self, asked: pd.DataFrame, probes: int, depth: int) -> DataFrame:
        """``qid, doc_idx, coded``: each task's best ``depth`` rows of each question by their codes."""
        codes, q = self.codes, matrix(asked["vec"])
        base = q @ codes.centres.T
        reached = np.argsort(-base, 1, kind="stable")[:, :probes]
        integer = pd.api.types.is_integer_dtype(asked["qid"])
        shared = self.rows.sparkSession.sparkContext.broadcast((asked["qid"].to_numpy(), base.astype("f4"), reached, codes.tables(q)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, base, reached, tables = shared.value
            best = Best(depth)
            for batch in batches:
                which, doc = batch.column(1).to_numpy(), batch.column(0).to_numpy()
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
                for one in np.unique(which):
                    asking = np.flatnonzero((reached == one).any(1))
                    own = np.flatnonzero(which == one)
                    for k in range(0, len(asking), max(1, 2_000_000 // len(own))):
                        some = asking[k : k + max(1, 2_000_000 // len(own))]
                        score = np.repeat(base[some, one][:, None], len(own), 1)
                        for p in range(code.shape[1]):
                            score += tables[some, p][:, code[own, p]]
                        if len(own) > depth:
                            at = np.argpartition(-score, depth - 1, 1)[:, :depth]
                        else:
                            at = np.broadcast_to(np.arange(len(own)), score.shape)
                        best.add(np.repeat(some, at.shape[1]), doc[own[at.ravel()]], np.take_along_axis(score, at, 1).ravel())
            best.settle()
            names = pa.array(qids[best.q].tolist(), pa.int64() if integer else pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(best.doc, pa.int64()), pa.array(best.score.astype("f8"))], ["qid", "doc_idx", "coded"])

        # only lists that some question probes are read
        wanted = self.rows.where(F.col("list").isin(np.unique(reached).tolist())) if probes < len(codes.centres) else self.rows
        return wanted.select("doc_idx", "list", "code").mapInArrow(run, f"qid {'long' if integer else 'string'}, doc_idx long, coded double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """``qid, rank, doc_idx, score``: the best ``k`` by the exact product among the best coded rows of the probed lists.

        ``queries`` (qid, vec) are the small side: ``QUESTIONS`` are broadcast at once, more are searched in groups.
        """
        asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec"))
        probes, depth = probes or (self.codes.probes if self.codes else 0), max(k, depth or (self.codes.depth if self.codes else 0))
        groups = max(1, -(-2 * asked.count() // QUESTIONS) if self.codes else 1)
        out = None
        for group in range(groups):
            own = (asked if groups == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == group)).toPandas()
            if not len(own) or not self.codes:
                continue
            found = self.coded_search(own, probes, depth)
            out = found if out is None else out.unionByName(found)
        if out is None:
            kind = dict(queries.dtypes)["qid"]
            return queries.sparkSession.createDataFrame([], f"qid {kind}, doc_idx long, score double, rank int")
        best = top_k(out.withColumn("score", F.col("coded")), depth).select("qid", "doc_idx")
        pairs = best.join(self.rows.select("doc_idx", F.col("vec").alias("a")), "doc_idx").join(asked.withColumnRenamed("vec", "b"), "qid")
        return top_k(pairs.select("qid", "doc_idx", dot(F.col("a"), F.col("b")).alias("score")), k)

    def learn(self, asked: DataFrame, k: int, recall: float, among_rows: bool) -> None:
        """Set probes and depth so that both together keep this share of the ``k`` best rows of the questions.

        Questions that are rows themselves (``among_rows``) do not count as their own answers.
        """
        from .dense import exact_search

        codes = self.codes
        found = exact_search(self.rows.select("doc_idx", "vec"), asked, k + among_rows)
        truth = (found.where("qid != doc_idx") if among_rows else found).join(self.rows.select("doc_idx", "list"), "doc_idx").select("qid", "doc_idx", "list").toPandas()
        own = asked.toPandas()
        base = matrix(own["vec"]) @ codes.centres.T
        place = np.argsort(np.argsort(-base, 1, kind="stable"), 1)
        row = pd.Series(np.arange(len(own)), own["qid"])
        lists = place[row[truth["qid"]].to_numpy(), truth["list"].to_numpy()]
        share = (1 + recall) / 2
        if not len(lists):
            codes.probes, codes.depth = len(codes.centres), 2 * k
            return
        codes.probes = int(np.quantile(lists, share, method="higher")) + 1
        deep = 50 * k
        ranked = top_k(self.coded_search(own, codes.probes, deep).withColumn("score", F.col("coded")), deep).select("qid", "doc_idx", "rank").toPandas()
        places = truth.merge(ranked, "left", ["qid", "doc_idx"])["rank"]
        # of those that the probed lists hold
        codes.depth = max(2 * k, int(np.quantile(places.dropna(), share, method="higher"))) if places.notna().any() else deep

    def save(self, path: str) -> VectorIndex:
        """Write the index; the rows in order of their lists, so a list is read alone."""
        spark = self.rows.sparkSession
        self.rows.repartitionByRange("list", "doc_idx").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/rows")
        tables = [] if self.codes is None else [(-1, self.codes.centres), *enumerate(self.codes.books)]
        parts = [(int(t), k, v.tolist()) for t, table in tables for k, v in enumerate(table)]
        spark.createDataFrame(parts, "part int, place int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")
        learnt = [] if self.codes is None else [(self.codes.probes, self.codes.depth)]
        spark.createDataFrame(learnt, "probes int, depth int").coalesce(1).write.mode("overwrite").parquet(f"{path}/learnt")
        return VectorIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        """An index that was saved before; only its centroids and codebooks are read now."""
        ship_code(spark)
        rows = spark.read.parquet(f"{path}/rows")
        parts = spark.read.parquet(f"{path}/codes").toPandas().sort_values(["part", "place"])
        if not len(parts):
            return VectorIndex(rows, None)
        tables = {int(part): np.array(own["vec"].tolist(), "f8") for part, own in parts.groupby("part")}
        learnt = spark.read.parquet(f"{path}/learnt").first()
        return VectorIndex(rows, Codes(tables[-1], [tables[p] for p in range(len(tables) - 1)], learnt["probes"], learnt["depth"]))


def build_index(vectors: DataFrame, path: str, k: int = 10, recall: float = 0.97, asked: DataFrame | None = None) -> VectorIndex:
    """Index ``vectors`` (doc_idx, vec; null vectors are left out) in the folder ``path``.

    Probes and depth are learnt for the best ``k`` at this recall, from ``asked`` (qid, vec) or, without it, from some of the rows.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    known = vectors.where("vec is not null").select(F.col("doc_idx").cast("long").alias("doc_idx"), F.col("vec").cast("array<double>").alias("vec"))
    total = known.count()
    lists = int(np.clip(np.sqrt(total), *LISTS))
    # bounded samples: the rows of the least hashes
    sample = known.orderBy(F.xxhash64("doc_idx"), "doc_idx").limit(max(SAMPLE, 12 * lists)).toPandas()
    codes = Codes.fitted(matrix(sample["vec"]), lists) if total else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, code = codes.encode(matrix(batch.column(1).to_pandas()))
            columns = [*batch.columns, pa.array(own.astype("i4")), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_idx", "vec", "list", "code"])

    rows = known.mapInArrow(run, "doc_idx long, vec array<double>, list int, code binary")
    index = VectorIndex(rows, codes).save(path)
    if codes is not None:
        among_rows = asked is None
        if among_rows:
            asked = spark.createDataFrame(sample[:ASKED].rename(columns={"doc_idx": "qid"}), "qid long, vec array<double>")
        else:
            asked = asked.select("qid", F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("qid"), "qid").limit(ASKED)
        index.learn(asked, k, recall, among_rows)
        learnt = spark.createDataFrame([(index.codes.probes, index.codes.depth)], "probes int, depth int")
        learnt.coalesce(1).write.mode("overwrite").parquet(f"{path}/learnt")
    return index
