"""Importance resampling towards a target distribution.

Features of a text are its words and its pairs of neighbouring words, hashed
into buckets.  Identical texts are collapsed first, by grouping the full text:
features and weight of a text are worked out once, and its bucket counts are
multiplied by how often it occurs.  A bucket's gain is the floored logarithm of
its smoothed share in the target against that in the corpus; a text's weight is
the mean gain of its features.  Weights are joined back by the text's digest,
and only then each document's own noise is added, so the highest scores are a
sample without replacement (Gumbel's way).

The buckets (a parameter) bound what is collected: one number each.  A text that
makes up more than one in ``HOT_SHARE`` of all rows is joined in salted parts,
and ranks come from sorted ranges that are shifted by the sizes of those before.

Defined results: a null text has no words (nor has an empty one), so
``n_features`` and ``weight`` are 0; a null id hashes as an empty one.  Equal
scores go to the smaller id, null ids first; of repeated rows with equal scores each has its
own rank.  Texts may have any length; extra columns are dropped, whatever their
names; empty tables (either) give what the formulas say, an empty corpus an
empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship_code
from ..operators.graph import numbered
from .support import stored, text_or_empty
from .words import ascii_words

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7
#: A text with more than one in so many of all rows is joined in parts of at most that share.
HOT_SHARE = 1000
#: Features whose buckets a worker remembers.
CACHE_ENTRIES = 300_000


class FeatureBuckets(dict):
    """Bucket of each feature met so far; a pair of words is joined by a space."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes | tuple[bytes, bytes]) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        whole = feature if isinstance(feature, bytes) else b" ".join(feature)
        value = self[feature] = zlib.crc32(whole) % self.buckets
        return value


def bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured_texts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``digest, n, n_words, features``: each text once, how often it occurs, and the packed buckets of all its features."""
    kind = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = FeatureBuckets(buckets)
        for batch in batches:
            n_words, packed = [], []
            for text in batch.column(2).to_pylist():
                words = ascii_words(text)
                n_words.append(len(words))
                found = [*map(known.__getitem__, words), *map(known.__getitem__, zip(words, words[1:]))]  # noqa: B905
                packed.append(np.array(found, kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(packed, pa.binary())], ["digest", "n", "n_words", "features"]
            )

    ship_code(texts.sparkSession)
    once = texts.groupBy("text").agg(F.count("*").alias("n"))
    rows = once.select(digest_of(F.col("text")).alias("digest"), "n", F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "digest binary, n long, n_words long, features binary"), "features")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flat_features(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All packed features of a batch, and how many each row has."""
    packed = batch.column("features").to_pylist()
    flat = np.frombuffer(b"".join(packed), kind)
    return flat, np.array([len(p) for p in packed], np.int64) // np.dtype(kind).itemsize


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows of the corpus: one sum for each task and bucket, then one for each bucket."""
    kind = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            flat, sizes = flat_features(batch, kind)
            times = np.repeat(batch.column("n").to_numpy(), sizes)
            # sums of whole numbers are exact in doubles below 2 ** 53, far above a batch
            held += np.bincount(flat, times, buckets).astype(np.int64)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["bucket", "held"])

    sums = featured.select("n", "features").mapInArrow(run, "bucket long, held long").groupBy("bucket").agg(F.sum("held").alias("held"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # a row for each bucket, at most
        out[row["bucket"]] = row["held"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share against source share, floored, each with one more feature a bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted_texts(featured: DataFrame, gains: np.ndarray) -> DataFrame:
    """``digest, n, n_words, n_features, weight`` of each text."""
    kind = bucket_type(len(gains))
    shared = featured.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            flat, sizes = flat_features(batch, kind)
            sums = np.r_[0, np.cumsum(own[flat])]
            ends = np.cumsum(sizes)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            columns = [batch.column("digest"), batch.column("n"), batch.column("n_words"), pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "n_words", "n_features", "weight"])

    return stored(featured.mapInArrow(run, "digest binary, n long, n_words long, n_features long, weight long"), "weights")


def document_noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample_documents(
    documents: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn."""
    featured = featured_texts(documents.select(text_or_empty(text_col).alias("text")), buckets)
    wanted = featured_texts(target.select(text_or_empty(target_col).alias("text")), buckets)
    weights = weighted_texts(featured, bucket_gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets)))
    total = weights.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = F.ceil(F.col("n") * HOT_SHARE / max(total, 1)).cast("long")
    hot = weights.select("digest", parts.alias("parts")).where("parts > 1")  # fewer than HOT_SHARE
    row = F.monotonically_increasing_id().alias("row")
    keyed = documents.select(row, F.col(id_col).cast("long").alias("doc_id"), digest_of(text_or_empty(text_col)).alias("digest")).join(F.broadcast(hot), "digest", "left")
    keyed = keyed.withColumn("salt", F.coalesce(F.pmod("row", "parts"), F.lit(0).cast("long"))).drop("parts")
    salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    score = (F.col("weight") + document_noise(F.col("doc_id"), seed)).alias("score")
    scored = stored(keyed.join(salted, ["digest", "salt"]).select("row", "doc_id", "n_words", "n_features", "weight", score), "scored")
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = long_enough.count() * percent // 100
    placed = numbered(long_enough.withColumn("below", -F.col("score")), ["below", "doc_id", "row"], "order")
    rank = F.when(F.col("order") < drawn, F.col("order") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank).unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
