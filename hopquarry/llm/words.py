"""Words, window hashes and packed postings that the word-based operators share.

Texts are taken as UTF-8 and cut at ASCII white space, so ``bytes.split`` gives
exactly the matches of ``WORD_PATTERN``.  The words of many documents form one
flat array of 64-bit hashes; all window hashes come from it by whole-array
arithmetic.

Postings travel packed: one row per batch and part of the hash space, with the
hashes, the positions and a table of the documents they stand in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose hashes a worker remembers.
CACHE_ENTRIES = 120_000
#: Words that are worked on at once, at about this number.
FLAT_WORDS = 150_000
#: Bits of a membership bitmap, at most: 8 MB.
BITMAP_BITS = 26


class WordHashes(dict):
    """Hash of each word met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


#: A-Z to a-z; every ASCII character but letters and digits to a space.
TO_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def ascii_words(data: bytes) -> list[bytes]:
    """Matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in the text with A-Z lower-cased, as UTF-8."""
    return data.translate(TO_WORDS).split()


def lower_ascii(data: bytes) -> bytes:
    return data.lower()  # on bytes, only A-Z change


class Flat:
    """Word hashes of several documents, one after the other."""

    def __init__(self, texts: Iterable[bytes]):
        arrays = [hash_words(text.split()) for text in texts]
        self.sizes = np.array([len(a) for a in arrays], np.int64)
        self.hashes = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.doc = np.repeat(np.arange(len(arrays)), self.sizes)

    def windows(self, length: int, multiplier: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """Hash of the window of ``length`` words at each position, across ends of documents too.

        Lengths are built by doubling: two windows side by side make one of
        twice the length.
        """
        own = self.hashes if hashes is None else hashes
        out, done, size = None, 0, len(own)
        power, reach = own, 1
        factor = np.uint64(multiplier)
        with np.errstate(over="ignore"):
            scale = factor  # multiplier ** reach
            while True:
                if length & reach:
                    if out is None:
                        out, done, out_scale = power, reach, scale
                    else:
                        n = max(0, size - done - reach + 1)
                        out = out[:n] * scale + power[done : done + n]
                        done += reach
                if 2 * reach > length:
                    return out[: max(0, size - length + 1)]
                n = max(0, size - 2 * reach + 1)
                power = power[:n] * scale + power[reach : reach + n]
                scale = scale * scale
                reach *= 2

    def inside(self, length: int) -> np.ndarray:
        """Whether the window at each position lies within one document."""
        n = max(0, len(self.hashes) - length + 1)
        return self.doc[:n] == self.doc[length - 1 : length - 1 + n]


def rightmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, rightmost on ties, of ``width`` values from each position on."""
    n = max(0, len(values) - width + 1)
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        m = len(at) - step
        left, right = at[:m], at[step:]
        at = np.where(values[right] <= values[left], right, left)
        reach += step
    return at[:n]


def batches_of_texts(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``FLAT_WORDS`` words each, and their texts as bytes."""
    for batch in batches:
        column = batch.column(text_at)
        size, start, held = len(column), 0, 0
        texts: list[bytes] = []
        for k in range(size):
            text = column[k].as_py() or b""
            texts.append(text)
            held += len(text)
            if held > 6 * FLAT_WORDS or k + 1 == size:
                yield batch.slice(start, k + 1 - start), texts
                start, held, texts = k + 1, 0, []


POSTINGS = "part int, hashes binary, more binary, places binary, docs binary, counts binary"
POSTING_KINDS = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
POSTING_NAMES = [x.split()[0] for x in POSTINGS.split(", ")]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash space, by the high bits; the low bits do not depend on them."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def pack_postings(
    hashes: np.ndarray, more: np.ndarray, places: np.ndarray, doc: np.ndarray, docs: np.ndarray, parts: int, part: np.ndarray | None = None
) -> pa.RecordBatch:
    """Rows of ``POSTINGS``: entries dealt by hash, or as ``part`` says; ``doc`` must ascend.

    ``more`` are further bits of the hashes, ``docs`` a structured array with a
    row for each document.
    """
    part = part_of(hashes, parts) if part is None else part
    order = np.argsort(part, kind="stable")
    present, cuts = np.unique(part[order], return_index=True)
    rows: list[tuple] = []
    for p, begin, end in zip(present.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        own = order[begin:end]
        present, counts = np.unique(doc[own], return_counts=True)
        place = places[own]
        place = place.astype("<u2") if not len(place) or place.max() < 1 << 16 else place.astype("<u4")
        rows.append((int(p), hashes[own].tobytes(), more[own].tobytes(), place.tobytes(), docs[present].tobytes(), counts.astype("<u4").tobytes()))
    columns = zip(*rows, strict=True) if rows else ([],) * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, POSTING_KINDS, strict=True)], POSTING_NAMES)


def unpack_postings(rows: pa.Table, more_kind: str, doc_kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries of the rows: hashes, further bits, places, and documents."""
    hashes, more, places, docs = [], [], [], []
    for row in rows.to_pylist():
        own = np.frombuffer(row["hashes"], "<u8")
        hashes.append(own)
        more.append(np.frombuffer(row["more"], more_kind) if row["more"] else np.zeros(len(own), more_kind))
        wide = "<u4" if len(row["places"]) == 4 * len(own) else "<u2"
        places.append(np.frombuffer(row["places"], wide).astype(np.int64))
        docs.append(np.repeat(np.frombuffer(row["docs"], doc_kind), np.frombuffer(row["counts"], "<u4")))
    return np.concatenate(hashes), np.concatenate(more), np.concatenate(places), np.concatenate(docs)


def part_count(documents: DataFrame, text_col: str, bytes_per_part: int, least: int = 64) -> int:
    """Parts of the hash space, in proportion to all texts' bytes."""
    total = documents.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(least, -(-total // bytes_per_part))


def row_handle(id_col: str, text_col: str) -> Column:
    """Tells rows of one id but other text apart."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed_documents(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``handle`` and the text in UTF-8; the handle tells rows of one id but other text apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_handle(id_col, text_col).alias("handle"),
        F.encode(text, "UTF-8").alias("text"),
    )


def likely_members(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """The rows whose ``key`` is among ``keys``, and a few more.

    A bitmap of at most 2 ** ``BITMAP_BITS`` bits is broadcast, however many
    keys there are; an exact join should follow.
    """
    bits = min(BITMAP_BITS, max(10, (16 * max(n_keys, 1)).bit_length()))

    def slot(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << bits))

    words = (
        keys.select(slot(F.col(key)).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("bitmap_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bitmap_bits"))
    )
    marked = rows.withColumn("bitmap_slot", slot(F.col(key))).withColumn("bitmap_word", F.shiftright("bitmap_slot", 6))
    found = marked.join(F.broadcast(words), "bitmap_word").where(F.expr("shiftright(bitmap_bits, cast(bitmap_slot % 64 as int)) & 1L") == 1)
    return found.select(*rows.columns)
