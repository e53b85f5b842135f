"""Removal of word windows that occur before, found by level-wise doubling.

A window of ``window`` words is *repeated* if its word sequence starts earlier:
in a smaller ``doc_id``, or earlier in the same document.  Every word that a
repeated window covers is removed; windows are judged on the input.

Windows of ``window / 4`` words come first.  Of those, each long window answers
for one alone: the one with the least hash in it (rightmost on ties), which is
the same wherever the long window occurs; so about one short window in eight
needs to be looked up, and none that matters is missed.  Only short windows
that occur again are extended to twice their length, and only those that again
occur twice are extended to the full length, where each hash group keeps its
first occurrence and the others are removed.

Occurrences within one batch of documents are settled in the batch, which sends
on one entry per hash; so the entries of a hash are as many as the batches at
most, however often it occurs.  Texts are shuffled only for documents that have
short windows that occur again (about; a bitmap of bounded size picks them).

Defined results: null and empty texts have no words and keep none; rows that
repeat an id and its text are one document, and each of them gets its result;
rows of one id with other texts are documents of their own, ordered by a hash of
the text; texts of any length are used whole; extra columns are dropped; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship_code
from .support import stored
from .words import (
    POSTING_NAMES,
    POSTINGS,
    Flat,
    batches_of_texts,
    keyed_documents,
    likely_members,
    pack_postings,
    part_count,
    rightmost_minima,
    unpack_postings,
)

#: Two multipliers for the two parts of a window's hash.
LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of text for each part of the hash space.
BYTES_PER_PART = 32 << 20

DOC = np.dtype([("doc_id", "<i8"), ("handle", "<i8")])
SPOTS = "handle long, spots binary"


def finish(hashes: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes over the whole word."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def candidate_starts(flat: Flat, window: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each whole window its start, and the start of the part that answers for it at ``level`` words."""
    short = window // 4
    starts = np.flatnonzero(flat.inside(window))
    if level == window:
        return starts, starts
    anchors = rightmost_minima(finish(flat.windows(short, LANES[0])), window - short + 1)[starts]
    return starts, anchors if level == short else np.minimum(anchors, starts + window - level)


def spots_rows(handles: np.ndarray, places: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Per handle its places as packed integers."""
    order = np.lexsort((places, handles))
    handles, places = handles[order], places[order].astype("<u4")
    present, first = np.unique(handles, return_index=True)
    cuts = [*first.tolist(), len(handles)]
    return present.tolist(), [places[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def level_map(window: int, level: int, before: int, parts: int):
    """Batches of documents (doc_id, handle, text, spots of the level before) to postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches, 2):
            flat = Flat(texts)
            starts, answering = candidate_starts(flat, window, level)
            if before:
                spots = np.zeros(len(flat.hashes) + 1, bool)
                for k, packed in enumerate(batch.column(3).to_pylist()):
                    for piece in packed:
                        spots[flat.begins[k] + np.frombuffer(piece, "<u4")] = True
                _, earlier = candidate_starts(flat, window, before)
                answering = answering[spots[earlier]]
            at = np.unique(answering)
            if not len(at):
                continue
            first_lane = finish(flat.windows(level, LANES[0])[at])
            second = finish(flat.windows(level, LANES[1])[at]).astype("<u2")
            docs = np.zeros(len(texts), DOC)
            docs["doc_id"] = batch.column(0).fill_null(np.iinfo("i8").min).to_numpy()
            docs["handle"] = batch.column(1).to_numpy()
            doc = flat.doc[at]
            place = at - flat.begins[doc]
            # what occurs twice in this batch is settled here; its first occurrence speaks for the batch
            order = np.lexsort((place, docs["handle"][doc], docs["doc_id"][doc], second, first_lane))
            a, b = first_lane[order], second[order]
            own = np.zeros(len(order), bool)  # repeats an entry before it
            own[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            leads, group = order[~own], np.cumsum(~own) - 1
            flags = np.zeros(len(leads), "<u2")
            if level == window:
                lead = leads[group]
                itself = (docs[doc[order]] == docs[doc[lead]]) & (place[order] == place[lead])  # rows that repeat a document
                settled = order[own & ~itself]
            else:
                flags[:] = np.bincount(group, minlength=len(leads)) > 1
                settled = order[flags[group] > 0]
            ascending = np.argsort(leads, kind="stable")
            speak, flags = leads[ascending], flags[ascending]
            more = second[speak] if level == window else flags
            yield pack_postings(first_lane[speak], more, place[speak], doc[speak], docs, parts)
            if len(settled):
                # they take the same shuffle, dealt by document, and pass the reducer by
                handles, packed = spots_rows(docs["handle"][doc[settled]], place[settled])
                none = pa.array([b""] * len(handles), pa.binary())
                own_part = pa.array((np.array(handles) % parts).astype("i4"), pa.int32())
                columns = [own_part, none, none, pa.array(packed, pa.binary()), pa.array([np.int64(h).tobytes() for h in handles], pa.binary()), none]
                yield pa.RecordBatch.from_arrays(columns, POSTING_NAMES)

    return run


def level_reduce(last: bool):
    """All entries of one part of the hash space to the spots that occur again."""

    def run(rows: pa.Table) -> pa.Table:
        settled = pc.equal(pc.binary_length(rows["hashes"]), 0)
        done = rows.filter(settled)
        rows = rows.filter(pc.invert(settled))
        out = [pa.table({"handle": pa.array(np.frombuffer(b"".join(done["docs"].to_pylist()), "<i8"), pa.int64()), "spots": done["places"]})]
        if not len(rows):
            return out[0]
        hashes, more, places, docs = unpack_postings(rows, "<u2", DOC)
        if last:
            order = np.lexsort((places, docs["handle"], docs["doc_id"], more, hashes))
            again = np.zeros(len(order), bool)
            again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (more[order][1:] == more[order][:-1])
            lead = order[~again][np.cumsum(~again) - 1]
            found = order[again & ~((docs[order] == docs[lead]) & (places[order] == places[lead]))]
        else:
            _, group, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            # an entry that is flagged is settled in its batch and only tells the others
            found = np.flatnonzero((counts[group] > 1) & (more == 0))
        handles, packed = spots_rows(docs["handle"][found], places[found])
        out.append(pa.table({"handle": pa.array(handles, pa.int64()), "spots": pa.array(packed, pa.binary())}))
        return pa.concat_tables(out)

    return run


def spots_of_level(rows: DataFrame, window: int, level: int, before: int, parts: int) -> DataFrame:
    """Per document the places of its windows of ``level`` words that occur again; stored."""
    mapped = rows.mapInArrow(level_map(window, level, before, parts), POSTINGS)
    spots = mapped.groupBy("part").applyInArrow(level_reduce(level == window), SPOTS)
    spots = spots.groupBy("handle").agg(F.collect_list("spots").alias("spots"))
    return stored(spots, f"spots-{level}")


def word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count and digest of whole documents."""
    for batch in batches:
        counts, digests = [], []
        for text in batch.column(2):
            words = (text.as_py() or b"").split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "handle", "n_words", "whole_sha256"])


def kept_words(text: bytes, spots: list[bytes], window: int) -> tuple[list[bytes], int]:
    """The words that no repeated window covers, and how many it covers."""
    words = text.split()
    change = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate([np.frombuffer(s, "<u4") for s in spots]).astype(np.int64))
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    kept = np.cumsum(change)[:-1] == 0
    return [word for word, keep in zip(words, kept.tolist(), strict=True) if keep], int(len(words) - kept.sum())


def remaining(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, spots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, n = kept_words(text, spots, window)
                whole = b" ".join(words)
                removed.append(n)
                digests.append(hashlib.sha256(whole).hexdigest())
                texts.append(whole.decode("utf-8", "replace") if keep_text else None)
            columns = [batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["handle", "n_removed", "cut_sha256", "cut_text"])

    return run


def cut_rows(keyed: DataFrame, window: int, parts: int, keep_text: bool) -> DataFrame:
    """``handle, n_removed, cut_sha256, cut_text`` of documents that may have repeated windows."""
    if window % 4:
        raise ValueError("window must be a multiple of 4")
    short = window // 4
    spots = spots_of_level(keyed.withColumn("spots", F.lit(None).cast("array<binary>")), window, short, 0, parts)
    some = likely_members(keyed, spots, "handle", spots.count())
    # rows that repeat a document are worked on once
    chosen = stored(some.join(spots, "handle").dropDuplicates(["handle"]).select("doc_id", "handle", "text", "spots"), "candidates")
    rows, before = chosen, short
    for level in (2 * short, window):
        spots = spots_of_level(rows, window, level, before, parts)
        rows, before = chosen.drop("spots").join(spots, "handle").select("doc_id", "handle", "text", "spots"), level
    return rows.mapInArrow(remaining(window, keep_text), "handle long, n_removed long, cut_sha256 string, cut_text string")


def dedup_substrings(documents: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, n_words, n_removed, kept_sha256`` for each row."""
    ship_code(documents.sparkSession)
    keyed = keyed_documents(documents, id_col, text_col)
    cut = cut_rows(keyed, window, part_count(documents, text_col, BYTES_PER_PART), False)
    totals = keyed.mapInArrow(word_totals, "doc_id long, handle long, n_words long, whole_sha256 string")
    return totals.join(cut, "handle", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
    )


def cut_documents(documents: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``documents`` with repeated windows cut out of the texts; rows that lose all their words go.

    Texts without repeated windows stay as they are, those of rows that have no
    words from the start too.
    """
    ship_code(documents.sparkSession)
    keyed = keyed_documents(documents, id_col, text_col)
    cut = cut_rows(keyed, window, part_count(documents, text_col, BYTES_PER_PART), True)
    cut = cut.where("n_removed > 0").select(F.col("handle").alias("cut_handle"), "cut_text")
    own = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # column names of the documents may clash with ours: keep theirs in a struct
    whole = documents.select(F.struct(*documents.columns).alias("row"), own.alias("cut_key"))
    joined = whole.join(cut, F.col("cut_key") == F.col("cut_handle"), "left").where("cut_text is null or cut_text != ''")
    changed = F.col("cut_text").isNotNull()
    columns = []
    for name in documents.columns:
        value = F.col("row").getField(name)
        if name == text_col:
            value = F.coalesce("cut_text", value)
        elif name == size_col:
            value = F.when(changed, F.char_length("cut_text").cast(documents.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return joined.select(*columns)
