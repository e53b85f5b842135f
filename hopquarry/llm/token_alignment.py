"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut the same bytes (a space and the text), so tokens align where
they end at the same byte.  The texts of an Arrow batch lie one after the other;
the running sums of the token lengths are then byte offsets in the whole batch.
One ``bincount`` of the ends of both kinds counts how many tokens end at each
byte: where two do, a group of tokens closes, and the two tokens that end there
are linked.  Sums of the cuts up to each document's borders give its results.

How often a pair of ids is linked is counted over all documents.  A document
keeps each of its pairs once, with how often it has it; what comes back to it is
summed from the counts of its pairs.  Pairs with more than one in ``HOT`` of all
links (so there are fewer than ``HOT``) are broadcast; only links of rarer pairs
are shuffled, and no key of that join has more than this share of the links.

Defined results: null and empty texts, and texts that a tokenizer does not give
back byte by byte, have no tokens: zeros and an empty ``groups_sha256``.  Of ids
that are linked equally often with one B id, all are the best.  Repeated rows
and repeated or null ids each give their own row and count each time.  A text
may have any length: beyond ``PIECE`` characters it is encoded in pieces, cut
before single spaces that no token of either vocabulary reaches across (where a
vocabulary has such tokens, in one).  Extra columns are dropped, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import map_batches, stored, text_or_empty, texts_of

#: Pairs with more than one in so many of all links are broadcast: fewer than this many.
HOT = 100_000
#: Texts that are aligned at once, at about so many characters.
TEXT_RUN = 1 << 20
#: Longer texts are encoded in pieces of about this many characters.
PIECE = 1 << 17
#: A single space between letters or digits: no token of the usual vocabularies reaches across its left side.
BORDER = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: A token that may do so.
ACROSS = re.compile("[^\\W_] |\ufffd ")

SCHEMA = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, groups string, ends array<long>"
)


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(unseen)}


class Vocabulary:
    """What each id stands for in bytes."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.crosses = any(ACROSS.search(t.decode("utf-8", "replace")) for t in tokens)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Aligner:
    """Both tokenizers, loaded once in each Python worker."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a_tokenizer = Tokenizer.from_file(a_path)
        self.a_tokenizer.encode_special_tokens = True
        self.b_tokenizer = SentencePieceProcessor(model_file=b_path)
        alphabet, names, model = byte_alphabet(), self.a_tokenizer.id_to_token, self.b_tokenizer
        special = set(self.a_tokenizer.get_added_tokens_decoder())
        self.a = Vocabulary([names(i).encode() if i in special else bytes(alphabet[c] for c in names(i)) for i in range(self.a_tokenizer.get_vocab_size())])
        self.b = Vocabulary(
            [
                bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
                for i in range(model.get_piece_size())
            ]
        )
        self.whole = self.a.crosses or self.b.crosses
        # each id with what stands behind it within a group, and at the end of its side
        self.a_texts = np.array([f"{i}{end}" for i in range(len(self.a.tokens)) for end in ",|"], object)
        self.b_texts = np.array([f"{i}{end}" for i in range(len(self.b.tokens)) for end in ",;"], object)

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that both tokenizers encode alike alone and together; each stands behind a space."""
        start = 0
        while not self.whole and len(text) - start > PIECE:
            border = BORDER.search(text, start + PIECE)
            if border is None:
                break
            yield text[start : border.start()]
            start = border.end()
        yield text[start:] if start else text

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both, or none if their bytes are not those of a space and the text."""
        if not text:
            return [], []
        a, b = [], []
        for piece in self.pieces(text):
            a += self.a_tokenizer.encode(" " + piece, add_special_tokens=False).ids
            b += self.b_tokenizer.encode(piece, num_threads=1)
        whole = b" " + text.encode("utf-8", "surrogatepass")
        return (a, b) if self.a.joined(a) == whole and self.b.joined(b) == whole else ([], [])


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


def borders(sizes: list[int]) -> np.ndarray:
    return np.r_[0, np.cumsum(np.array(sizes, np.int64))].astype(np.int64)


class Aligned:
    """The aligned tokens of several documents that lie one after the other."""

    def __init__(self, aligner: Aligner, both: list[tuple[list[int], list[int]]]):
        self.aligner = aligner
        self.a_borders, self.b_borders = borders([len(a) for a, _ in both]), borders([len(b) for _, b in both])
        self.a = np.fromiter((i for a, _ in both for i in a), np.int64, self.a_borders[-1])
        self.b = np.fromiter((i for _, b in both for i in b), np.int64, self.b_borders[-1])
        self.a_ends, self.b_ends = np.cumsum(aligner.a.sizes[self.a]), np.cumsum(aligner.b.sizes[self.b])
        at = np.bincount(np.concatenate([self.a_ends, self.b_ends])) if len(self.a) else np.zeros(1, np.int64)
        # a token has one byte at least, so two tokens that end at a byte are of both kinds
        self.a_cut, self.b_cut = at[self.a_ends] == 2, at[self.b_ends] == 2
        self.a_sums, self.b_sums = np.r_[0, np.cumsum(self.a_cut)], np.r_[0, np.cumsum(self.b_cut)]
        self.link_borders = self.a_sums[self.a_borders]
        self.n_links = np.diff(self.link_borders)

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        out = np.empty(len(self.a) + len(self.b), object)
        # before a token stand the tokens of its own kind, and those of the other kind in closed groups
        b_closed, a_closed = np.r_[0, np.flatnonzero(self.b_cut) + 1], np.r_[0, np.flatnonzero(self.a_cut) + 1]
        out[np.arange(len(self.a)) + b_closed[self.a_sums[:-1]]] = self.aligner.a_texts[self.a * 2 + self.a_cut]
        out[np.arange(len(self.b)) + a_closed[self.b_sums[:-1] + 1]] = self.aligner.b_texts[self.b * 2 + self.b_cut]
        all_borders = self.a_borders + self.b_borders
        return ["".join(out[i:j])[:-1] for i, j in zip(all_borders[:-1], all_borders[1:], strict=True)]

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs (A id above, B id in the low 32 bits), once for each document, with how often; and the documents' borders."""
        pair = (self.a[self.a_cut] << 32) | self.b[self.b_cut]
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        order = np.lexsort((pair, doc))
        pair, doc = pair[order], doc[order]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(pair)]).astype(np.int32)
        return pair[first], times, np.searchsorted(doc[first], np.arange(len(self.n_links) + 1))

    def byte_ends(self) -> np.ndarray:
        """Where the groups end, in bytes of their document behind its leading space."""
        ends = self.a_ends[self.a_cut]
        begins = np.r_[0, self.a_ends][self.a_borders[:-1]]
        return ends - np.repeat(begins, self.n_links) - 1


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype("i4"), pa.int32()), pa.array(values, kind))


def aligned_tokens(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row for each document, with its linked ``pairs`` (``times`` each); one narrow stage.

    With ``keep_groups`` also the groups' text and the byte of the text where each ends.
    """

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        aligner = loaded(a_path, b_path)
        texts = texts_of(batch.column(2))
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= TEXT_RUN):
                size += len(texts[stop])
                stop += 1
            part = Aligned(aligner, [aligner.ids(t) for t in texts[start:stop]])
            groups = part.group_texts()
            pairs, times, at = part.distinct_pairs()
            columns = [
                *[c.slice(start, stop - start) for c in batch.columns[:2]],
                pa.array(np.diff(part.a_borders), pa.int64()),
                pa.array(np.diff(part.b_borders), pa.int64()),
                pa.array(part.n_links, pa.int64()),
                pa.array(part.n_links, pa.int64()),
                pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                list_array(pairs, at, pa.int64()),
                list_array(times, at, pa.int32()),
            ]
            if keep_groups:
                columns += [pa.array(groups, pa.string()), list_array(part.byte_ends(), part.link_borders, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])
            start = stop

    names = [field.split()[0] for field in SCHEMA.split(", ")]
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, run, SCHEMA if keep_groups else SCHEMA[: SCHEMA.index(", groups string")])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links of the corpus hold each pair, and whether none of its B id has more."""
    links = aligned.select(F.inline(F.arrays_zip("pairs", "times")))
    counted = links.groupBy("pairs").agg(F.sum("times").alias("count"))
    counts = stored(counted.select(F.col("pairs").alias("pair"), F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b"), "count"), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return stored(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def align_documents(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document.

    A (``a_path``) is a byte-level vocabulary for ``tokenizers``, B (``b_path``)
    a model for ``sentencepiece``.  With ``keep_groups`` the rows also have
    ``groups`` (the text that is hashed) and ``ends`` (array of bytes).
    """
    aligned = stored(aligned_tokens(documents, a_path, b_path, id_col, text_col, keep_groups), "aligned")
    counts = pair_counts(aligned)
    total = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    is_hot = F.col("count") * F.lit(HOT) > F.lit(total)
    hot, rare = F.broadcast(counts.where(is_hot)), counts.where(~is_hot)
    links = aligned.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))
    links = links.toDF("row", "pair", "times")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    own = links.join(hot, "pair").groupBy("row").agg(*sums)
    others = links.join(hot, "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
    both = own.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    out = aligned.drop("pairs", "times").join(both, "row", "left")
    extra = ["groups", "ends"] if keep_groups else []
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256", *extra)
