"""Best-two-fit packing of tokenised documents into sequences of bounded length.

1. One narrow stage tokenises each text and cuts it into pieces of at most
   ``capacity`` ids; only the pieces' lengths and checksums go on.
2. Pieces are dealt by a hash of their own key to shards of about
   ``PER_SHARD`` rows, whatever their source or length, and every shard is
   packed on its own: a bin is filled greedily with the longest piece that
   fits; then its smallest piece is exchanged for two pieces not yet packed
   that fill the widened gap more tightly.
3. Bins that a shard could not fill (its last ones, mostly) are opened again
   and their pieces dealt to far fewer shards.  This repeats until one shard
   holds what is left, so sharding costs next to nothing in the end; after
   ``LEVELS`` rounds the bins that are still open stay as they are.

Defined results: a null or empty text is one piece that holds the closing id
alone; texts of any length are cut into pieces; pieces of equal length are taken in
any order; repeated rows are dealt to shards like any others and packed as documents of their own; extra columns are
dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import map_batches, parts, stored, text_or_empty, texts_of

CAPACITY = 2048
#: Pieces in a shard, at about this number.
PER_SHARD = 2000
#: A bin with at most this share of its capacity free counts as filled.
FILLED = 1 / 256
LEVELS = 8
CACHE_ENTRIES = 300_000
MAX_CACHED = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts from a vocabulary file of the ``tokenizers`` library.

    White space always ends a match of these vocabularies' pattern, so the ids
    of a text are those of its words in turn, and each worker remembers those of
    the words it has met.  Words of common Latin letters go straight to the
    library's merge model; any other word goes through its whole ``encode``.
    Strings of special tokens in a text are ordinary text.
    """

    SIMPLE = regex.compile("[!-~¡-įı-ɏ]+")
    #: The vocabulary's own pre-tokeniser pattern (fixed value).
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, range(128))}
        self.bytes_shown = dict(shown)
        for lead, pairs in ((0xC2, range(0x80, 0xC0)), *((lead, range(0x80, 0xC0)) for lead in range(0xC3, 0xCA))):
            for low in pairs:
                both = byte_level.pre_tokenize_str(bytes([lead, low]).decode())[0][0]
                self.bytes_shown[lead], self.bytes_shown[low] = both
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.bytes_shown)
        ids = np.array([token.id for token in self.model.tokenize(shown)], "<u4").tobytes()
        if len(piece) <= MAX_CACHED:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.SIMPLE.fullmatch(text):
            known = self.pieces.get
            ids = b"".join([known(p) or self._piece(p) for p in self.PATTERN.findall(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= MAX_CACHED:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known, fresh = self.words.get, self._word
        return b"".join([known(word) or fresh(word) for word in text.encode("utf-8", "replace").split()])


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenised_pieces(
    documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each text's ids and the closing id, cut into pieces: position, length and checksum."""
    closing = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        tokenizer = loaded(vocabulary)
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            ids = tokenizer.encode(text) + closing
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                for name, value in zip(out, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, run, PIECES)


class Pool:
    """Lengths not yet packed, with the rows that have them.

    Two integers serve as bit sets: bit n of ``here`` says that length n is
    left, bit ``capacity - n`` of ``turned`` says the same.  The longest length
    up to a gap, and two lengths with a given sum, are then a few operations on
    whole numbers.
    """

    def __init__(self, lengths: Iterable[int], capacity: int):
        self.capacity = capacity
        self.rows: dict[int, list[int]] = defaultdict(list)
        for row, length in enumerate(lengths):
            self.rows[length].append(row)
        self.here = sum(1 << n for n in self.rows)
        self.turned = sum(1 << (capacity - n) for n in self.rows)

    def longest(self, gap: int) -> int:
        """The longest length left that fits into ``gap``, or 0."""
        return max((self.here & ((2 << gap) - 1)).bit_length() - 1, 0) if gap > 0 else 0

    def take(self, length: int) -> int:
        rows = self.rows[length]
        row = rows.pop()
        if not rows:
            self.here &= ~(1 << length)
            self.turned &= ~(1 << (self.capacity - length))
        return row

    def give_back(self, length: int, row: int) -> None:
        self.rows[length].append(row)
        self.here |= 1 << length
        self.turned |= 1 << (self.capacity - length)

    def best_two(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two lengths left whose sum is the largest in ``above < sum <= gap``."""
        for total in range(gap, above, -1):
            # bit n is set where lengths n and total - n are both left
            both = self.here & (self.turned >> (self.capacity - total)) & ((1 << total) - 2)
            if not both:
                continue
            long = both.bit_length() - 1
            if 2 * long == total and len(self.rows[long]) < 2:
                both &= ~(1 << long)
                if not both:
                    continue
                long = both.bit_length() - 1
            return long, total - long
        return None


def best_two_fit(lengths: Iterable[int], capacity: int) -> Iterator[list[tuple[int, int]]]:
    """Bins as lists of (row, length); each length must lie in 1 .. capacity."""
    pool = Pool(lengths, capacity)
    while pool.here:
        packed, gap = [], capacity
        while length := pool.longest(gap):
            packed.append((pool.take(length), length))
            gap -= length
        if gap and len(packed) > 1:
            row, smallest = packed[-1]  # greedy filling goes from long to short
            if two := pool.best_two(gap + smallest, smallest):
                packed.pop()
                for length in two:
                    packed.append((pool.take(length), length))
                pool.give_back(smallest, row)
        yield packed


def _pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One shard's rows with their bin, place in it, and the bin's fill."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
    size = len(pdf)
    bin_of, offset, fill = np.zeros(size, "int64"), np.zeros(size, "int64"), np.zeros(size, "int64")
    for number, packed in enumerate(best_two_fit(pdf["length"].tolist(), capacity)):
        at = 0
        for row, length in packed:
            bin_of[row], offset[row] = number, at
            at += length
        for row, _ in packed:
            fill[row] = at
    return pdf.assign(bin=bin_of, offset=offset, fill=fill)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """Give each row (``PIECES``) a sequence and its place there.

    ``pieces`` must be cheap to read again: store it first.
    """
    names = [name.split()[0] for name in PIECES.split(", ")]
    left, done, level = pieces.select(*names), None, 0
    packed_schema = PIECES + ", shard long, bin long, offset long, fill long"
    enough = int(capacity * (1 - FILLED))
    rows = left.count()
    while True:
        shards = parts(rows, per_shard * (1 if level == 0 else 2))
        # the place in the stored rows deals repeated rows to different shards, the same ones at any attempt
        shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level), F.monotonically_increasing_id()), F.lit(shards))
        packed = stored(
            left.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda pdf: _pack_shard(pdf, capacity), packed_schema),
            f"packed-{level}",
        )
        sequence = (F.lit(level) * (1 << 56) + F.col("shard") * (1 << 24) + F.col("bin")).cast("long")
        last = shards == 1 or level == LEVELS - 1
        kept = packed if last else packed.where(F.col("fill") >= enough)
        out = kept.select(*names, sequence.alias("sequence_id"), F.col("offset"))
        done = out if done is None else done.unionByName(out)
        if last:
            return done
        left = packed.where(F.col("fill") < enough).select(*names)
        rows, level = left.count(), level + 1
        if not rows:
            return done


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise ``documents`` and pack every piece; one row per piece (``PACKED``)."""
    return pack(stored(tokenised_pieces(documents, vocabulary, capacity, end_id), "pieces"), capacity)
