"""Byte-level BPE encoding and decoding in linear time.

A token sequence is the BPE encoding of its bytes exactly if every two
neighbours are *compatible*: encoding their joined bytes alone gives the two
back.  So no merge loop runs.  The longest tokens are taken from left to right,
each neighbouring pair is looked up in a memo, and only where a pair is not
compatible the encoder steps back to the next shorter token; a place that once
led nowhere is never tried again, so the work is linear in the text.

The longest matches come from an Aho-Corasick automaton over the vocabulary,
whose keys are the tokens' bytes mapped to Latin-1 characters one to one.

Defined results: null and empty texts give no ids; a text may have any length
(pieces longer than ``MAX_CACHED`` characters are encoded but not remembered);
repeated rows and repeated ids each give their own row; extra columns are
dropped, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import map_batches, text_or_empty, texts_of

#: White space as the pattern's ``\s`` has it, and the cut at it: one leading
#: space belongs to what follows, other white space stands alone.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
MAX_CACHED = 64
CACHE_ENTRIES = 400_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBPE:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token_bytes: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.splits: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.reach = max(map(len, ranks), default=1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self._learn()
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def _learn(self) -> None:
        """Find each token's last merge, by rank, and the tokens that begin it."""
        ranks = self.ranks
        usable = set()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.splits[rank] = (rank, rank)
                usable.add(token)
                continue
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is None or right is None or left not in self.splits or right not in self.splits:
                    continue
                if left < rank and right < rank and self._check(left, right):
                    self.splits[rank] = (left, right)
                    self.joined[left, right] = rank
                    usable.add(token)
                    break
        for token in usable:
            rank = ranks[token]
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), -1)
        self.automaton.make_automaton()

    def _check(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two tokens comes before their own merges."""
        splits, joined = self.splits, self.joined
        before = 1 << 40
        while True:
            across = joined.get((left, right))
            if across is not None and across < before:
                return False
            # undo the later of the two tokens' own last merges
            if left > right:
                before, left = left, splits[left][1]
                whole = left == before
                if whole:
                    before, inner = right + 1, splits[right][0]
                    if inner == right:
                        return True
                    right = inner
            else:
                before, inner = right + 1, splits[right][0]
                if inner != right:
                    right = inner
                else:
                    before, inner = left, splits[left][1]
                    if inner == left:
                        return True
                    left = inner

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 2_000_000:
                self.memo.clear()
            known = self.memo[key] = self._check(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        latin = piece.decode("latin-1")
        memo, compatible, matches = self.memo.get, self.compatible, self.automaton.iter_long
        token_bytes, shorter, size, reach = self.token_bytes, self.shorter, len(latin), self.reach
        ids: list[int] = []
        at, last = 0, -1
        for end, token in matches(latin):  # the longest tokens, as far as they go together
            if last >= 0 and not (memo((last, token)) or compatible(last, token)):
                break
            ids.append(token)
            last, at = token, end + 1
        if at == size:
            return ids
        dead = bytearray(size + 1)
        token = shorter[token]
        while True:
            while token < 0:  # nothing goes on from here: the token before must be shorter
                dead[at] = 1
                last = ids.pop()
                at -= len(token_bytes[last])
                token = shorter[last]
            end = at + len(token_bytes[token])
            if dead[end] or (ids and not (memo((ids[-1], token)) or compatible(ids[-1], token))):
                token = shorter[token]
                continue
            ids.append(token)
            at = end
            if at == size:
                return ids
            token = next(matches(latin[at : at + reach]))[1]

    def _chunk(self, chunk: str) -> bytes:
        """Ids, little-endian, of text between two cuts at white space."""
        out = []
        for piece in self.pattern.findall(chunk):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = np.asarray(self.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(piece) <= MAX_CACHED:
                    if len(self.pieces) >= CACHE_ENTRIES:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out.append(ids)
        whole = b"".join(out)
        if len(chunk) <= MAX_CACHED:
            if len(self.chunks) >= CACHE_ENTRIES:
                self.chunks.clear()
            self.chunks[chunk] = whole
        return whole

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        known, fresh = self.chunks.get, self._chunk
        return b"".join([known(chunk) or fresh(chunk) for chunk in CHUNK.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """One encoder for each vocabulary and Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.from_file(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(
    documents: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encode each text, decode the ids, and return counts and digests of both.

    With ``keep_ids`` the row also has ``ids`` (array of long) and ``decoded``
    (binary).  One narrow stage: no shuffle.
    """
    schema = SCHEMA + (", ids array<long>, decoded binary" if keep_ids else "")

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        coder = loaded(vocabulary, pattern)
        counts, ids_sha, decoded_sha, ids_out, decoded_out = [], [], [], [], []
        for text in texts_of(batch.column(1)):
            ids = coder.encode(text)
            decoded = coder.decode(ids)
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            if keep_ids:
                ids_out.append(np.frombuffer(ids, "<u4").astype("int64"))
                decoded_out.append(decoded)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns += [pa.array(ids_out, pa.list_(pa.int64())), pa.array(decoded_out, pa.binary())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, run, schema)
