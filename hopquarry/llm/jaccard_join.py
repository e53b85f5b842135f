"""Near-duplicate documents: an exact Jaccard self-join on word shingles.

A document's set holds the hashes of its distinct ``SHINGLE``-word shingles,
lower-cased (A-Z).  Documents with equal sets form one class from the start: a
class's *key* is a hash of the set, so copies need no pairs.

Every class sends out the postings of its prefix: its rarest shingles, as many
as any similar set must share one of.  Rare comes first by a table of the
frequent shingles, counted over all documents (bounded; any fixed order gives
the same links, so the bound costs time at most).  Classes that meet at a
shingle become a candidate pair if lengths and places allow that shingle to be
the first that they share: a similar pair passes at its first shared shingle,
so nothing is lost, and members of a bucket that no other can pass with leave it
at once.  Each pair is verified once, on the whole sets, after a suffix filter.

Buckets of more than ``SMALL`` classes do not emit all their pairs.  There each
class is first paired with a few leaders only; shingles of very many documents
are salted, each share of a bucket has leaders of its own, and these meet too.
Then components show which buckets still hold classes of several components.
Only pairs *across* components are left there; they are compared in chunks by
blocks, on signatures of the whole sets, and what passes is verified.  So no
link between two different sets is lost that could join components, and a bucket
of near copies emits pairs in proportion to its size.  (The comparisons of
signatures, not the rows, grow with the product of what is inside and outside
a bucket's largest component.)

Defined results: null and empty texts have no shingles and are linked with
nothing; with fewer than ``SHINGLE`` words the whole sequence is the one
shingle; texts of any length are used whole; links at exactly the threshold
count; repeated rows get the result of their set each; repeated ids of other
texts are nodes of their own; a null id is never the least, so it is the result
only where a component has no other; extra columns are dropped; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship_code
from .components import connected_components
from .support import stored
from .words import (
    POSTINGS,
    Flat,
    batches_of_texts,
    keyed_documents,
    likely_members,
    lower_ascii,
    pack_postings,
    part_count,
    part_of,
    unpack_postings,
)

SHINGLE = 5
MULTIPLIER = 0x9E3779B97F4A7C15
#: Links have ``7 * overlap >= 3 * (sum of sizes)``: a Jaccard index of 0.75.
#: Entries of the table of frequent shingles.
FREQUENT = 262_144
#: Shingles are counted in runs of about so many; those that several documents of a run have are reported.
COUNTED = 4_000_000
#: Buckets of more classes are first joined through leaders.
SMALL = 8
#: A shingle of more documents is dealt to several parts, of about so many each.
SALTED = 1024
BYTES_PER_PART = 32 << 20
#: Bits of a signature for each shingle, at least: for single pairs, and in mixed buckets; bits in all, at most.
COARSE, FINE, SIGNATURE_BITS = 4, 8, 1 << 15
#: Members and outsiders of a mixed bucket that are compared in one task.
CHUNK, BLOCK = 2048, 1024

DOC = np.dtype([("key", "<i8"), ("size", "<i4")])


class Sets:
    """The shingle sets of several documents, one after the other: sorted distinct hashes."""

    def __init__(self, texts: list[bytes]):
        texts = [lower_ascii(t) for t in texts]
        flat = Flat(texts)
        inside = flat.inside(SHINGLE)
        hashes = flat.windows(SHINGLE, MULTIPLIER)[inside]
        doc = flat.doc[: len(inside)][inside]
        short = np.flatnonzero((flat.sizes > 0) & (flat.sizes < SHINGLE))
        if len(short):
            own = [xxhash.xxh3_64_intdigest(b" ".join(texts[k].split()), int(flat.sizes[k])) for k in short]
            hashes = np.concatenate([hashes, np.array(own, np.uint64)])
            doc = np.concatenate([doc, short])
        with np.errstate(over="ignore"):
            hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            hashes ^= hashes >> np.uint64(32)
        if len(short):
            order = np.argsort(doc, kind="stable")
            hashes, doc = hashes[order], doc[order]
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        for begin, end in zip(cuts, cuts[1:], strict=False):
            hashes[begin:end].sort()
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.hashes, self.doc = hashes[fresh], doc[fresh]
        self.sizes = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.begins[k] : self.begins[k] + self.sizes[k]]

    def keys(self) -> np.ndarray:
        """A hash of each whole set; 0 for empty ones."""
        digests = [xxhash.xxh3_64_intdigest(self.of(k).tobytes()) if n else 0 for k, n in enumerate(self.sizes.tolist())]
        return np.array(digests, np.uint64).astype(np.int64)


CLASSES = "doc_id long, handle long, n_shingles long, key long, frequent binary"


class Repeated:
    """Counts shingles in runs, in a buffer of one run; those that stand in a run several times are reported."""

    def __init__(self):
        self.buffer, self.held = np.zeros(COUNTED, np.uint64), 0

    def add(self, shingles: np.ndarray) -> bytes | None:
        """A report of the run before, if these shingles begin another."""
        report = self.report() if self.held + len(shingles) > len(self.buffer) else None
        if len(shingles) > len(self.buffer):  # a very long text
            self.buffer = np.zeros(len(shingles), np.uint64)
        self.buffer[self.held : self.held + len(shingles)] = shingles
        self.held += len(shingles)
        return report

    def report(self) -> bytes | None:
        """Shingles, then their counts."""
        run, self.held = self.buffer[: self.held], 0
        run.sort()
        shingles, counts = np.unique(run[1:][run[1:] == run[:-1]], return_counts=True)
        return shingles.tobytes() + (counts + 1).astype("<u8").tobytes() if len(shingles) else None


def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its set's size and key; the first row of the last batch of a run reports its repeated shingles."""
    names = [x.split()[0] for x in CLASSES.split(", ")]
    repeated, waiting = Repeated(), None

    def rows(columns: list, report: bytes | None) -> pa.RecordBatch:
        reports = pa.array([report, *[None] * (len(columns[0]) - 1)], pa.binary())
        return pa.RecordBatch.from_arrays([*columns, reports], names)

    for batch, texts in batches_of_texts(batches, 2):
        sets = Sets(texts)
        report = repeated.add(sets.hashes)
        if waiting is not None:
            yield rows(waiting, report)
        waiting = [batch.column(0), batch.column(1), pa.array(sets.sizes, pa.int64()), pa.array(sets.keys(), pa.int64())]
    if waiting is not None:
        yield rows(waiting, repeated.report())


def report_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for report in batch.column(0).to_pylist():
            shingles, counts = np.frombuffer(report, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(shingles, pa.int64()), pa.array(counts, pa.int64())], ["shingle", "n"])


def frequent_table(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and their counts: ``FREQUENT`` rows at most."""
    counts = classes.where("frequent is not null").select("frequent").mapInArrow(report_rows, "shingle long, n long")
    rows = counts.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingles = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows["n"].to_numpy()[order]


def prefix_size(size: np.ndarray) -> np.ndarray:
    """So many of the first shingles hold one that any similar set has too."""
    return size - (3 * size + 3) // 4 + 1


def scattered(x) -> np.ndarray:
    """Bits of whole numbers spread over the word."""
    with np.errstate(over="ignore"):
        mixed = np.asarray(x).astype(np.uint64) * np.uint64(MULTIPLIER)
        return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def posting_map(table, parts: int, salted: int = SALTED):
    """Postings of the prefixes, one class of a batch once.

    Parts from ``parts`` on hold shares of the hot shingles' buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = table.value
        very = counts > salted
        hot, salts = shingles[very], (-(-counts[very] // salted)).astype(np.uint64)
        quick = np.zeros(1 << 20, bool)
        quick[(shingles >> np.uint64(44)).astype(np.int64)] = True
        for _, texts in batches_of_texts(batches, 2):
            sets = Sets(texts)
            if not len(sets.hashes):
                continue
            keys = sets.keys()
            _, first = np.unique(keys, return_index=True)
            chosen = np.zeros(len(texts), bool)
            chosen[first] = True
            chosen &= sets.sizes > 0
            sizes = np.where(chosen, sets.sizes, 0)
            counts_of = np.zeros(len(sets.hashes), np.int64)
            if len(shingles):
                maybe = np.flatnonzero(quick[(sets.hashes >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(shingles, sets.hashes[maybe]), len(shingles) - 1)
                counts_of[maybe] = np.where(shingles[at] == sets.hashes[maybe], counts[at], 0)
            wanted = prefix_size(sizes)
            hashes, place, doc = [], [], []
            frequent = np.bincount(sets.doc, counts_of > 0, len(texts)) > 0
            for k in np.flatnonzero(chosen).tolist():
                own = sets.of(k)
                if frequent[k]:  # else the hashes' order is the order already
                    begin = sets.begins[k]
                    own = own[np.argsort(counts_of[begin : begin + len(own)], kind="stable")]
                n = int(wanted[k])
                hashes.append(own[:n])
                place.append(np.arange(n))
                doc.append(np.full(n, k))
            hashes, place, doc = np.concatenate(hashes), np.concatenate(place), np.concatenate(doc)
            docs = np.zeros(len(texts), DOC)
            docs["key"], docs["size"] = keys, sets.sizes
            part = part_of(hashes, parts)
            for at in np.flatnonzero(np.isin(hashes, hot)).tolist():
                shares = salts[np.searchsorted(hot, hashes[at])]
                share = scattered(keys[doc[at]]) % shares
                part[at] = parts + part_of(scattered(hashes[at] + share), parts)
            yield pack_postings(hashes, np.zeros((len(hashes), 0), "u1"), place, doc, docs, parts, part)

    return run


def widest(size, place):
    """The largest set that may have its first shared shingle with a set of this size at this place.

    From there on, the overlap is ``size - place`` at most; it must be 3/7 of both sizes.
    """
    return (4 * size - 7 * place) // 3


MEETINGS = "kind byte, shingle long, a long, b long, size int, place int"
MEETING_KINDS = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
PAIR, MEMBER, LEADER = 0, 1, 2


def meetings(parts: int):
    """One part's postings to candidate pairs, members of large or salted buckets, and leaders of salted shares."""

    def run(rows: pa.Table) -> pa.Table:
        salted = rows["part"][0].as_py() >= parts
        hashes, _, places, docs = unpack_postings(rows, "u1", DOC)
        order = np.lexsort((docs["key"], docs["size"], hashes))
        h, key, size, place = hashes[order], docs["key"][order], docs["size"][order].astype(np.int64), places[order]
        most = widest(size, place)
        alive = np.ones(len(h), bool)
        alive[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        if not salted and len(h):  # who can pass with nobody in the bucket goes
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[start, len(h)])
            alive &= (most >= np.repeat(size[start], count)) & (size <= np.repeat(np.maximum.reduceat(most, start), count))
        h, key, size, place, most = h[alive], key[alive], size[alive], place[alive], most[alive]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(h)])
        left, right = [], []
        for n in range(2, SMALL + 1):
            own = start[count == n]
            for i in range(n):
                for j in range(i + 1, n):
                    left.append(own + i)
                    right.append(own + j)
        large = count > (0 if salted else SMALL)
        members, chiefs = np.flatnonzero(np.repeat(large, count)), np.zeros(0, np.int64)
        if len(members):
            bucket = np.repeat(np.flatnonzero(large), count[large])
            # the first leader is the one with the least of its own before this shingle: near copies
            # differ from what they were made of by rare shingles, and that text itself has none
            for ranking in (place / size, key, scattered(key)):
                by = members[np.lexsort((key[members], ranking[members], bucket))]
                first = by[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])]
                lead = np.repeat(first, count[large])
                left.append(lead[lead != members])
                right.append(members[lead != members])
                chiefs = first if salted and not len(chiefs) else chiefs
        x = np.concatenate(left) if left else np.zeros(0, np.int64)
        y = np.concatenate(right) if right else np.zeros(0, np.int64)
        good = (size[x] <= most[y]) & (size[y] <= most[x])
        x, y = x[good], y[good]
        pairs = np.unique(np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y])]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
        out = []
        for kind, at in ((MEMBER, members), (LEADER, chiefs)):
            none = np.zeros(len(at), np.int64)
            out.append((none + kind, h[at].view(np.int64), key[at], none, size[at], place[at]))
        none = np.zeros(pairs.shape[1], np.int64)
        out.append((none + PAIR, none, pairs[0], pairs[1], none, none))
        names = [x.split()[0] for x in MEETINGS.split(", ")]
        return pa.table([pa.array(np.concatenate(c), pa.int64()).cast(k) for c, k in zip(zip(*out, strict=True), MEETING_KINDS, strict=True)], names)

    return run


def leader_pairs(found: DataFrame) -> DataFrame:
    """The leaders of a salted bucket's shares meet the first of them."""
    leaders = found.where(F.col("kind") == LEADER).select("shingle", "a", "size", "place")
    rank = F.struct(F.col("place") / F.col("size"), F.col("a"))
    first = leaders.groupBy("shingle").agg(F.min_by(F.struct("a", "size", "place"), rank).alias("f"))
    met = leaders.join(first, "shingle").where("a != f.a").where(passes(F.col("size"), F.col("place"), F.col("f.size"), F.col("f.place")))
    return met.select(F.least("a", "f.a").alias("a"), F.greatest("a", "f.a").alias("b"))


def passes(size: Column, place: Column, other_size: Column, other_place: Column) -> Column:
    """Length and positional filter: the shingle at these places may be the first that the two sets share."""
    needed = 3 * (size + other_size)
    return (7 * (size - place) >= needed) & (7 * (other_size - other_place) >= needed)


def packed_set(hashes: np.ndarray) -> bytes:
    """Six bytes of each hash, ascending."""
    values = np.sort(hashes >> np.uint64(16))
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (values >> np.uint64(32)).astype("<u2").tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def rows_of_sets(make):
    """``key`` and what ``make`` packs of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches_of_texts(batches, 2):
            sets = Sets(texts)
            packed = [make(sets.of(k)) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(sets.keys(), pa.int64()), pa.array(packed, pa.binary())], ["key", "packed"])

    return run


#: Pivots of the suffix filter.
PIVOTS = np.arange(1, 16, dtype=np.uint64) << np.uint64(44)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    needed = -(-3 * (len(a) + len(b)) // 7)
    # suffix filter: between two pivots, no more is shared than the lesser of the two counts
    parts_a, parts_b = (np.diff(np.searchsorted(s, PIVOTS), prepend=0, append=len(s)) for s in (a, b))
    if np.minimum(parts_a, parts_b).sum() < needed:
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum()) >= needed


def verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [linked(unpacked_set(x.as_py()), unpacked_set(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def for_both(pairs: DataFrame, of_key: DataFrame) -> DataFrame:
    """``a, b, of_a, of_b``: the second column of ``of_key`` (key first) for both sides of each pair."""
    key, value = of_key.columns
    with_b = pairs.join(of_key.select(F.col(key).alias("b"), F.col(value).alias("of_b")), "b")
    return with_b.join(of_key.select(F.col(key).alias("a"), F.col(value).alias("of_a")), "a").select("a", "b", "of_a", "of_b")


def packed_classes(keys: DataFrame, keyed: DataFrame, classes: DataFrame, make, label: str) -> DataFrame:
    """``key, packed`` for each class among ``keys``, from one of its documents; stored.

    Texts are not shuffled: a bitmap picks the documents, and so a few more, whose rows no pair asks for.
    """
    chosen = stored(classes.join(keys, "key", "left_semi").groupBy("key").agg(F.min("handle").alias("handle")), "chosen")
    texts = likely_members(keyed, chosen, "handle", chosen.count()).select("doc_id", "handle", "text")
    return stored(texts.mapInArrow(rows_of_sets(make), "key long, packed binary"), label)


def both_keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def verified(pairs: DataFrame, keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that are linked, by the whole sets; stored."""
    sets = packed_classes(both_keys(pairs), keyed, classes, packed_set, "sets")
    return stored(for_both(pairs, sets).mapInArrow(verify_rows, "a long, b long").distinct(), "linked")


def signature(per_shingle: int):
    """A bit for each shingle, by its low bits; a power of two of bits, after the size in eight bytes."""

    def make(members: np.ndarray) -> bytes:
        bits = min(SIGNATURE_BITS, 1 << (per_shingle * max(1, len(members)) - 1).bit_length())
        marks = np.zeros(bits, bool)
        marks[members & np.uint64(bits - 1)] = True
        return len(members).to_bytes(8, "little") + np.packbits(marks, bitorder="little").tobytes()

    return make


def halved(table: np.ndarray, width: int) -> np.ndarray:
    """Signatures (the last axis) folded to ``width`` bytes."""
    while table.shape[-1] > width:
        half = table.shape[-1] // 2
        table = table[..., :half] | table[..., half:]
    return table


def possible_overlap(a: bytes, b: bytes) -> bool:
    """Whether two signatures leave the needed overlap possible: a bit that only one has stands for a shingle, at least, that only it has."""
    n, m = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    x, y = np.frombuffer(a, np.uint8, offset=8), np.frombuffer(b, np.uint8, offset=8)
    x, y = halved(x, len(y)), halved(y, len(x))
    alone_x, alone_y = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    return 7 * min(n - alone_x, m - alone_y) >= 3 * (n + m)


def possible_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [possible_overlap(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def linked_pairs(pairs: DataFrame, keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the stored ``pairs`` that are linked; signatures are shipped first, and whole sets only for what they leave."""
    signatures = packed_classes(both_keys(pairs), keyed, classes, signature(COARSE), "signatures")
    left = stored(for_both(pairs, signatures).mapInArrow(possible_rows, "a long, b long").distinct(), "possible")
    return verified(left, keyed, classes)


class Signatures:
    """Signatures of several sets, those of one width together."""

    def __init__(self, packed: list[bytes]):
        widths = np.array([len(p) - 8 for p in packed])
        self.groups = []
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            self.groups.append((rows, np.frombuffer(b"".join(packed[r][8:] for r in rows.tolist()), np.uint8).reshape(len(rows), width)))

    def alone(self, one: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The wanted rows, and at least how many shingles the one set has that each lacks, and the other way."""
        own = np.frombuffer(one, np.uint8, offset=8)
        at, here, there = [], [], []
        for rows, table in self.groups:
            chosen = np.flatnonzero(wanted[rows])
            if not len(chosen):
                continue
            other = halved(table[chosen], len(own))
            mine = halved(own, other.shape[1])
            at.append(rows[chosen])
            here.append(np.bitwise_count(mine & ~other).sum(axis=1, dtype=np.int64))
            there.append(np.bitwise_count(other & ~mine).sum(axis=1, dtype=np.int64))
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) if c else empty for c in (at, here, there))


def outside_pairs(members: pa.Table, outsiders: pa.Table) -> pa.Table:
    """Pairs of an outsider and a member of another component that places and signatures leave possible."""
    y, x = members.to_pandas(), outsiders.to_pandas()
    found = [np.zeros((0, 2), np.int64)]
    if len(y) and len(x):
        key, root, size = y["a"].to_numpy(), y["root"].to_numpy(), y["size"].to_numpy().astype(np.int64)
        most, main = widest(size, y["place"].to_numpy().astype(np.int64)), y["main"].iloc[0]
        table = Signatures([bytes(s) for s in y["signature"]])
        for row in x.itertuples(index=False):
            wanted = (root != row.x_root) & (size <= widest(row.x_size, row.x_place)) & (row.x_size <= most)
            wanted &= (root == main) | (key > row.x_a)
            at, here, there = table.alone(bytes(row.x_signature), wanted)
            good = at[7 * np.minimum(row.x_size - here, size[at] - there) >= 3 * (row.x_size + size[at])]
            found.append(np.sort(np.stack([np.full(len(good), row.x_a), key[good]], 1), axis=1))
    pairs = np.concatenate(found)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def across_components(members: DataFrame, roots: DataFrame, done: DataFrame, keyed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Linked pairs in large buckets whose classes are in different components; stored.

    In a bucket, the classes outside its most frequent component meet the others.
    """
    placed = members.join(roots, members["a"] == roots["node"], "left").select("shingle", "a", "size", "place", F.coalesce("root", "a").alias("root"))
    most = F.floor((4 * F.col("size") - 7 * F.col("place")) / 3)
    placed = stored(placed.withColumn("most", most), "placed")
    # who can pass with nobody in the whole bucket goes
    reach = placed.groupBy("shingle").agg(F.min("size").alias("least_size"), F.max("most").alias("most_most"))
    placed = placed.join(reach, "shingle").where("most >= least_size and size <= most_most")
    sizes = placed.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    dealt = mixed.select(
        "shingle", F.col("m.root").alias("main"),
        F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("blocks"),
    )
    placed = stored(placed.select("shingle", "a", "size", "place", "root").join(dealt, "shingle"), "mixed")
    wanted = placed.select(F.col("a").alias("key")).distinct()
    if wanted.isEmpty():
        return None
    signatures = packed_classes(wanted, keyed, classes, signature(FINE), "signatures").dropDuplicates(["key"]).withColumnRenamed("packed", "signature")
    placed = placed.join(signatures, placed["a"] == signatures["key"]).drop("key")
    inside = placed.select(
        "shingle", F.pmod("a", "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        "a", "size", "place", "root", "main", "signature",
    )
    outside = placed.where("root != main").select(
        F.col("shingle").alias("x_shingle"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("x_chunk"),
        F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("x_block"), *[F.col(c).alias(f"x_{c}") for c in ("a", "size", "place", "root", "signature")],
    )
    met = inside.groupBy("shingle", "chunk", "block").cogroup(outside.groupBy("x_shingle", "x_chunk", "x_block"))
    pairs = met.applyInArrow(outside_pairs, "a long, b long").distinct()
    left = stored(pairs.join(done, ["a", "b"], "left_anti"), "left")
    return None if left.isEmpty() else verified(left, keyed, classes)


def grouped_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", salted: int = SALTED) -> DataFrame:
    """``doc_id, handle, n_shingles, root, component_id`` for each row; the root is its component's own key, null without shingles."""
    spark = documents.sparkSession
    ship_code(spark)
    keyed = keyed_documents(documents, id_col, text_col)
    classes = stored(keyed.mapInArrow(class_rows, CLASSES), "classes")
    table = spark.sparkContext.broadcast(frequent_table(classes))
    parts = part_count(documents, text_col, BYTES_PER_PART)
    found = stored(keyed.mapInArrow(posting_map(table, parts, salted), POSTINGS).groupBy("part").applyInArrow(meetings(parts), MEETINGS), "meetings")
    pairs = stored(found.where(F.col("kind") == PAIR).select("a", "b").unionByName(leader_pairs(found)).distinct(), "pairs")
    known = classes.where("n_shingles > 0").select("key", "handle")
    links = linked_pairs(pairs, keyed, known)
    roots = connected_components(links)
    members = found.where(F.col("kind") == MEMBER).select("shingle", "a", "size", "place")
    late = across_components(members, roots, pairs, keyed, known)
    if late is not None:
        roots = connected_components(late.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    table.unpersist()

    # each class's least id, then each component's; only then back to the rows
    least = classes.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, least["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(component, "root").select("key", "root", "component_id")
    return (
        classes.select("doc_id", "handle", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key"))
        .join(named, "key", "left")
        .select("doc_id", "handle", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def similar_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row."""
    return grouped_documents(documents, id_col, text_col).select("doc_id", "n_shingles", "component_id")
