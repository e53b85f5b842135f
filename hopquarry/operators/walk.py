"""Personalized PageRank as sparse products in blocks of documents.

The vectors of several questions are the columns of one matrix, so a pair of the graph is
touched once a round for all of them.  Pairs lie in blocks of documents, each with
the entities that it has; only entities' rows travel.  In a pass, a block gets its
entities' rows, makes its documents' rows of the next round from them, and sends
back what these give to each entity; parts of an entity meet by a hash of it and
their sum goes to all blocks that have the entity.  Documents' rows never leave
their block, only the best ``k`` of each question do.  As the graph has edges between entities and
documents only, a pass makes two rounds.

With rows normalised, an edge is ``tf`` times factors of its ends: ``tf * a`` from the entity, ``tf * b * c`` from the document,
so a block stores its pairs' ``tf`` and one factor for each entity and document.

Texts are counted into chunks, each with numbers of its own for its entities: what is to be known of an
entity in a chunk is one row, and a block is put together from chunks without their names.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship_code
from ..storage import remove, setting, stored

#: Documents and pairs of a block, about.
BLOCK_DOCS, BLOCK_PAIRS = 16_384, 6_000_000
#: Documents and pairs of a chunk.
CHUNK_DOCS, CHUNK_PAIRS = 8192, 2_500_000
#: Numbers that the entities' rows of a pass have together: so many for each document of the graph, or so many in all.
MESSAGE_NUMBERS, FEW_NUMBERS = 220, 1 << 24
#: Columns of a matrix at most.
COLUMNS = 256
#: Runs of up to so many pairs are multiplied many at once, with so many numbers.
SHORT, SHORT_NUMBERS = 16, 1 << 19
#: Bytes of entities' rows that are added up at once.
BUCKET_BYTES = 24 << 20
#: Rows and bytes of an Arrow batch that a task hands on.
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20

#: ``nulls`` documents without a number come first.
CHUNK = "chunk long, pairs long, nulls int, docs binary, sizes binary, ents binary, tf binary, names array<string>"
BLOCK = "block int, docs binary, c binary, ents binary, a binary, b binary, doc_sizes binary, doc_ents binary, doc_tf binary, ent_sizes binary, ent_docs binary, ent_tf binary"
#: What documents need of a block to be reached from its entities.
TO_DOCS = ("block", "docs", "ents", "a", "doc_sizes", "doc_ents", "doc_tf")
#: ``kind`` 0: rows of entities, many in one: ``nodes``, ``blocks`` and ``locals`` (their places there, -1 for seed documents) and the matrix ``vec`` of the first ones, to a block or a bucket;
#: 1: a document's score in a round for the question ``local``; 2: how far the question ``local`` moved in a round.
ROWS = "kind int, to int, node long, local int, round int, value double, nodes binary, blocks binary, locals binary, vec binary"
NAMES = [f.split()[0] for f in ROWS.split(", ")]
#: What is sent to a block.
MESSAGES = ["to", "nodes", "locals", "vec"]


@dataclass
class Blocks:
    """``blocks`` (``BLOCK``) and ``places`` (ent, block, local), both stored."""

    blocks: DataFrame
    places: DataFrame
    n_blocks: int
    docs: int
    rows: int

    def columns(self, sets: int) -> int:
        """Questions that walk at once."""
        return max(1, min(COLUMNS, max(MESSAGE_NUMBERS * self.docs, FEW_NUMBERS) // max(1, self.rows)) // sets)


def _numbers(table: pa.Table, name: str, kind: str, row: int = 0) -> np.ndarray:
    return np.frombuffer(table.column(name)[row].as_buffer(), kind)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype("u1" if most < 1 << 8 else "u2" if most < 1 << 16 else "i4").tobytes()


def _widened(table: pa.Table, name: str, n: int, row: int = 0) -> np.ndarray:
    data = table.column(name)[row].as_buffer()
    return np.frombuffer(data, {1: "u1", 2: "u2", 4: "i4"}[data.size // n] if n else "u1")


def _in_batches(table: pa.Table) -> pa.Table:
    most = max(1, min(BATCH_ROWS, table.num_rows * BATCH_BYTES // max(1, table.nbytes)))
    return pa.Table.from_batches(table.to_batches(most), table.schema) if table.num_rows > most else table


class Chunks:
    """Counted documents of a task, handed on in chunks."""

    def __init__(self, most: int):
        self.most, self.number = min(most, CHUNK_DOCS), TaskContext.get().partitionId() << 32
        self._empty()

    def _empty(self) -> None:
        self.names = defaultdict(count().__next__)
        self.docs, self.sizes, self.ents, self.tf = [], [], array("i"), array("i")

    def add(self, doc: int | None, names: Iterable, tf: Iterable[int]) -> None:
        self.docs.append(doc)
        before = len(self.ents)
        self.ents.extend(map(self.names.__getitem__, names))
        self.tf.extend(tf)
        self.sizes.append(len(self.ents) - before)

    def full(self) -> bool:
        return len(self.docs) >= self.most or len(self.ents) >= CHUNK_PAIRS

    def take(self) -> Iterator[pa.RecordBatch]:
        """By the documents' numbers, those without one first."""
        if not self.docs:
            return
        none = np.array([d is None for d in self.docs])
        docs = np.array([0 if d is None else d for d in self.docs], "i8")
        sizes, ents, tf = np.array(self.sizes, "i8"), np.array(self.ents), np.array(self.tf)
        order = np.lexsort((docs, ~none))
        pairs = _runs(np.cumsum(sizes)[order] - sizes[order], sizes[order])
        binary = [docs[order].tobytes(), sizes[order].astype("i4").tobytes(), ents[pairs].tobytes(), _narrow(tf[pairs])]
        names = pa.array(list(self.names), pa.binary() if isinstance(next(iter(self.names), b""), bytes) else pa.string()).cast(pa.string())
        columns = [pa.array([self.number]), pa.array([len(ents)]), pa.array([int(none.sum())], pa.int32()), *(pa.array([v], pa.binary()) for v in binary), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CHUNK.split(", ")])
        self.number += 1
        self._empty()


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all items of runs that start there."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def chunks_of_items(items: DataFrame) -> DataFrame:
    """``CHUNK`` from ``items`` (doc_idx, items: array of entity and tf)."""
    most = BLOCK_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(most)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            names, tf, ends = flat.field(0).to_pylist(), flat.field(1).to_pylist(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
            start = 0
            for doc, end in zip(batch.column(0).to_pylist(), ends):
                chunks.add(doc, names[start:end], tf[start:end])
                start = end
                if chunks.full():
                    yield from chunks.take()
        yield from chunks.take()

    ship_code(items.sparkSession)
    return items.select(F.col("doc_idx").cast("long").alias("doc_idx"), "items").mapInArrow(run, CHUNK)


def _chunk(table: pa.Table, row: int) -> tuple[np.ndarray, ...]:
    """Documents, the sizes of their runs, and each pair's entity and tf."""
    ents = _numbers(table, "ents", "i4", row)
    return _numbers(table, "docs", "i8", row), _numbers(table, "sizes", "i4", row), ents, _widened(table, "tf", len(ents), row)


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """``doc_idx, entity, tf, pos``: a row for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row in range(len(batch)):
                docs, sizes, ents, tf = _chunk(table, row)
                doc = np.repeat(np.arange(len(docs)), sizes)
                pos = np.arange(len(ents)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                names = table.column("names")[row].values
                out = [pa.array(docs[doc], mask=doc < table.column("nulls")[row].as_py()), names.take(pa.array(ents)), pa.array(tf.astype("i8")), pa.array(pos.astype("i4"))]
                yield from pa.table(out, ["doc_idx", "entity", "tf", "pos"]).to_batches(BATCH_ROWS)

    return chunks.mapInArrow(run, "doc_idx long, entity string, tf long, pos int")


def chunk_entities(chunks: DataFrame) -> DataFrame:
    """``chunk, local, entity, df, total, first_doc, first_pos``: a row for each entity of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row in range(len(batch)):
                docs, sizes, ents, tf = _chunk(table, row)
                names = table.column("names")[row].values
                n, first = len(names), np.empty(len(names), "i8")
                first[ents[::-1]] = np.arange(len(ents))[::-1]
                doc = np.repeat(np.arange(len(docs)), sizes)[first]
                out = {
                    "chunk": pa.array(np.full(n, table.column("chunk")[row].as_py(), "i8")), "local": pa.array(np.arange(n, dtype="i4")), "entity": names, "df": pa.array(np.bincount(ents, minlength=n)),
                    "total": pa.array(np.bincount(ents, tf, n)), "first_doc": pa.array(docs[doc], mask=doc < table.column("nulls")[row].as_py()), "first_pos": pa.array((first - (np.cumsum(sizes) - sizes)[doc]).astype("i4")),
                }
                yield from pa.table(out).to_batches(BATCH_ROWS)

    return chunks.mapInArrow(run, "chunk long, local int, entity string, df long, total double, first_doc long, first_pos int")


def _build_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs of chunks whose entities have factors, by documents and by entities."""
    names = [f.split()[0] for f in BLOCK.split(", ")]
    nothing = pa.table({n: pa.array([], pa.int32() if n == "block" else pa.binary()) for n in names})
    if not left.num_rows or not right.num_rows:
        return nothing
    chunk, local, ent = (right.column(n).to_numpy() for n in ("chunk", "local", "ent"))
    known, first, place = np.unique(ent, return_index=True, return_inverse=True)
    # filled in place, as there are many pairs
    pairs = sum(left.column("ents")[row].as_buffer().size // 4 for row in range(left.num_rows))
    doc, ent, tf, docs, before, filled = np.empty(pairs, "i4"), np.empty(pairs, "i4"), np.empty(pairs, "i4"), [], 0, 0
    for row in range(left.num_rows):
        own, sizes, ents, tf_own = _chunk(left, row)
        mine = chunk == left.column("chunk")[row].as_py()
        at = np.full(max(int(ents.max(initial=0)), int(local[mine].max(initial=0))) + 1, -1, "i4")
        at[local[mine]] = place[mine]
        of, ents = np.repeat(np.arange(len(own), dtype="i4"), sizes), at[ents]
        # documents without a number take their share of an entity and hand nothing on
        kept = (ents >= 0) & (of >= left.column("nulls")[row].as_py())
        to = slice(filled, filled + int(kept.sum()))
        doc[to], ent[to], tf[to] = of[kept] + np.int32(before), ents[kept], tf_own[kept]
        docs.append(own)
        before, filled = before + len(own), to.stop
    doc, ent, tf = doc[:filled], ent[:filled], tf[:filled]
    if not len(doc):
        return nothing
    # rows with the same number are one document
    docs, same = np.unique(np.concatenate(docs), return_inverse=True)
    has = np.zeros(len(docs), bool)
    doc = same.astype("i4")[doc]
    has[doc] = True
    docs, doc = docs[has], (np.cumsum(has, dtype="i4") - 1)[doc]
    if (doc[1:] < doc[:-1]).any():
        by = np.argsort(doc, kind="stable")
        doc, ent, tf = doc[by], ent[by], tf[by]
    has = np.bincount(ent, minlength=len(known)) > 0
    ent, known, first = (np.cumsum(has, dtype="i4") - 1)[ent], known[has], first[has]
    a, b = (right.column(n).to_numpy()[first] for n in ("a", "b"))
    c = np.zeros(len(docs))
    for at in range(0, len(doc), 1 << 20):
        part = slice(at, at + (1 << 20))
        c += np.bincount(doc[part], tf[part] * b[ent[part]], len(docs))
    values = [docs.tobytes(), (1 / c).tobytes(), known.astype("i8").tobytes(), a.tobytes(), b.tobytes(), np.bincount(doc, minlength=len(docs)).astype("i4").tobytes(), ent.tobytes(), _narrow(tf)]
    by = np.argsort(ent, kind="stable")
    values += [np.bincount(ent, minlength=len(known)).astype("i4").tobytes(), _narrow(doc[by]), _narrow(tf[by])]
    return pa.table({n: pa.array([v], pa.int32() if n == "block" else pa.binary()) for n, v in zip(names, [key[0].as_py(), *values], strict=True)})


def build_blocks(chunks: DataFrame, entities: DataFrame, docs: DataFrame, hub_penalty: float = 0.0, found: DataFrame | None = None) -> Blocks:
    """Blocks from ``CHUNK`` rows and the entities (entity, df, ent_idx) that count; ``found`` is ``chunk_entities``, if stored before."""
    ship_code(chunks.sparkSession)
    n = docs.count()
    found = stored(chunk_entities(chunks), "chunk-entities") if found is None else found
    # chunks in their order, cut into blocks of about as many pairs
    sizes = chunks.select("chunk", F.col("pairs") + 1.0).toDF("chunk", "size")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n_blocks = max(1, -(-n // BLOCK_DOCS), -(-int(total) // BLOCK_PAIRS))
    middle = F.sum("size").over(Window.orderBy("chunk")) - F.col("size") / 2
    block_of = stored(sizes.select("chunk", F.floor(middle * (n_blocks / max(1, total))).cast("int").alias("number")), "chunk-blocks")
    totals = found.groupBy("entity").agg(F.sum("total").alias("total"))
    idf = F.log((F.lit(float(max(1, n))) + 1) / (F.col("df") + 1)) + 1
    back = F.pow(F.col("df") + F.lit(1e-9), F.lit(-hub_penalty)) if hub_penalty > 0 else F.lit(1.0)
    # from an entity the weights are tf * idf, so idf leaves their shares
    factors = entities.join(totals, "entity").select("entity", F.col("ent_idx").cast("long").alias("ent"), (1 / F.col("total")).alias("a"), (idf * back).alias("b"))
    known = found.select("chunk", "local", "entity").join(factors, "entity").join(F.broadcast(block_of), "chunk").select(F.col("number").alias("block"), "chunk", "local", "ent", "a", "b")
    dealt = chunks.select("chunk", "nulls", "docs", "sizes", "ents", "tf").join(F.broadcast(block_of), "chunk").withColumnRenamed("number", "block")
    with setting(chunks.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        blocks = stored(dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_build_block, BLOCK), "blocks")
        places = stored(_places(blocks), "places")
    _forget(found)
    _forget(chunks)
    return Blocks(blocks, places, n_blocks, n, places.count())


def _places(blocks: DataFrame) -> DataFrame:
    """``ent, block, local``: where blocks have entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ents = np.frombuffer(ents, "i8")
                n = len(ents)
                yield from pa.table({"ent": pa.array(ents), "block": pa.array(np.full(n, block, "i4")), "local": pa.array(np.arange(n, dtype="i4"))}).to_batches(BATCH_ROWS)

    return blocks.select("block", "ents").mapInArrow(run, "ent long, block int, local int")


def _product(x: np.ndarray, take: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row for each run of the given sizes: the sum of ``tf`` times the rows of ``x`` that ``take`` names."""
    out, ends = np.zeros((len(sizes), x.shape[1])), np.cumsum(sizes, dtype="i8")
    for n in range(1, SHORT + 1):
        same, step = np.flatnonzero(sizes == n), max(1, SHORT_NUMBERS // (n * x.shape[1]))
        for at in range(0, len(same), step):
            runs = same[at : at + step]
            pairs = (ends[runs] - n)[:, None] + np.arange(n)
            out[runs] = np.matmul(tf[pairs].astype("f8")[:, None, :], x.take(take[pairs], axis=0))[:, 0]
    for run in np.flatnonzero(sizes > SHORT):
        pairs = slice(ends[run] - sizes[run], ends[run])
        np.dot(tf[pairs].astype("f8"), x.take(take[pairs], axis=0), out=out[run])
    return out


def _rows(kind: int, n: int, **columns) -> pa.Table:
    fill = {"kind": np.full(n, kind, "i4"), "to": np.zeros(n, "i4"), "node": np.zeros(n, "i8"), "local": np.full(n, -1, "i4"), "round": np.zeros(n, "i4"), "value": np.zeros(n)}
    out = {name: pa.array(np.asarray(columns.get(name, v), v.dtype)) for name, v in fill.items()}
    return pa.table(out | {name: columns[name] if isinstance(columns.get(name), pa.Array) else pa.array(columns[name], pa.binary()) if name in columns else pa.nulls(n, pa.binary()) for name in ("nodes", "blocks", "locals", "vec")})


def _packed(to: np.ndarray, node: np.ndarray, block: np.ndarray, local: np.ndarray, matrix: np.ndarray, row: np.ndarray) -> pa.Table:
    """Rows of kind 0, one for each value of ``to``; ``row`` names an entity's row of ``matrix``, or is -1 and it comes after the others."""
    order = np.lexsort((row < 0, to))
    cuts = np.r_[0, np.flatnonzero(np.diff(to[order])) + 1, len(order)] if len(order) else np.zeros(1, "i8")
    sizes = np.diff(cuts)
    with_row = order[row[order] >= 0]
    ends = np.cumsum(np.add.reduceat(row[order] >= 0, cuts[:-1], dtype="i8") if len(sizes) else sizes)
    values = {"nodes": node[order].astype("i8"), "blocks": block[order].astype("i4"), "locals": local[order].astype("i4")}
    binary = {name: _binary(v, cuts * v.itemsize) for name, v in values.items()}
    binary["vec"] = _binary(matrix.take(row[with_row], axis=0), np.r_[0, ends] * matrix.shape[1] * 8)
    return _rows(0, len(sizes), to=to[order][cuts[:-1]], **binary)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """``data`` cut at these bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("i4")), pa.py_buffer(data)])


def _bucket(node: np.ndarray, buckets: int) -> np.ndarray:
    return ((node.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype("i4")


def _unpacked(table: pa.Table, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Nodes, blocks (if there), places and the matrix of each row."""
    names = [n for n in ("nodes", "blocks", "locals") if n in table.column_names]
    for row in range(table.num_rows):
        columns = [np.frombuffer(table.column(n)[row].as_buffer(), "i8" if n == "nodes" else "i4") for n in names]
        yield *columns, np.frombuffer(table.column("vec")[row].as_buffer(), "f8").reshape(-1, width)


def _moved(sums: np.ndarray, rounds: list[int]) -> pa.Table:
    """``sums``: for each of ``rounds`` each question's."""
    q = sums.shape[1]
    return _rows(2, sums.size, local=np.tile(np.arange(q), len(rounds)), round=np.repeat(rounds, q), value=sums.ravel())


def _best(y: np.ndarray, docs: np.ndarray, k: int, at: int) -> pa.Table:
    local, node, value = [], [], []
    for question in range(y.shape[1]):
        scores = np.ascontiguousarray(y[:, question])
        hit = np.flatnonzero(scores > 0)
        ranked = np.round(scores[hit], 9)
        if len(hit) > k > 0:
            near = ranked >= np.partition(ranked, len(hit) - k)[len(hit) - k]
            hit, ranked = hit[near], ranked[near]
        best = hit[np.lexsort((docs[hit], -ranked))[:k]]
        local.append(np.full(len(best), question))
        node.append(docs[best])
        value.append(scores[best])
    local, node, value = map(np.concatenate, (local, node, value))
    return _rows(1, len(local), local=local, node=node, value=value, round=np.full(len(local), at))


def _coefficients(rounds: list[int], alpha: float) -> list[float]:
    """What of the seeds a vector has in these rounds: all in round 0, nothing before."""
    return [0.0 if t < 0 else 1.0 if t == 0 else alpha for t in rounds]


def _pass(key: tuple, left: pa.Table, right: pa.Table, t: int, q: int, sets: int, alpha: float, last: int, k: int, buckets: int) -> pa.Table:
    """Documents of the rounds ``t``, ``t - 1``, ... (as many as ``sets``) from entities one round before, and parts of the entities one round after."""
    if not left.num_rows:
        return _rows(0, 0)
    docs, ents, a = _numbers(left, "docs", "i8"), _numbers(left, "ents", "i8"), _numbers(left, "a", "f8")
    x, seeds = np.zeros((len(ents), q * sets)), []
    for node, local, vec in _unpacked(right, q * sets):
        own = local >= 0
        x[local[own]] = vec if own.all() else vec[own]
        if not own.all():
            seeds.append((node[~own], vec[~own]))
    x *= ((1 - alpha) * a)[:, None]
    take = _numbers(left, "doc_ents", "i4")
    y = _product(x, take, _widened(left, "doc_tf", len(take)), _numbers(left, "doc_sizes", "i4"))
    del x
    for of, vec in seeds:
        place = np.minimum(np.searchsorted(docs, of), len(docs) - 1)
        there = docs[place] == of
        y[place[there]] += vec[there]
    rounds = [t - i for i in range(sets)]
    parts = [y[:, i * q : (i + 1) * q] for i in range(sets)]
    out = [_best(parts[i], docs, k, rounds[i]) for i in range(min(sets, 2)) if rounds[i] == last or sets > 1 and 0 < rounds[i] <= last]
    if sets > 1:
        out.append(_moved(np.stack([np.abs(parts[i] - parts[i + 1]).sum(axis=0) for i in (0, 1)]), rounds[:2]))
    if t < last:
        y *= _numbers(left, "c", "f8")[:, None]
        sizes = _numbers(left, "ent_sizes", "i4")
        x = _product(y, _widened(left, "ent_docs", len(take)), _widened(left, "ent_tf", len(take)), sizes)
        x *= ((1 - alpha) * _numbers(left, "b", "f8"))[:, None]
        # a block names all its entities, as others may give them something: those that get nothing here without a vector
        n = len(ents)
        out.append(_packed(_bucket(ents, buckets), ents, np.full(n, key[0].as_py()), np.arange(n), x, np.where(x.any(axis=1), np.arange(n), -1)))
        del x
    return pa.concat_tables([_in_batches(table) for table in out])


def _meet(key: tuple, table: pa.Table, t: int, q: int, sets: int) -> pa.Table:
    """Parts of entities (round ``t`` and those before) added up, with the places of blocks that have them; other rows pass."""
    kind = table.column("kind").to_numpy()
    others, table = table.filter(pa.array(kind != 0)).select(NAMES), table.filter(pa.array(kind == 0))
    if not table.num_rows:
        return _in_batches(others)
    rows = list(_unpacked(table, q * sets))
    node, block, local = (np.concatenate([r[i] for r in rows]) for i in range(3))
    nodes, of = np.unique(node, return_inverse=True)
    sums = np.zeros((len(nodes), q * sets))
    # in the order of blocks, so that sums do not depend on what came first; an entity is in a row once
    starts = np.cumsum([0, *(len(r[0]) for r in rows)])
    for at in sorted(range(len(rows)), key=lambda i: rows[i][1][0]):
        sums[of[starts[at] : starts[at] + len(rows[at][3])]] += rows[at][3]
    out = [others]
    if sets > 1:
        parts = [sums[:, i * q : (i + 1) * q] for i in range(sets)]
        out.append(_moved(np.stack([np.abs(parts[i] - parts[i + 1]).sum(axis=0) for i in (0, 1)]), [t, t - 1]))
    order = np.lexsort((of, block))
    of, block, local = of[order], block[order], local[order]
    some = sums.any(axis=1)
    once = np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1])] & some[of]
    index = (np.cumsum(some) - 1)[of[once]]
    out.append(_rows(0, 1, to=[key[0].as_py()], nodes=[index.astype("i8").tobytes()], blocks=[block[once].tobytes()], locals=[local[once].tobytes()], vec=[sums[some].tobytes()]))
    return pa.concat_tables([_in_batches(table) for table in out])


def _sent(rows: DataFrame, width: int) -> DataFrame:
    """The sums of ``_meet`` for each block that has the entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, block, local, vec in _unpacked(pa.Table.from_batches([batch]), width):
                for to in np.unique(block):
                    own = block == to
                    yield from _rows(0, 1, to=[to], nodes=[b""], locals=[local[own].tobytes()], vec=[vec.take(index[own], axis=0).tobytes()]).select(MESSAGES).to_batches()

    return rows.where("kind = 0").select("nodes", "blocks", "locals", "vec").mapInArrow(run, "to int, nodes binary, locals binary, vec binary")


def _passing(t: int, q: int, sets: int, alpha: float, last: int, k: int, buckets: int) -> Callable:
    return lambda key, left, right: _pass(key, left, right, t, q, sets, alpha, last, k, buckets)


def _meeting(t: int, q: int, sets: int) -> Callable:
    return lambda key, table: _meet(key, table, t, q, sets)


def _seed_rows(seeds: DataFrame, q: int, coefficients: list[float], buckets: int | None = None) -> DataFrame:
    """``ROWS`` from seeds (node, block, local, first, entries: array of question and s), to their blocks or to buckets; only a node's ``first`` place has them."""
    width = q * len(coefficients)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            matrix = np.zeros((len(batch), width))
            entries = batch.column(4)
            row = np.repeat(np.arange(len(batch)), entries.value_lengths().to_numpy())
            flat = entries.flatten()
            column, s = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for i, share in enumerate(coefficients):
                matrix[row, column + i * q] = share * s
            node, block, local = (batch.column(i).to_numpy() for i in range(3))
            first = batch.column(3).to_numpy(zero_copy_only=False)
            # one row for each block, as an entity is in a row once
            keys, to = np.unique(block if buckets is None else np.stack([_bucket(node, buckets), block], axis=1), axis=0, return_inverse=True)
            out = _packed(to, node, block, local, matrix, np.where(first, np.arange(len(batch)), -1))
            keys = keys if buckets is None else keys[:, 0]
            out = out.set_column(1, "to", pa.array(keys.astype("i4")))
            yield from out.to_batches()

    return seeds.select("node", "block", "local", "first", "entries").mapInArrow(run, ROWS)


def best_documents(graph: Blocks, seeds: DataFrame, alpha: float, rounds: int, k: int, tol: float | None = None) -> DataFrame:
    """``qid, node, r``: among these are the best ``k`` documents of each question after so many rounds.

    With ``tol``, a question stops at its first round that moves its whole vector by less (sum of differences).
    """
    from .graph import numbered

    docs_of = seeds.where("node >= 0")
    held = None if docs_of.isEmpty() else stored(_held(graph), "held")
    if rounds == 0:
        return docs_of.select("qid", "node", F.col("s").alias("r"))
    sets = 1 if tol is None else 3
    q = graph.columns(sets)
    asked = stored(numbered(seeds.select("qid").distinct(), ["qid"], "number"), "questions")
    counted = stored(seeds.join(asked, "qid").select("node", "s", F.floor(F.col("number") / q).cast("int").alias("part"), (F.col("number") % q).cast("int").alias("column")), "seeds")
    # documents without an entity that counts keep their own share
    apart = docs_of if held is None else docs_of.join(held, "node", "left_anti")
    found = moved = None
    for part in range(-(-asked.count() // q)):
        rows = _walk(graph, counted.where(F.col("part") == part), alpha, rounds, k, q, sets, held)
        own = asked.where(F.floor(F.col("number") / q) == part).select("qid", (F.col("number") % q).cast("int").alias("local"))
        rows = rows.join(F.broadcast(own), "local").select("kind", "qid", "node", "round", F.col("value").alias("r"))
        best, moves = rows.where("kind = 1").drop("kind"), rows.where("kind = 2").select("qid", "round", "r")
        found, moved = (best, moves) if found is None else (found.unionByName(best), moved.unionByName(moves))
    alone = apart.select("qid", "node", (alpha * F.col("s")).alias("r"))
    if found is None:
        return alone
    if tol is None:
        return found.select("qid", "node", "r").unionByName(alone)
    moved = moved.unionByName(apart.select("qid", F.lit(1).alias("round"), ((1 - alpha) * F.col("s")).alias("r")))
    moved = moved.where((F.col("round") > 0) & (F.col("round") < rounds)).groupBy("qid", "round").agg(F.sum("r").alias("moved"))
    stop = moved.where(F.col("moved") < tol).groupBy("qid").agg(F.min("round").alias("stop"))
    ends = asked.select("qid").join(stop, "qid", "left").select("qid", F.coalesce("stop", F.lit(rounds)).alias("round"))
    return found.join(F.broadcast(ends), ["qid", "round"]).select("qid", "node", "r").unionByName(alone)


def _held(graph: Blocks) -> DataFrame:
    """``node, block``: the documents of blocks."""

    def run(batches):
        for batch in batches:
            for block, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs = np.frombuffer(docs, "i8")
                yield from pa.table({"node": pa.array(docs), "block": pa.array(np.full(len(docs), block, "i4"))}).to_batches(BATCH_ROWS)

    return graph.blocks.select("block", "docs").mapInArrow(run, "node long, block int")


def _walk(graph: Blocks, seeds: DataFrame, alpha: float, rounds: int, k: int, q: int, sets: int, held: DataFrame | None) -> DataFrame:
    """Scores and moves (``ROWS``) of the questions of ``seeds`` (node, s, column); ``held`` where seeds have documents."""
    entries = seeds.groupBy("node").agg(F.collect_list(F.struct("column", "s")).alias("entries"))
    own = entries.where("node < 0").select((-1 - F.col("node")).alias("node"), "entries")
    placed = graph.places.withColumnRenamed("ent", "node").join(F.broadcast(own), "node")
    places = placed.select("node", "block", "local", (F.col("block") == F.min("block").over(Window.partitionBy("node"))).alias("first"), "entries")
    places, doc_seeds = stored(places, "entity-seeds"), None
    if held is not None:
        doc_seeds = held.join(F.broadcast(entries.where("node >= 0")), "node")
        doc_seeds = stored(doc_seeds.select("node", "block", F.lit(-1).alias("local"), F.lit(True).alias("first"), "entries"), "document-seeds")
    # the first documents' round that leads to those of the last one by twos; with three sets any does
    t = 1 if sets > 1 or rounds % 2 else 0
    messages, out = _seed_rows(places.withColumn("first", F.lit(True)), q, _coefficients([t - 1 - i for i in range(sets)], alpha)).select(*MESSAGES), None
    buckets = max(graph.n_blocks, -(-graph.rows * q * sets * 8 // BUCKET_BYTES))
    kept = None
    while True:
        if doc_seeds is not None:
            messages = messages.unionByName(_seed_rows(doc_seeds, q, _coefficients([t - i for i in range(sets)], alpha)).select(*MESSAGES))
        blocks = graph.blocks if t < rounds else graph.blocks.select(*TO_DOCS)
        rows = blocks.groupBy("block").cogroup(messages.groupBy("to")).applyInArrow(_passing(t, q, sets, alpha, rounds, k, buckets), ROWS)
        if t < rounds:
            home = _seed_rows(places, q, _coefficients([t + 1 - i for i in range(sets)], alpha), buckets)
            rows = rows.unionByName(home).groupBy("to").applyInArrow(_meeting(t + 1, q, sets), ROWS)
        with setting(rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
            rows = stored(rows, "rows")
        few = rows.where("kind > 0").select("kind", "node", "local", "round", "value")
        if t >= rounds:
            few = stored(few, "scores")
        elif sets > 1:
            few = stored(few, "scores")
        out = few if out is None else out.unionByName(few) if sets > 1 else few
        if kept is not None:
            _forget(kept)
        if t >= rounds:
            _forget(rows)
            return out
        messages, kept, t = _sent(rows, q * sets), rows, t + 2


def _forget(rows: DataFrame) -> None:
    """Rows of a pass that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in rows.inputFiles()}:
        remove(rows.sparkSession, path)
