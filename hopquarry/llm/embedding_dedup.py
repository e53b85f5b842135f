"""Near-duplicate vectors by product quantisation with an exact rerank.

Rows of one label with bitwise equal vectors form a class; classes are what is
compared.  Coarse centroids cut the unit sphere into lists, and each class lies
in the list of its nearest centroid with its residual coded by a codebook per
subspace.  In a list, the distances of a query to all entries come from tables of its
distances to the codewords; entries that may lie within the search radius, given
their own coding error, are reranked by the cosine in double precision.

How far a query probes is learnt.  The margin of a list is the query's distance to the
plane between its own cell and the list's; a vector within the radius can only
lie in lists with a margin below it, and nearly always lies in lists with a much
smaller one.  ``ASKED`` classes are compared exactly with all classes of their
label, and every query then probes the lists up to the margin below which
``RECALL`` of their links lie (of all links, and of the mean query's).  With ``recall=1`` every list that the
radius reaches is probed and no link is lost.  Centroids that are closer than ``MERGED`` of the radius are
merged, so a large group of near copies is one list, not many that all probe
each other.

Each side of a pair finds and counts it, so a pair is lost only if neither list
is probed from the other side's; what one side alone finds is counted for that
side and links both.  No pair is emitted.  Per list and block come counts per class, and a spanning forest of the links,
which is all that the components need.  Lists are dealt in chunks of bounded
size to blocks of queries, so a list of any size is many tasks.

Centroids and codebooks are fitted on a sample by a hash, ``SAMPLE`` classes or ``PER_LIST``
for each list; every row is indexed.  Each length of vectors that has ``CODED``
classes, and the most frequent one, has its own; classes of a rarer length
are one list in each label and meet there exactly.

Defined results: rows whose label or vector is null, or whose vector is empty,
zero or holds null or non-finite components, link with nothing and keep their
own id; vectors of different lengths do not link; repeated rows are links of each other; extra columns are dropped; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship_code
from .components import connected_components
from .support import stored

COSINE = 0.93
#: Classes that centroids and codebooks are fitted on.
SAMPLE, PER_LIST = 20_000, 16
#: Half the root of the classes, in these bounds; longer lists are dealt in more chunks.
LISTS = (8, 8192)
#: Centroids nearer to each other than this part of the radius are merged.
MERGED = 0.75
#: A length with fewer classes is not coded, unless it is the most frequent.
CODED = 2000
#: Classes that the probes are learnt from, and the share of their links that must be found.
ASKED, RECALL = 500, 0.998
#: Margins, in parts of the radius: steps of the learnt one, and the least.
MARGIN_STEPS, LEAST_MARGIN = 64, 0.15
SUBSPACES = 8
CODEWORDS = 64
FIT_ROUNDS = 8
SEED = 11
#: Entries of a chunk and queries of a block, at about these numbers.
CHUNK, BLOCK = 2048, 4096


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        own = np.concatenate([squared_distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def merged_centres(points: np.ndarray, centres: np.ndarray, near: float) -> np.ndarray:
    """Centres without those near a centre of more points, which moves to the mean of theirs too."""
    own = np.concatenate([squared_distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])
    n = np.bincount(own, minlength=len(centres)).astype("f8")
    close = squared_distances(centres, centres) < near * near
    left, out = np.ones(len(centres), bool), []
    for k in np.argsort(-n, kind="stable"):
        if left[k]:
            group = np.flatnonzero(close[k] & left | (np.arange(len(centres)) == k))
            left[group] = False
            out.append(np.average(centres[group], 0, np.maximum(n[group], 1e-9)))
    return np.array(out)


class Quantiser:
    """Coarse centroids, and residual codewords per subspace."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float):
        rng = np.random.default_rng(SEED)
        self.dim = sample.shape[1]
        self.margin = radius
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.coarse = merged_centres(sample, k_means(sample, lists, rng), MERGED * radius)
        residual = sample - self.coarse[squared_distances(sample, self.coarse).argmin(1)]
        self.books = [k_means(residual[:, p], CODEWORDS, rng) for p in self.parts]
        between = np.sqrt(squared_distances(self.coarse, self.coarse))
        np.fill_diagonal(between, np.inf)
        self.between = between

    def margins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and how far it is from the cells of all lists: 0 for its own."""
        far = squared_distances(x, self.coarse)
        own = far.argmin(1)
        # far - own = 2 * between * the distance to the plane between the two centroids
        margin = (far - far[np.arange(len(x)), own, None]) / (2 * self.between[own])
        margin[np.arange(len(x)), own] = 0
        return own, margin

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector, and the lists to probe: those up to the learnt margin."""
        own, margin = self.margins(x)
        return own, [np.flatnonzero(r) for r in margin <= self.margin + 1e-9]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance between each vector and what its code stands for."""
        residual, codes, error = x - self.coarse[own], [], np.zeros(len(x))
        for p, book in zip(self.parts, self.books, strict=True):
            d = squared_distances(residual[:, p], book)
            code = d.argmin(1)
            codes.append(code)
            error += d[np.arange(len(x)), code]
        return np.stack(codes, 1).astype(np.uint8), np.sqrt(error)

    def coded_distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the coded entries of a list, from tables."""
        residual = x - self.coarse[which]
        out = np.zeros((len(x), len(codes)))
        for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            out += squared_distances(residual[:, p], book)[:, codes[:, k]]
        return out


def unit_vectors(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed_vectors(batches):
    """Vectors as packed doubles; null where nothing can be compared with them."""
    for batch in batches:
        pdf = batch.to_pandas()
        packed = []
        for v in pdf["embedding"]:
            x = None if v is None else np.array(v, "f8")
            good = x is not None and x.size and np.isfinite(x).all() and np.any(x)
            packed.append((x + 0.0).astype("<f8").tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "label", "vector"])


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges: each node with the least of its component."""
    nodes, at = np.unique(np.r_[x, y], return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def thinned(i: np.ndarray, j: np.ndarray, n: int, m: int) -> np.ndarray:
    """Marks of edges between ``n`` and ``m`` nodes that connect what all of them do: few, if there are many."""
    keep = np.zeros(len(i), bool)
    for nodes, size in ((i, n), (j, m)):
        one = np.full(size, -1)
        one[nodes] = np.arange(len(nodes))
        keep[one[one >= 0]] = True
    label = np.arange(n + m)
    a, b = forest(i[keep], n + j[keep])
    label[a] = b
    return keep | (label[i] != label[n + j])


LINKS = "kind byte, a long, b long"


def list_links(quantisers, cosine: float):
    """Links of the queries (right) to the entries (left) of one list, or of a label and length: counts (0) and forest edges (1)."""
    radius = np.sqrt(2 - 2 * cosine) + 1e-9

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        left, right = entries.to_pandas(), queries.to_pandas()
        out = [(np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(left) and len(right):
            which = int(left["list"].iloc[0])
            y, x = unit_vectors(left["vector"].tolist()), unit_vectors(right["q_vector"].tolist())
            if which >= 0:
                q = quantisers.value[y.shape[1]]
                codes, error = q.encode(y, np.full(len(y), which))
            y_key, x_key, y_n = left["key"].to_numpy(), right["q_key"].to_numpy(), left["n"].to_numpy()
            x_count = np.zeros(len(x), np.int64)
            for k in range(0, len(x), 512):
                rows = slice(k, k + 512)
                if which < 0:
                    i, j = np.nonzero(x[rows] @ y.T >= cosine)
                else:
                    maybe = q.coded_distances(x[rows], which, codes) <= (radius + error) ** 2
                    i, j = np.nonzero(maybe)
                    if len(i) > maybe.size // 8:
                        good = (x[rows] @ y.T)[i, j] >= cosine
                    else:
                        good = np.einsum("nd,nd->n", x[rows][i], y[j]) >= cosine
                    i, j = i[good], j[good]
                i = i + k
                apart = x_key[i] != y_key[j]
                i, j = i[apart], j[apart]
                np.add.at(x_count, i, y_n[j])
                if len(i):
                    few = thinned(i - k, j, len(x[rows]), len(y))
                    a, b = forest(x_key[i[few]], y_key[j[few]])
                    out.append((np.ones(len(a), np.int8), a, b))
            some = x_count > 0
            out.append((np.zeros(some.sum(), np.int8), x_key[some], x_count[some]))
        kind, a, b = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"kind": pa.array(kind, pa.int8()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def by_length(vectors: list[bytes], quantisers: dict[int, Quantiser]) -> dict[int, np.ndarray]:
    """Places of the vectors of each coded length."""
    lengths = np.array([len(v) // 8 for v in vectors])
    return {dim: at for dim in quantisers if len(at := np.flatnonzero(lengths == dim))}


def place_rows(quantisers):
    def run(batches):
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            # -1 names the list of all vectors of a length that is not coded
            own = np.full(len(vectors), -1, "i4")
            probes = [[-1]] * len(vectors)
            for dim, at in by_length(vectors, quantisers.value).items():
                own[at], reached = quantisers.value[dim].place(unit_vectors([vectors[i] for i in at]))
                for i, p in zip(at, reached, strict=True):
                    probes[i] = p.tolist()
            columns = [*batch.columns, pa.array(own, pa.int32()), pa.array(probes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "key", "vector", "n", "home", "probes"])

    return run


def margins_of_links(quantisers, asked, cosine: float):
    """How many links each asked class has in each step of its lists' margins: at most so many rows a task."""

    def run(batches):
        found = {}
        for batch in batches:
            vectors, label, key = batch.column(2).to_pylist(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim, at in by_length(vectors, quantisers.value).items():
                q = quantisers.value[dim]
                x, x_label, x_key, margin, radius = asked.value[dim]
                held = found.setdefault(dim, np.zeros((len(x), MARGIN_STEPS + 1), np.int64))
                y = unit_vectors([vectors[i] for i in at])
                home = q.margins(y)[0]
                j, i = np.nonzero((y @ x.T >= cosine) & (label[at][:, None] == x_label) & (key[at][:, None] != x_key))
                step = np.ceil(margin[i, home[j]] / radius * MARGIN_STEPS).clip(0, MARGIN_STEPS).astype(int)
                np.add.at(held, (i, step), 1)
        rows = [(dim, i, step, held[i, step]) for dim, held in found.items() for i, step in zip(*np.nonzero(held), strict=True)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], ["dim", "asked", "step", "n"])

    return run


def learn_margins(classes: DataFrame, quantisers: dict[int, Quantiser], samples: dict, cosine: float, recall: float) -> None:
    """Set each quantiser's margin so that the asked classes find this share of their links with all classes."""
    context, radius = classes.sparkSession.sparkContext, float(np.sqrt(2 - 2 * cosine))
    questions = {}
    for dim, (x, label, key) in samples.items():
        questions[dim] = (x[:ASKED], label[:ASKED], key[:ASKED], quantisers[dim].margins(x[:ASKED])[1], radius)
    shared, asked = context.broadcast(quantisers), context.broadcast(questions)
    found = classes.select("label", "key", "vector").mapInArrow(margins_of_links(shared, asked, cosine), "dim long, asked long, step long, n long")
    rows = found.groupBy("dim", "asked", "step").agg(F.sum("n").alias("n")).collect()  # ASKED * MARGIN_STEPS for each length, at most
    for dim, q in quantisers.items():
        held = np.zeros((ASKED, MARGIN_STEPS + 1))
        for row in rows:
            if row["dim"] == dim:
                held[row["asked"], row["step"]] = row["n"]
        some = held[held.sum(1) > 0]
        step = 0
        if len(some):
            upto = np.cumsum(some, 1)
            whole, mean = upto.sum(0) / some.sum(), (upto / upto[:, -1:]).mean(0)
            step = int(np.argmax(np.minimum(whole, mean) >= recall - 1e-12))
        q.margin = radius * min(1.0, max(LEAST_MARGIN, step / MARGIN_STEPS))
    shared.unpersist()
    asked.unpersist()


def fitted(classes: DataFrame, cosine: float, recall: float) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors that is coded, with its learnt margin."""
    radius = float(np.sqrt(2 - 2 * cosine))
    sizes = classes.groupBy((F.octet_length("vector") / 8).cast("int").alias("dim")).count().orderBy(F.desc("count"), "dim")
    quantisers, samples = {}, {}
    for dim, total in [(r["dim"], r["count"]) for r in sizes.where(F.col("count") >= CODED).collect() or sizes.limit(1).collect()]:
        lists = int(np.clip(np.sqrt(total) / 2, *LISTS))
        # a bounded sample, in order of the keys (hashes)
        own = classes.where(F.octet_length("vector") == dim * 8).select("label", "key", "vector")
        rows = own.orderBy("key").limit(max(SAMPLE, PER_LIST * lists)).collect()
        x = unit_vectors([bytes(r["vector"]) for r in rows])
        samples[dim] = (x, np.array([r["label"] for r in rows]), np.array([r["key"] for r in rows]))
        quantisers[dim] = Quantiser(x, lists, radius)
    if recall < 1 and quantisers:
        learn_margins(classes, quantisers, samples, cosine, recall)
    return quantisers


def near_duplicates(
    embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row; ``recall`` is that of the learnt probes (1: all links)."""
    spark = embeddings.sparkSession
    ship_code(spark)
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")
    ).mapInArrow(packed_vectors, "vec_id long, label long, vector binary")
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull()
    rows = stored(rows.withColumn("key", F.when(usable, F.xxhash64("label", "vector"))), "vectors")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    compared = rows.where("key is not null")
    classes = stored(
        compared.groupBy("key").agg(F.min("label").alias("label"), F.min("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("least")),
        "classes",
    )
    quantisers = spark.sparkContext.broadcast(fitted(classes, cosine, recall))
    if not quantisers.value:
        return alone.select("*", F.lit(True).alias("kept"))
    placed = stored(
        classes.select("label", "key", "vector", "n").mapInArrow(place_rows(quantisers), "label long, key long, vector binary, n long, home int, probes array<int>"),
        "placed",
    )
    dim = (F.octet_length("vector") / 8).cast("int").alias("dim")
    asked = placed.select("label", dim, "key", "vector", F.explode("probes").alias("list"))
    held = placed.select("label", dim, "key", "vector", "n", F.col("home").alias("list"))
    # chunks of entries and blocks of queries in each list
    entries_in = held.groupBy("label", "dim", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    queries_in = asked.groupBy("label", "dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = stored(entries_in.join(queries_in, ["label", "dim", "list"]), "sizes")
    entries = (
        held.join(sizes, ["label", "dim", "list"])
        .withColumn("chunk", F.pmod("key", "chunks").cast("long"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    queries = (
        asked.join(sizes, ["label", "dim", "list"])
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
    )
    key = ["label", "dim", "list", "chunk", "block"]
    found = (
        entries.select(*key, "key", "vector", "n")
        .groupBy(*key)
        .cogroup(queries.select(*[F.col(c).alias(f"q_{c}") for c in (*key, "key", "vector")]).groupBy(*[f"q_{c}" for c in key]))
        .applyInArrow(list_links(quantisers, cosine), LINKS)
    )
    found = stored(found, "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("linked"))
    roots = connected_components(found.where("kind = 1").select("a", "b"))
    quantisers.unpersist()
    rooted = classes.join(counts, "key", "left").join(roots, classes["key"] == roots["node"], "left")
    rooted = rooted.select(classes["key"], "n", "least", "linked", F.coalesce("root", classes["key"]).alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(component, "root").select("key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = compared.select("vec_id", "key").join(named, "key").select("vec_id", F.col("n_links").cast("long"), "component_id")
    return out.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
