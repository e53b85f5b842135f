"""Toxicity scores from a recurrent network over words and their characters.

Each word has an embedding of its own and, from its characters, the maximum over
the embeddings of its character n-grams (with its borders); both tables are
hashed.  A bidirectional gated recurrent network reads windows of ``WINDOW``
words, attention pools its states, and a logistic unit scores the window.  All
windows of a text overlap by half and are all scored; a text's score is that of
its most toxic window.

Training (numpy, on the driver) sees at most ``TOXIC_ROWS`` and ``CLEAN_ROWS``
labelled rows and ``TRAINING_BYTES`` of text of each kind, whole texts in order of
a hash of their ids.  All weights start at random; nothing is counted about words
but how many texts have them, whatever their labels.  Labels belong to texts, not
windows: at first any window of a text has its label, then, round by round, the
window that the model finds most toxic so far stands for the text.  Batches hold
as many toxic as clean windows, and a text has the score of its most toxic one; so
texts put aside calibrate the scores, weighted by the share of toxic rows among
all that are labelled, and scores mean the same at every size.

Defined results: null and empty texts have one empty window and a score like any
other; any length is scored whole; without labelled rows of both kinds every
score is the share of toxic ones (0.0 without any); of labels that repeat an id
the greatest counts; repeated rows each get a row; extra columns are dropped;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship_code

#: Labelled rows to learn from, at most; of each kind, those whose texts stay within so many bytes in order of a hash,
#: texts of more than ``LONG_TEXT`` bytes last.  The first of each kind is always among them.
TOXIC_ROWS = 800
CLEAN_ROWS = 2000
TRAINING_BYTES = 6 << 20
LONG_TEXT = 256 << 10
WINDOW = 32
STEP = 16
HIDDEN = 12
WORD_BITS, GRAM_BITS = 17, 18
#: Standard deviation of the embeddings at first.
SPREAD = 0.01
#: Components of a word's and of a character n-gram's embedding.
PARTS = 4
GRAMS = (4, 6, 8)
#: Windows in a step; steps on any windows first, then rounds of steps on the most toxic ones.
BATCH = 256
FIRST_STEPS, ROUNDS, ROUND_STEPS = 200, 2, 60
RATE, TABLE_RATE = 0.03, 0.1
#: Share of words that a step swaps.
SWAPPED = 0.5
#: Share of the texts that the calibration has for itself.
ASIDE = 0.2
#: Share of toxic texts, the least toxic looking ones, that are taken for mislabelled after the first steps.
DOUBTED = 0.1
#: Words and n-grams of fewer texts keep their first embeddings.
LEAST_TEXTS = 12
SEED = 7
#: Words that are worked on at once, at about this number.
FLAT_WORDS = 150_000
#: Bytes that separate words besides letters, digits and bytes above 127.
BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(BREAKS).split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """The distinct words of some texts, and where each text's words are among them."""

    def __init__(self, texts: list[list[bytes]]):
        index: dict[bytes, int] = {}
        known = index.setdefault
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ids = np.fromiter((known(w, len(index)) for t in texts for w in t), np.int64, int(self.sizes.sum()))
        words = list(index)
        self.word_slots = np.array([xxhash.xxh3_64_intdigest(w) & ((1 << WORD_BITS) - 1) for w in words], np.int64)
        self.n = len(words)
        self._grams(words)

    def _grams(self, words: list[bytes]) -> None:
        """Slots of all character n-grams, by word; line feeds mark a word's borders."""
        data = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8).astype(np.uint64)
        border = data == 10
        word_at = np.cumsum(border) - 1
        slots, owners = [], []
        with np.errstate(over="ignore"):
            for n in GRAMS:
                m = len(data) - n + 1
                if m <= 0:
                    continue
                value, inner = np.zeros(m, np.uint64), np.zeros(m, bool)
                for k in range(n):
                    value = value * np.uint64(0x100000001B3) + data[k : k + m] + np.uint64(n)
                    if 0 < k < n - 1:
                        inner |= border[k : k + m]
                good = np.flatnonzero(~inner)
                value = value[good] * np.uint64(0x9E3779B97F4A7C15)
                slots.append((value >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
                owners.append(word_at[good])
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        self.gram_slots, self.gram_words = slot[order].astype(np.int32), owner[order].astype(np.int32)
        self.with_grams, self.gram_starts = np.unique(self.gram_words, return_index=True)

    def text_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct words: the word and the text."""
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        pairs = np.unique(self.ids * len(self.sizes) + text)
        return pairs // len(self.sizes), pairs % len(self.sizes)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of all windows (-1 beyond a text's end), how many are in use, and the text of each."""
        counts = np.maximum(1, -(-(self.sizes - WINDOW) // STEP) + 1)
        text = np.repeat(np.arange(len(self.sizes)), counts)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
        used = np.minimum(WINDOW, self.sizes[text] - place)
        at = (np.cumsum(self.sizes) - self.sizes)[text] + place
        grid = at[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < used[:, None]
        ids = np.full(grid.shape, -1, np.int32)
        ids[inside] = self.ids[grid[inside]]
        return ids, used, text


class Network:
    """Weights and the two passes over a batch of windows."""

    def __init__(self, rng: np.random.Generator):
        inputs, draw = 2 * PARTS, lambda *shape: (rng.standard_normal(shape) * 0.3).astype("f4")
        self.word = (rng.standard_normal((1 << WORD_BITS, PARTS)) * SPREAD).astype("f4")
        self.gram = (rng.standard_normal((1 << GRAM_BITS, PARTS)) * SPREAD).astype("f4")
        self.w = {}
        for way in "fb":
            self.w |= {f"W{way}": draw(inputs, 3 * HIDDEN), f"U{way}": draw(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, "f4")}
        self.w |= {"attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, "f4")}

    def tables(self) -> dict[str, np.ndarray]:
        return {"word": self.word, "gram": self.gram, **self.w}

    def embed(self, v: Vocabulary) -> np.ndarray:
        """A row per distinct word, and a last one of zeros for places without a word."""
        out = np.zeros((v.n + 1, 2 * PARTS), "f4")
        out[:-1, :PARTS] = self.word[v.word_slots]
        if len(v.gram_slots):
            out[v.with_grams, PARTS:] = np.maximum.reduceat(self.gram[v.gram_slots], v.gram_starts, axis=0)
        return out

    def _run(self, projected: np.ndarray, ids: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        u, n, h = self.w[f"U{way}"], len(ids), np.zeros((len(ids), HIDDEN), "f4")
        states, tape = np.zeros((WINDOW, n, HIDDEN), "f4"), []
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            a = projected[ids[:, t]]
            gates = sigmoid(a[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            if keep:
                tape.append((t, h, z, r, c))
            h = np.where(ids[:, t, None] >= 0, h + z * (c - h), h)
            states[t] = h
        return states, tape

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: bool = False):
        runs = [self._run(x @ self.w[f"W{way}"] + self.w[f"b{way}"], ids, way, keep) for way in "fb"]
        states = np.concatenate([runs[0][0], runs[1][0]], axis=2)
        weight = states @ self.w["attend"]
        weight = np.where(ids.T >= 0, weight, -30)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ self.w["out"] + self.w["bias"]
        return logits, (states, weight, pooled, [r[1] for r in runs])

    def backward(self, x: np.ndarray, ids: np.ndarray, kept, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of ``x``, given that of the logits."""
        states, weight, pooled, tapes = kept
        grads = {"out": pooled.T @ slope, "bias": slope.sum(keepdims=True)}
        pooled_slope = slope[:, None] * self.w["out"]
        along = np.einsum("tnh,nh->tn", states, pooled_slope)
        weight_slope = weight * (along - (weight * along).sum(axis=0))
        grads["attend"] = np.einsum("tn,tnh->h", weight_slope, states)
        states_slope = weight[:, :, None] * pooled_slope + weight_slope[:, :, None] * self.w["attend"]
        x_slope = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, w = self.w[f"U{way}"], self.w[f"W{way}"]
            du, da_sum = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), "f4")
            dh = np.zeros((len(ids), HIDDEN), "f4")
            for t, h, z, r, c in reversed(tapes[k]):
                live = ids[:, t, None] >= 0
                total = dh + states_slope[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                here = np.where(live, total, 0)
                dz, dc = here * (c - h) * z * (1 - z), here * z * (1 - c * c)
                rh = dc @ u[:, 2 * HIDDEN :].T
                dr = rh * h * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                du[:, : 2 * HIDDEN] += h.T @ da[:, : 2 * HIDDEN]
                du[:, 2 * HIDDEN :] += (r * h).T @ dc
                dh = np.where(live, here * (1 - z) + rh * r + da[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T, total)
                np.add.at(da_sum, ids[:, t], da)
            da_sum[-1] = 0
            grads |= {f"U{way}": du, f"W{way}": x.T @ da_sum, f"b{way}": da_sum.sum(axis=0)}
            x_slope += da_sum @ w.T
        return grads, x_slope

    def logits(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x, ids[k : k + 2_000])[0] for k in range(0, len(ids), 2_000)])

    def scores(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit of every window; with the windows' ids, and their texts and the best window of each text."""
        x = self.embed(v)
        ids, _, text = v.windows()
        logits = self.logits(x, ids)
        order = np.lexsort((-logits, text))
        best = order[np.r_[True, text[order][1:] != text[order][:-1]]]
        return logits, ids, text, best


def train(texts: list[str], labels: list[int], toxic_share: float | None = None) -> Network | float:
    """The network, or the share of toxic texts where one kind is missing.

    All windows of the texts are learnt from.  At first a window has its text's
    label; then, round by round, the window of each text that looks most toxic
    stands for it, and clean texts bring their other windows along.  Both kinds
    make up half of each batch; texts put aside calibrate the scores at the end,
    weighted by ``toxic_share`` (that of all labelled rows).
    """
    toxic = np.array(labels, np.float64)
    if not len(toxic) or toxic.min() == toxic.max():
        return float(toxic.mean()) if len(toxic) else 0.0
    rng = np.random.default_rng(SEED)
    net, v = Network(rng), Vocabulary([words_of(t) for t in texts])
    ids, _, text = v.windows()
    learner = Learner(net, v, v.ids[np.repeat(toxic == 0, v.sizes)])
    begins, counts = np.searchsorted(text, np.arange(len(texts))), np.bincount(text, minlength=len(texts))
    # some texts of both kinds are put aside for the scores' calibration
    order = rng.permutation(len(texts))
    kinds = [order[toxic[order] == kind] for kind in (0, 1)]
    aside = np.concatenate([k[: int(ASIDE * len(k))] for k in kinds])
    kinds = [k[int(ASIDE * len(k)) :] for k in kinds]
    half = BATCH // 2

    def any_window(kind: int, size: int) -> np.ndarray:
        own = rng.choice(kinds[kind], size)
        return begins[own] + (rng.random(size) * counts[own]).astype(np.int64)

    y = np.repeat([1.0, 0.0], half)
    for _ in range(FIRST_STEPS):
        learner.step(ids[np.r_[any_window(1, half), any_window(0, half)]], y)
    mean, taken = {}, 0
    for _ in range(ROUNDS):
        logits = net.logits(net.embed(v), ids)
        order = np.lexsort((-logits, text))
        best = order[np.r_[True, text[order][1:] != text[order][:-1]]]
        sure = kinds[1][np.argsort(logits[best[kinds[1]]], kind="stable")[int(DOUBTED * len(kinds[1])) :]]
        for _ in range(ROUND_STEPS):
            hard = best[rng.choice(kinds[0], half // 2)]
            learner.step(ids[np.r_[best[rng.choice(sure, half)], hard, any_window(0, half - half // 2)]], y)
            taken += 1
            for name, now in net.tables().items():  # the mean over the steps is steadier than the last of them
                mean[name] = now.astype("f4") if taken == 1 else mean[name] + (now - mean[name]) / taken
    net.word, net.gram = mean.pop("word"), mean.pop("gram")
    net.w = mean
    logits = net.logits(net.embed(v), ids)
    most = np.maximum.reduceat(logits, begins).astype("f8")
    share = float(np.clip(toxic.mean() if toxic_share is None else toxic_share, 1e-3, 1 - 1e-3))
    scale, shift = calibrated(most[aside], toxic[aside], share) if min(np.bincount(toxic[aside].astype(int), minlength=2)) else (1.0, np.log(share / (1 - share)))
    net.w["out"] = (scale * net.w["out"]).astype("f4")
    net.w["bias"] = (scale * net.w["bias"] + shift).astype("f4")
    return net


def calibrated(logits: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and shift of the texts' logits with the least loss, where so many of all texts are toxic."""
    weight = np.where(toxic > 0, share / toxic.mean(), (1 - share) / (1 - toxic.mean())) / len(toxic)
    loss = {
        (scale, shift): float((weight * np.logaddexp(0, np.where(toxic > 0, -1, 1) * (scale * logits + shift))).sum()) + shift * shift / (50 * len(toxic))
        for scale in (0.25, 0.5, 0.75, 1.0)
        for shift in np.linspace(-6, 4, 101).tolist()
    }
    return min(loss, key=loss.get)


class Learner:
    """Adaptive steps of a network's weights, and of the embeddings of the words that a batch has."""

    def __init__(self, net: Network, v: Vocabulary, clean: np.ndarray):
        """``clean`` are the words of the clean texts, as often as they stand there."""
        self.net, self.v, self.clean, self.steps = net, v, clean if len(clean) else np.array([-1]), 0
        self.moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in net.w.items()}
        self.squares = {"word": np.full_like(net.word, 1e-3), "gram": np.full_like(net.gram, 1e-3)}
        self.starts = np.searchsorted(v.gram_words, np.arange(v.n + 1))
        self.rng = np.random.default_rng(SEED + 1)
        # in how many texts a word stands, and its n-grams at most; too few would only tell those very texts apart
        texts = np.bincount(v.text_words()[0], minlength=v.n)
        self.common = {
            "word": np.bincount(v.word_slots, texts, 1 << WORD_BITS) >= LEAST_TEXTS,
            "gram": np.bincount(v.gram_slots, texts[v.gram_words], 1 << GRAM_BITS) >= LEAST_TEXTS,
        }

    def step(self, ids: np.ndarray, y: np.ndarray) -> None:
        net, v = self.net, self.v
        # some words are swapped for words of clean texts, so that no text is known by what happens to surround its cause
        swapped = (self.rng.random(ids.shape) < SWAPPED) & (ids >= 0)
        ids = np.where(swapped, self.clean[self.rng.integers(0, len(self.clean), ids.shape)], ids)
        present, inverse = np.unique(ids, return_inverse=True)
        gap = int(present[0] < 0)
        words, local = present[gap:], inverse.reshape(ids.shape) - gap
        x, rows, owner, starts, has = self._embed(words)
        local = np.where(ids < 0, -1, local)
        logits, kept = net.forward(x, local, keep=True)
        slope = ((sigmoid(logits) - y) / len(y)).astype("f4")
        grads, x_slope = net.backward(x, local, kept, slope)
        self.steps += 1
        for name, g in grads.items():
            m, s = self.moments[name]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            net.w[name] -= (RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)).astype("f4")
        self._learn("word", v.word_slots[words], x_slope[:-1, :PARTS])
        if len(rows):
            # only the greatest of a word's n-grams had a part in it
            values = net.gram[v.gram_slots[rows]]
            top = values == x[:-1][owner, PARTS:]
            self._learn("gram", v.gram_slots[rows], np.where(top, x_slope[:-1][owner, PARTS:], 0))

    def _embed(self, words: np.ndarray):
        net, v = self.net, self.v
        counts = self.starts[words + 1] - self.starts[words]
        places = np.cumsum(counts) - counts
        rows = np.repeat(self.starts[words] - places, counts) + np.arange(counts.sum())
        owner = np.repeat(np.arange(len(words)), counts)
        has = np.flatnonzero(counts)
        x = np.zeros((len(words) + 1, 2 * PARTS), "f4")
        x[:-1, :PARTS] = net.word[v.word_slots[words]]
        if len(rows):
            x[has, PARTS:] = np.maximum.reduceat(net.gram[v.gram_slots[rows]], places[has], axis=0)
        return x, rows, owner, places, has

    def _learn(self, name: str, slots: np.ndarray, slope: np.ndarray) -> None:
        table, square = getattr(self.net, name), self.squares[name]
        common = self.common[name][slots]
        slots, slope = slots[common], slope[common]
        touched, inverse = np.unique(slots, return_inverse=True)
        total = np.stack([np.bincount(inverse, slope[:, k], len(touched)) for k in range(PARTS)], 1).astype("f4")
        square[touched] += total * total
        table[touched] -= TABLE_RATE * total / np.sqrt(square[touched])


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int], float]:
    """Texts and labels to learn from, of rows that are not held out, and the toxic share of all such rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    by = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*by).limit(TOXIC_ROWS).unionByName(known.where("toxic = 0").orderBy(*by).limit(CLEAN_ROWS))
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # both bounded by the limits; repeated ids count once
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # sizes alone decide, so no long text passes through the sorted partition; a long one never costs others their place
    sizes = texts.select("doc_id", "toxic", F.octet_length("text").alias("size"))
    in_order = Window.partitionBy("toxic").orderBy(F.col("size") > LONG_TEXT, *by)
    upto = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = sizes.select("doc_id", upto.alias("upto"), F.row_number().over(in_order).alias("place")).where((F.col("upto") <= TRAINING_BYTES) | (F.col("place") == 1))
    rows = texts.join(F.broadcast(kept.select("doc_id")), "doc_id", "left_semi").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows], share


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def scored_batches(model, rows: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their texts' scores."""
    net = model.value
    for batch in rows:
        column, start, held = batch.column(text_at), 0, 0
        texts: list[list[bytes]] = []
        for k in range(len(column)):
            texts.append(words_of(column[k].as_py()))
            held += len(texts[-1])
            if held >= FLAT_WORDS or k + 1 == len(column):
                if isinstance(net, float):
                    scores = np.full(len(texts), net)
                else:
                    logits, _, _, best = net.scores(Vocabulary(texts))
                    scores = sigmoid(logits[best].astype(np.float64))
                yield batch.slice(start, k + 1 - start), scores
                start, held, texts = k + 1, 0, []


def score_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    spark = documents.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(train(*labelled_sample(documents, labels, id_col, text_col, label_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, scores in scored_batches(model, batches, 2):
            columns = [rows.column(0), rows.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype("i4"), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``documents``, all columns, whose text is not found toxic."""
    spark = documents.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(train(*labelled_sample(documents, labels, id_col, text_col, label_col)))
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, scores in scored_batches(model, batches, at):
            yield rows.filter(pa.array(scores < 0.5, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
