"""Quality scores from random-indexing word vectors, pooled by document, and a two-layer network.

Each word has an index vector: a few signed ones at places its hash gives. A word's vector is the sum of the index
vectors of its neighbours over the whole corpus, kept in a table of fixed size whose rows rare words share; tasks sum
their texts and Spark the tasks. A document is the mean of its words' vectors, of their index vectors and of those of
their endings, with its length, word length and the shares of distinct words and of words that repeat the one before.
The network is fitted in numpy to a bounded sample of labelled documents (``sample``, at random by hash of the id), a
fifth of which is kept apart to set the temperature that calibrates its probabilities. Everything else covers all
documents; only labels and texts are used.

Defined cases: null and empty texts have zero means and get the score that follows from that; rows with equal ids or
texts are each scored; several labels of an id count as the lowest; labels that are null or without a document
count for nothing; without labels, or with labels of one kind, every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import RangeHash, Words, mixed, slices, texts_of

ROWS = 1 << 15
SIZE = 32
ENDING_SIZE = 64
ONES = 2
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
FEATURES = 2 * SIZE + ENDING_SIZE + 4


def _ones(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ones of index vectors, ``ONES`` for each key."""
    bits = mixed(keys.astype(np.uint64)[:, None] * np.uint64(ONES) + np.arange(1, ONES + 1, dtype=np.uint64))
    return (bits % np.uint64(size)).astype(np.int64), 1.0 - 2.0 * ((bits >> np.uint64(40)) & np.uint64(1)).astype(np.float64)


def index_vectors(rows: int, size: int) -> np.ndarray:
    places, signs = _ones(np.arange(rows), size)
    out = np.zeros((rows, size), np.float32)
    np.add.at(out, (np.repeat(np.arange(rows), ONES), places.ravel()), signs.ravel())
    return out


class Units:
    """Words of texts with the table rows of the words and of their endings."""

    def __init__(self, texts: list[bytes], hashes: RangeHash) -> None:
        words = Words([x.split() for x in texts])
        self.first, self.doc = words.first, words.doc
        self.sizes = words.ends - words.starts
        if not len(self.doc):
            self.word = self.ending = np.zeros(0, np.int64)
            return
        hashes.load(words.data)
        self.word = (hashes.of(words.starts, words.ends) % np.uint64(ROWS)).astype(np.int64)
        ending = hashes.of(np.maximum(words.starts, words.ends - 3), words.ends)
        # Endings of words that start in upper case are endings of their own.
        upper = (words.data[words.starts] >= 65) & (words.data[words.starts] <= 90)
        self.ending = ((ending + upper.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)) % np.uint64(ROWS)).astype(np.int64)


def word_vectors(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Table of word vectors (unit length, shorter for rows with few neighbours), summed over all documents."""
    columns = [f"v{i}" for i in range(SIZE)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RangeHash()
        places, signs = _ones(np.arange(ROWS), SIZE)
        total = np.zeros(ROWS * SIZE)
        for batch in slices(batches, "text"):
            units = Units(texts_of(batch, "text"), hashes)
            pair = np.flatnonzero(np.diff(units.doc) == 0)
            left, right = units.word[pair], units.word[pair + 1]
            own, other = np.concatenate((left, right)), np.concatenate((right, left))
            at = (own[:, None] * SIZE + places[other]).ravel()
            total += np.bincount(at, signs[other].ravel(), ROWS * SIZE)
        table = total.reshape(ROWS, SIZE)
        row = np.flatnonzero(np.abs(table).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row.astype(np.int32)), *(pa.array(table[row, i].astype(np.float32)) for i in range(SIZE))], ["row", *columns]
        )

    schema = "row int, " + ", ".join(f"{c} float" for c in columns)
    found = docs.select(F.col(text_column).alias("text")).mapInArrow(sums, schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((ROWS, SIZE), np.float32)
    rows = found.column("row").to_numpy()
    for i, c in enumerate(columns):
        out[rows, i] = found.column(c).to_numpy()
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 10)


def pooled(texts: list[bytes], vectors: np.ndarray, index: np.ndarray, endings: np.ndarray, hashes: RangeHash) -> np.ndarray:
    units = Units(texts, hashes)
    n = np.diff(units.first)
    out = np.zeros((len(texts), FEATURES), np.float32)
    filled = np.flatnonzero(n)
    if not len(filled):
        return out
    starts = units.first[:-1][filled]
    counts = n[filled, None]
    place = 0
    for table, rows in ((vectors, units.word), (index, units.word), (endings, units.ending)):
        width = table.shape[1]
        for a in range(0, width, 16):  # some columns at once: a batch of vectors stays small
            out[filled, place + a : place + a + 16] = np.add.reduceat(table[:, a : a + 16][rows], starts, axis=0) / counts
        place += width
    distinct = np.unique(units.doc * ROWS + units.word) // ROWS
    out[filled, place] = np.log1p(n[filled])
    out[filled, place + 1] = np.log1p(np.add.reduceat(units.sizes, starts) / n[filled])
    out[filled, place + 2] = np.bincount(distinct, minlength=len(texts))[filled] / n[filled]
    same = np.flatnonzero((units.word[1:] == units.word[:-1]) & (units.doc[1:] == units.doc[:-1]))
    out[filled, place + 3] = np.bincount(units.doc[same], minlength=len(texts))[filled] / n[filled]
    return out


@dataclass
class Network:
    """Standardised inputs, a tanh layer, a logit divided by the temperature. Without weights: a constant."""

    constant: float = 0.5
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, spread, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 11) -> Network:
        if len(set(y.tolist())) < 2:
            return cls(float(y.mean()) if len(y) else 0.5)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        apart, own = order[: len(x) // 5], order[len(x) // 5 :]
        mean, spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
        z = (x - mean) / spread
        weights = [
            rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)
        ]
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
        step = 0
        # Small samples are gone through more often.
        for _ in range(max(epochs, min(120, 200_000 // max(1, len(own))))):
            for batch in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
                step += 1
                h = np.tanh(z[batch] @ weights[0] + weights[1])
                error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - y[batch]) / len(batch)
                back = error[:, None] * weights[2] * (1 - h**2)
                slopes = [z[batch].T @ back, back.sum(axis=0), h.T @ error, error.sum(keepdims=True)]
                for i, (w, slope) in enumerate(zip(weights, slopes, strict=True)):
                    slope = slope + 1e-3 * w
                    moments[i][0] = 0.9 * moments[i][0] + 0.1 * slope
                    moments[i][1] = 0.999 * moments[i][1] + 0.001 * slope**2
                    rate = 0.003 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                    weights[i] = w - rate * moments[i][0] / (moments[i][1] ** 0.5 + 1e-8)
        made = cls(layers=(mean, spread, *weights))
        if len(apart):
            logits = made.logits(x[apart])
            scales = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
            losses = [np.mean(np.logaddexp(0, -np.where(y[apart] > 0, 1, -1) * logits / t)) for t in scales]
            made.temperature = float(scales[int(np.argmin(losses))])
        made.layers = tuple(np.asarray(w, np.float32) for w in made.layers)
        return made


def _features(docs: DataFrame, text_column: str, keys: list[tuple[Column, str]], vectors: np.ndarray, network: Network | None) -> DataFrame:
    """Key columns and, by a network, the score, or without one the features as packed floats."""
    names = [name for _, name in keys]
    rows = docs.select(*(c.alias(name) for c, name in keys), F.col(text_column).alias("text_"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("text_").dtypes) + (", score double" if network else ", x binary")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, index, endings = RangeHash(), index_vectors(ROWS, SIZE), index_vectors(ROWS, ENDING_SIZE)
        for batch in slices(batches, "text_"):
            x = pooled(texts_of(batch, "text_"), vectors, index, endings, hashes)
            made = pa.array(network.probabilities(x)) if network else pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*names, "score" if network else "x"])

    return rows.mapInArrow(make, schema)


def train(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", sample: int = SAMPLE,
) -> Network:
    """Fit to at most ``sample`` of the labelled documents."""
    usable = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    chosen = usable.groupBy(F.col(id_column).alias("key")).agg(F.min(label_column).alias("y"))
    # About twice as many as wanted are sorted; the bound makes this side small enough to broadcast.
    place, share = F.pmod(F.xxhash64("key"), F.lit(1 << 40)), min(1.0, 2 * sample / max(1, chosen.count()))
    chosen = F.broadcast(chosen.where(place <= int(share * (1 << 40))).orderBy(place, "key").limit(sample))
    own = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).join(chosen, "key")
    found = _features(own, "text", [(F.col("key"), "key"), (F.col("y").cast("double"), "y")], vectors, None).toArrow()
    order = np.argsort(np.array([str(k) for k in found.column("key").to_pylist()]), kind="stable")
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    return Network.fit(x[order], found.column("y").to_numpy()[order])


def score(
    docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text",
    **options: object,
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of held-out ids are not learned from."""
    vectors = word_vectors(docs, text_column)
    network = train(docs, labels.where(~held_out), vectors, id_column, text_column, **options)
    rows = _features(docs, text_column, [(F.col(id_column), "doc_id"), (held_out, "held_out")], vectors, network)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
