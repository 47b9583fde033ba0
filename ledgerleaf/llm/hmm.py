"""Language-model scores from a hidden Markov model over word classes.

Tokens are words (lower case A-Z, split at ASCII white space) and one end for each text. Counts of all training tokens
are summed by Spark and stay a distributed table. The most frequent words are classes of their own; all others share
classes by their last bytes. A hidden state emits a class, and a class one of its words in proportion to the count
plus 0.5, where each shared class also holds one unknown word. So probabilities sum to 1 over known words, the end
and unknown words, and the model's tables have a fixed size, whatever the vocabulary.

Training is Baum-Welch: each task runs the scaled forward and backward recursions over its whole texts and sums the
expected counts of starts, transitions and emissions; Spark sums those over partitions, and the driver divides.
Scoring runs the scaled forward recursion over whole texts, side by side for many texts, which is the exact likelihood.
Counts of listed words travel with the code; for all others the words of the texts are joined to the table of counts,
free of the frequent words that would make hot keys.

Defined cases: null and empty texts are the end token alone; rows with equal ids or texts are each scored; rows
without id are training rows; without any training text every token is unknown and the score is the base score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import slices, stored, texts_of

STATES = 8
OWN_CLASSES = 12_288
SHARED_CLASSES = 4_096
# Words whose counts travel with the code; the first of them have classes of their own.
LISTED = 50_000
ITERATIONS = 6
# Steps that are gone through at once, and the texts, and tokens of these, that a task trains on side by side: forward
# values of so many tokens are held.
PIECE = 128
HELD_TEXTS, HELD_TOKENS = 4096, 1_000_000
# Weight, in tokens, of the class frequencies that smooth each state's emissions.
PRIOR = 500.0
END = b"\n"
# Words counted by a task before it hands its counts on.
HELD_WORDS = 300_000
_TAIL_BYTES = 3


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


@dataclass
class Vocabulary:
    """Listed words with their numbers and counts, all tokens N, distinct tokens V, the mass of each class."""

    listed: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int
    masses: np.ndarray
    own: int

    def classes(self, numbers: np.ndarray) -> np.ndarray:
        """Class of each listed number; a number below 0 is a shared class, counted from -1 down."""
        return np.where(numbers < 0, self.own - 1 - numbers, self._class_of_listed[np.maximum(numbers, 0)])

    def __post_init__(self) -> None:
        shared = np.array([self.own + shared_class(w) for w in self.listed], np.int64)
        self._class_of_listed = np.where(np.arange(len(shared)) < self.own, np.arange(len(shared)), shared)
        if not len(shared):
            self._class_of_listed = np.zeros(1, np.int64)


def shared_class(word: bytes) -> int:
    return zlib.crc32(word[-_TAIL_BYTES:]) % SHARED_CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (word, n) over all tokens of a column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, "text"):
            for text in texts_of(batch, "text"):
                held.update(tokens_of(text))
            if len(held) > HELD_WORDS:
                yield made()
        if held:
            yield made()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, listed: int = LISTED, own: int = OWN_CLASSES) -> Vocabulary:
    """From the stored counts: bounded lists and sums reach the driver, the counts stay where they are."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # Counts by their powers of two tell which words can be listed: only these are sorted and reach the driver.
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("words"))
    above, least = 0, 0
    for r in sorted(powers.collect(), key=lambda r: -r.power):
        above, least = above + r.words, r.power
        if above >= listed:
            break
    top = counts.where(F.col("n") >= (1 << least)).orderBy(F.desc("n"), "word").limit(listed).collect()
    words = {bytes(r.word): i for i, r in enumerate(top)}
    first = set(list(words)[:own])

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members = np.zeros(SHARED_CLASSES), np.zeros(SHARED_CLASSES, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in first:
                    kind = shared_class(word)
                    sums[kind] += n + 0.5
                    members[kind] += 1
        at = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["kind", "mass"])

    masses = np.full(own + SHARED_CLASSES, 0.5)
    for i, r in enumerate(top[:own]):
        masses[i] = r.n + 0.5
    for r in counts.mapInArrow(mass, "kind long, mass double").groupBy("kind").agg(F.sum("mass").alias("mass")).collect():
        masses[own + r.kind] += r["mass"]
    # Classes of their own that no word has are left out of all sums.
    masses[len(top[:own]) : own] = 0
    return Vocabulary(words, np.array([r.n for r in top], np.int64), int(totals[0]), int(totals[1]), masses, own)


def encode(docs: DataFrame, held_out: Column, words: Vocabulary, id_column: str, text_column: str) -> DataFrame:
    """A row for each text: row, id, held_out, n_tokens, classes (16-bit), and of its tokens: ``listed_log`` (sum of
    log10 of count + 0.5 of the listed), ``mass_log`` (sum of log10 of the class masses), ``listed`` (their number),
    ``others`` (the words that are not listed, joined by blanks)."""
    key = docs.schema[id_column].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36

        class Numbers(dict):  # noqa: FURB189
            def __missing__(self, word: bytes) -> int:
                return -1 - shared_class(word)

        find = Numbers(words.listed).__getitem__
        count_logs = np.log10(words.counts + 0.5)
        mass_logs = np.log10(np.maximum(words.masses, 0.5))
        for batch in slices(batches, "text"):
            out = []
            for text in texts_of(batch, "text"):
                tokens = tokens_of(text)
                numbers = np.fromiter(map(find, tokens), np.int64, len(tokens))
                classes = words.classes(numbers)
                known = numbers >= 0
                others = b" ".join([tokens[i] for i in np.flatnonzero(~known)])
                out.append((len(tokens), classes.astype("<u2").tobytes(), float(count_logs[numbers[known]].sum()), float(mass_logs[classes].sum()), int(known.sum()), others))
            n_tokens, classes, listed_log, mass_log, listed, others = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + len(out))), batch.column(0), batch.column(2),
                    pa.array(n_tokens, pa.int64()), pa.array(classes, pa.binary()), pa.array(listed_log, pa.float64()),
                    pa.array(mass_log, pa.float64()), pa.array(listed, pa.int64()), pa.array(others, pa.binary()),
                ],
                ["row", "id", "held_out", "n_tokens", "classes", "listed_log", "mass_log", "listed", "others"],
            )
            number += len(out)

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), held_out.alias("held_out"))
    schema = f"row long, id {key}, held_out boolean, n_tokens long, classes binary, listed_log double, mass_log double, listed long, others binary"
    return texts.mapInArrow(rows, schema)


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # by class and state

    @classmethod
    def initial(cls, words: Vocabulary, states: int = STATES, seed: int = 7) -> Model:
        """Class frequencies, bent at random so that states can part, and states that tend to last."""
        rng = np.random.default_rng(seed)
        emits = (words.masses / words.masses.sum())[:, None] * rng.uniform(0.4, 1.6, (len(words.masses), states))
        moves = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(moves, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), moves, emits / emits.sum(axis=0))


def _side_by_side(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of classes as columns, longest first: (steps x sequences), how many reach each step, their order."""
    lengths = np.array([len(x) for x in sequences])
    order = np.argsort(-lengths, kind="stable")
    steps = np.zeros((int(lengths.max()), len(sequences)), np.int64)
    for column, i in enumerate(order):
        steps[: lengths[i], column] = sequences[i]
    active = np.searchsorted(-lengths[order], -np.arange(len(steps)), side="left")
    return steps, active, order


def expected_counts(sequences: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions (class x state), and the log likelihood, of whole texts.

    Texts stand side by side and are gone through in pieces of ``PIECE`` steps. Forward values are kept, of more than
    ``HELD_TOKENS`` tokens those at the borders only: the way back then makes those inside a piece anew. Backward values
    are carried over the borders.
    """
    order = np.argsort([-len(x) for x in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    tokens = np.concatenate([sequences[i] for i in order])
    first = np.cumsum(lengths) - lengths
    states = len(model.start)
    hold = len(tokens) <= HELD_TOKENS

    table = np.ascontiguousarray(model.emits.T)
    onward = np.ascontiguousarray(model.moves.T)

    # Values of a piece are laid out by step, state and text.
    def cells(begin: int) -> tuple[np.ndarray, ...]:
        times = np.arange(begin, min(begin + PIECE, lengths[0]))
        active = np.searchsorted(-lengths, -times, side="left")
        steps = tokens[np.minimum(first[: active[0]] + times[:, None], len(tokens) - 1)]
        emitted = np.empty((len(steps), states, steps.shape[1]))
        for state in range(states):
            emitted[:, state] = table[state][steps]
        return steps, active, emitted

    def forward(active: np.ndarray, emitted: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = np.zeros(emitted.shape), np.ones((len(emitted), emitted.shape[2]))
        for t, n in enumerate(active.tolist()):
            a = alpha[t, :, :n]
            if before is None:
                np.multiply(model.start[:, None], emitted[t, :, :n], out=a)
            else:
                np.multiply(onward @ before[:, :n], emitted[t, :, :n], out=a)
            np.sum(a, axis=0, out=scale[t, :n])
            a /= scale[t, :n]
            before = a
        return alpha, scale

    borders: list[np.ndarray | None] = [None]
    begins = range(0, int(lengths[0]), PIECE)
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    log = 0.0
    for begin in begins:
        _, active, emitted = cells(begin)
        pieces.append(forward(active, emitted, borders[-1]))
        alpha, scale = pieces[-1]
        log += float(np.log(scale).sum())
        borders.append(alpha[-1, :, : active[-1]].copy())
        if not hold:
            pieces.clear()
    moves, emits = np.zeros_like(model.moves), np.zeros((len(model.emits), states))
    beta = np.ones((states, len(lengths)))
    for number, begin in reversed(list(enumerate(begins))):
        before = borders[number]
        steps, active, emitted = cells(begin)
        alpha, scale = pieces.pop() if hold else forward(active, emitted, before)
        emitted /= scale[:, None]
        posterior = alpha  # turned into posteriors from the end on
        for t in range(len(steps) - 1, -1, -1):
            n = int(active[t])
            last = alpha[t - 1, :, :n] if t else None if before is None else before[:, :n]
            ahead = emitted[t, :, :n]
            ahead *= beta[:, :n]
            posterior[t, :, :n] *= beta[:, :n]
            if last is not None:
                moves += last @ ahead.T
                np.matmul(model.moves, ahead, out=beta[:, :n])
        # Cells behind the end of a text hold no posterior.
        classes = steps.ravel()
        for state in range(states):
            emits[:, state] += np.bincount(classes, posterior[:, state].ravel(), len(emits))
    return posterior[0].sum(axis=1), moves * model.moves, emits, log


def log10_likelihood(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Exact log10 likelihood of each sequence by the scaled forward recursion."""
    steps, active, order = _side_by_side(sequences)
    table, onward = np.ascontiguousarray(model.emits.T), np.ascontiguousarray(model.moves.T)
    logs = np.zeros(len(sequences))
    alpha = np.zeros((len(model.start), len(sequences)))
    for t, n in enumerate(active.tolist()):
        a = np.take(table, steps[t, :n], axis=1)
        a *= model.start[:, None] if t == 0 else onward @ alpha[:, :n]
        scale = a.sum(axis=0)
        logs[:n] += np.log10(scale)
        a /= scale
        alpha = a
    out = np.empty(len(sequences))
    out[order] = logs
    return out


def _read(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    values = batch.column(batch.schema.get_field_index(column)).to_pylist()
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in values]


def train(encoded: DataFrame, words: Vocabulary, states: int = STATES, iterations: int = ITERATIONS, prior: float = PRIOR) -> Model:
    """Baum-Welch over all rows of ``encoded``; each iteration is one job that sums counts by class."""
    model = Model.initial(words, states)
    n_classes = len(words.masses)
    common = words.masses / words.masses.sum()
    sums = [f"s{i}" for i in range(states)]

    def job(model: Model) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Rows of the classes, then of the states that are left, then of the starts.
            total = np.zeros((n_classes + states + 1, states))
            texts: list[np.ndarray] = []
            size = 0

            def add() -> None:
                nonlocal size
                start, moves, emits, _ = expected_counts(texts, model)
                total[:n_classes] += emits
                total[n_classes:-1] += moves
                total[-1] += start
                texts.clear()
                size = 0

            for batch in slices(batches, "classes"):
                for text in _read(batch, "classes"):
                    texts.append(text)
                    size += len(text)
                    if len(texts) >= HELD_TEXTS or size >= HELD_TOKENS:
                        add()
            if texts:
                add()
            at = np.flatnonzero(total.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, i]) for i in range(states))], ["place", *sums])

        rows = encoded.select("classes").mapInArrow(count, "place long, " + ", ".join(f"{s} double" for s in sums))
        return rows.groupBy("place").agg(*(F.sum(s).alias(s) for s in sums))

    for _ in range(iterations):
        total = np.zeros((n_classes + states + 1, states))
        found = job(model).toArrow()
        at = found.column("place").to_numpy()
        for i, s in enumerate(sums):
            total[at, i] = found.column(s).to_numpy()
        emits = total[:n_classes] + prior * common[:, None]
        moves = total[n_classes:-1] + 1.0
        start = total[-1] + 1.0
        model = Model(start / start.sum(), moves / moves.sum(axis=1)[:, None], emits / emits.sum(axis=0))
    return model


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", **options: int) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows for which ``held_out``
    is false are learned from."""
    texts = docs.where(~held_out).select(F.col(text_column).alias("text"))
    counts = stored(count_words(texts), "word_counts")
    words = vocabulary(counts)
    # In order of length, so that texts that stand side by side end together.
    encoded = stored(encode(docs, held_out, words, id_column, text_column).sortWithinPartitions("n_tokens"), "encoded")
    model = train(encoded.where("NOT held_out"), words, **options)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "classes"):
            kept = [batch.column(batch.schema.get_field_index(c)) for c in plain]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(log10_likelihood(_read(batch, "classes"), model))], [*plain, "class_log"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "others"):
            rows, found, times = [], [], []
            for row, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(joined.split(b" "))
                rows += [row] * len(own)
                found += own.keys()
                times += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.int32())], ["row", "word", "times"])

    kinds = {"row": "long", "id": docs.schema[id_column].dataType.simpleString(), "held_out": "boolean", "n_tokens": "long", "listed_log": "double", "mass_log": "double", "listed": "long"}
    plain = list(kinds)
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", class_log double"
    scored = encoded.select(*plain, "classes").mapInArrow(likelihood, schema)
    rare = encoded.where("length(others) > 0").select("row", "others").mapInArrow(others, "row long, word binary, times int")
    counted = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("other_log"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("other_known"),
    )
    joined = scored.join(counted, "row", "left")
    word_log = F.col("listed_log") + F.coalesce("other_log", F.lit(0.0))
    total = float(np.log10(words.tokens + 0.5 * (words.distinct + 1)))
    return joined.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("listed") + F.coalesce("other_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (word_log - F.col("n_tokens") * total).alias("base_score"),
        (F.col("class_log") + word_log - F.col("mass_log") if words.tokens else word_log - F.col("n_tokens") * total).alias("score"),
    )
