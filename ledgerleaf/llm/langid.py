"""Language identification with spans: scripts narrow the candidates, then Viterbi over scores of words.

Training counts hashed character trigrams (inside words and at their edges) and the scripts of letters for each
language, summed over all training texts by Spark; the model is one row of fixed length for each language. A word's
score in a language is the sum of its trigrams' log probabilities; a language whose training letters hardly ever
have the word's script is no candidate for it. Viterbi with a penalty for each switch labels the words, so
that mixed texts come out as spans. All steps are array code over batches of whole texts; nothing is shuffled but counts.

Defined cases: texts that are null or have no letter get ``und``, score 0 and no spans; without any training text
every text does. Words without letters follow their neighbours. Ties go to the language that is first by name. Texts
of any length are labelled whole. The score is the share of letters in words of the predicted language whose script
some training language has: texts in scripts that no training text has get a label, as all texts with letters do, and a
score near 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import extended, fresh, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.1
SWITCH_PENALTY = 12.0
# A script is a candidate's if at least this share of its training letters has it.
SCRIPT_SHARE = 0.005

#: First code points of the ranges that hold a script's letters, and the script from there on.
SCRIPT_RANGES = (
    (0x0000, "common"), (0x0041, "latin"), (0x005B, "common"), (0x0061, "latin"), (0x007B, "common"), (0x00AA, "latin"),
    (0x00AB, "common"), (0x00C0, "latin"), (0x00D7, "common"), (0x00D8, "latin"), (0x00F7, "common"), (0x00F8, "latin"),
    (0x02B9, "common"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3000, "common"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_RANGES))
_LETTER = regex.compile(r"\p{L}")


def _script_table() -> np.ndarray:
    starts = np.array([first for first, _ in SCRIPT_RANGES])
    kinds = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES], np.uint8)
    return kinds[np.searchsorted(starts, np.arange(0x10000), side="right") - 1]


class Batch:
    """Words of texts as code points, with the hashed trigrams of each word (one for each of its characters)."""

    def __init__(self, texts: list[str], scripts: np.ndarray) -> None:
        lists = [text.lower().split() for text in texts]
        joined = " " + " ".join(" ".join(words) for words in lists if words) + " "
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.first = np.concatenate(([0], np.cumsum(counts)))
        if not self.first[-1]:
            self.starts = self.ends = np.zeros(0, np.int64)
            return
        blanks = np.flatnonzero(points == 32)
        self.starts, self.ends = blanks[:-1] + 1, blanks[1:]
        a, b, c = points[:-2], points[1:-1], points[2:]
        hashed = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) ^ (b * np.uint32(0x27D4EB2F) >> np.uint32(7))
        grams = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        self.kinds = scripts[np.minimum(points, 0xFFFF)]
        # Trigram i has its middle at i + 1; those in the middle of which a blank stands belong to no word.
        self.grams = np.concatenate((grams, [0]))[self._inner(points)]
        sizes = self.ends - self.starts
        self.at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        letters = (self.kinds[points != 32] > 0).astype(np.int64)
        self.letters = np.add.reduceat(letters, self.at)
        self.script = np.maximum.reduceat(self.kinds[points != 32], self.at)
        self.letter_kinds = self.kinds[points != 32]

    @staticmethod
    def _inner(points: np.ndarray) -> np.ndarray:
        return np.flatnonzero(points != 32) - 1


@dataclass
class Model:
    """``languages`` in order, log probabilities by bucket and language, which scripts each may have."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def train(texts: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Fit on all rows with a language. The driver gets one row for each language and bucket that occurs in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scripts = _script_table()
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            langs = batch.column(0).to_pylist()
            values = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = Batch([x for x, other in zip(values, langs, strict=True) if other == lang], scripts)
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                if len(own.starts):
                    word_scripts = np.repeat(own.script, own.ends - own.starts)
                    total[:BUCKETS] += np.bincount(own.grams[word_scripts > 0], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(own.letter_kinds, minlength=len(SCRIPTS))
        for lang, total in sums.items():
            bucket = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(total[bucket])],
                ["lang", "bucket", "n"],
            )

    rows = texts.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow().to_pandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    counts[found["bucket"], found["lang"].map({x: i for i, x in enumerate(languages)})] = found["n"]
    grams, letters = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    letters[0] = 0
    allowed = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return Model(languages, scores.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``scores``; sequences lie one after another from ``first`` on, and are stepped
    through side by side, the longest ones first."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin = first[:-1][order]
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left") if longest else []
    labels = np.zeros(len(scores), np.uint8 if scores.shape[1] < 256 else np.int32)
    moved = np.zeros(scores.shape, bool)  # whether the best way into a label is a switch from the best one before
    best_before = np.zeros(len(scores), labels.dtype)
    value = np.zeros((len(begin), scores.shape[1]), np.float32)
    for t in range(longest):
        n = active[t]
        rows = begin[:n] + t
        value = value[:n]
        if t:
            best = value.argmax(axis=1)
            switch = value[np.arange(n), best][:, None] - np.float32(penalty)
            best_before[rows] = best
            turn = switch > value
            moved[rows] = turn
            value = np.where(turn, switch, value)
            # Only differences count; this keeps them exact in long texts.
            value -= value.max(axis=1)[:, None]
        value = value + scores[rows]
        ended = np.flatnonzero(lengths[order[:n]] == t + 1)
        labels[rows[ended]] = value[ended].argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        rows = begin[: active[t]] + t
        now = labels[rows]
        labels[rows - 1] = np.where(moved[rows, now], best_before[rows], now)
    return labels


def _labels(batch: Batch, model: Model) -> np.ndarray:
    if not len(batch.starts):
        return np.zeros(0, np.uint8)
    sums = np.zeros((len(batch.starts), len(model.languages)), np.float32)
    step = 1 << 17  # words at once
    for a in range(0, len(sums), step):
        ends = batch.at[a + step] if a + step < len(sums) else len(batch.grams)
        part = model.scores[batch.grams[batch.at[a] : ends]]
        sums[a : a + step] = np.add.reduceat(part, batch.at[a : a + step] - batch.at[a], axis=0)
    candidate = model.scripts[batch.script]
    candidate |= ~candidate.any(axis=1)[:, None]
    sums -= np.where(candidate, sums, -np.inf).max(axis=1)[:, None]
    sums[~candidate] = -1e4
    sums[batch.script == 0] = 0
    return viterbi(sums, batch.first, SWITCH_PENALTY)


def identify(
    docs: DataFrame, model: Model, text_column: str = "text", with_spans: bool = True, with_known: bool = False
) -> tuple[DataFrame, list[str]]:
    """All rows and columns of ``docs``, and the names of the added ones: prediction, score and, if asked for, the share of
    letters in scripts that some training language has, and spans (language, first word, word after the last)."""
    names = []
    for name in ("lang_pred", "lang_score", *["lang_known"] * with_known, *["lang_spans"] * with_spans):
        names.append(fresh([*docs.columns, *names], name))
    plain = docs.columns
    span = "array<struct<lang: string, first: int, stop: int>>"
    kinds = "string; double" + "; double" * with_known + f"; {span}" * with_spans
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("stop", pa.int32())]))
    languages = np.array([*model.languages, UNKNOWN])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scripts = _script_table()
        for rows in slices(batches, text_column):
            texts = [x or "" for x in rows.column(rows.schema.get_field_index(text_column)).to_pylist()]
            lettered = np.array([bool(_LETTER.search(x)) for x in texts]) & bool(model.languages)
            batch = Batch([x if ok else "" for x, ok in zip(texts, lettered, strict=True)], scripts)
            labels = _labels(batch, model)
            n = max(1, len(model.languages))
            doc = np.repeat(np.arange(len(texts)), np.diff(batch.first))
            votes = np.zeros((len(texts), n))
            if len(labels):
                # Letters outside the known ranges still count a little, so that any lettered text has a label.
                np.add.at(votes, (doc, labels), batch.letters + 1e-9)
            best = votes.argmax(axis=1)
            share = np.where(lettered, votes.max(axis=1) / np.maximum(votes.sum(axis=1), 1e-12), 0.0)
            known = np.zeros(len(texts))
            if len(labels):
                np.add.at(known, doc, np.where(model.scripts.any(axis=1)[batch.script], batch.letters, 0))
            known = np.where(lettered, known / np.maximum(votes.sum(axis=1), 1e-12), 0.0).clip(0, 1)
            predicted = languages[np.where(lettered, best, len(model.languages))]
            made = [pa.array(predicted, pa.string()), pa.array((share * known).clip(0, 1)), *[pa.array(known)] * with_known]
            if with_spans:
                cuts = np.flatnonzero((np.diff(labels.astype(np.int64), prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                ends = np.append(cuts, len(labels))[1:]
                own: list[list[dict[str, object]]] = [[] for _ in texts]
                for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                    base = int(batch.first[doc[a]])
                    own[doc[a]].append({"lang": model.languages[labels[a]], "first": a - base, "stop": b - base})
                made.append(pa.array(own, span_type))
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(c)) for c in plain] + made, plain + names
            )

    return docs.mapInArrow(label, extended(docs.schema, names, kinds)), names
