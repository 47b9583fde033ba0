"""Benchmark decontamination: documents that contain word windows of benchmark texts are found, cut or removed.

Texts are folded to lower case (A-Z) and split into words of ASCII letters, digits and all other non-ASCII
characters. A window is ``size`` consecutive words of a benchmark text; a shorter text is one window. The windows
are a hash set that every task holds: each task maps words to their numbers in the benchmark, hashes the runs made of
such words only and verifies every hash that is found word by word. Documents are neither shuffled nor cut.

The set is held in blocks of at most ``block_windows`` windows, which is what bounds the broadcast: a larger
benchmark is searched block by block, each in a scan of its own, and the findings of a document are united.

Defined cases: null and empty texts have no words, in documents and benchmark; rows with equal ids or texts are
each answered; a benchmark row without id marks documents but adds no id; an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerleaf.llm.common import extended, fresh, slices, stored, texts_of

WINDOW_WORDS = 10
BLOCK_WINDOWS = 500_000
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowIndex:
    """Hash set of windows by their length, with the items each occurs in."""

    def __init__(self, rows: list[Row]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for row in rows:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in bytes(row.window).split())
            by_length.setdefault(len(ids), {}).setdefault(ids, set()).update(row.items)
        self.lengths = {}
        for length, windows in by_length.items():
            grams = np.array(list(windows), np.int64).reshape(-1, length)
            seed = 0
            while True:  # until no two windows of the set share a hash
                factors = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
                hashes = (grams.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            order = np.argsort(hashes)
            items = list(windows.values())
            self.lengths[length] = (factors, hashes[order], grams[order], [items[i] for i in order])

    def find(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Of each word whether it is hit, the index of each text's first word, the items by text."""
        number = self.vocabulary.get
        flat: list[int] = []
        first = [0]
        for words in lists:
            flat += [number(w, 0) for w in words]
            flat.append(0)  # no window crosses texts
            first.append(len(flat))
        ids, bounds = np.array(flat, np.int64), np.array(first)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        marks = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for length, (factors, hashes, grams, owners) in self.lengths.items():
            if length >= len(ids):
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            windows = ids[starts[:, None] + np.arange(length)]
            found = (windows.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            same = np.flatnonzero(hashes[at] == found)
            same = same[(grams[at[same]] == windows[same]).all(axis=1)]
            np.add.at(marks, starts[same], 1)
            np.add.at(marks, starts[same] + length, -1)
            texts = np.searchsorted(bounds, starts[same], side="right") - 1
            for text, window in set(zip(texts.tolist(), at[same].tolist(), strict=True)):
                items.setdefault(text, set()).update(owners[window])
        return np.cumsum(marks)[: len(ids)] > 0, bounds, items


def benchmark_windows(benchmark: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """Distinct windows as words joined by blanks, each with the ids (as text) of the items it occurs in."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, out = [], []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    keys.append(key)
                    out.append(b" ".join(words[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(keys, pa.string())], ["window", "item"])

    texts = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    rows = texts.mapInArrow(windows, "window binary, item string")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _scan(docs: DataFrame, text_column: str, index: WindowIndex, names: list[str]) -> DataFrame:
    # The index travels with the function; Spark sends functions of this size as broadcasts.
    schema = extended(docs.schema, names, "binary; bigint; array<int>; array<int>; array<string>")
    plain = [f.name for f in docs.schema]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            texts = texts_of(batch, text_column)
            lists = [words_of(x) for x in texts]
            hit, bounds, items = index.find(lists)
            starts, ends = [], []
            changes = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
            run_text = np.searchsorted(bounds, changes[::2], side="right") - 1
            runs: dict[int, list[tuple[int, int]]] = {}
            for text, a, b in zip(run_text.tolist(), changes[::2].tolist(), changes[1::2].tolist(), strict=True):
                runs.setdefault(text, []).append((a - int(bounds[text]), b - int(bounds[text])))
            for i in range(len(lists)):
                own = runs.get(i, [])
                starts.append([a for a, _ in own])
                ends.append([b for _, b in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in plain]
                + [
                    pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary()),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array([sorted(items.get(i, ())) for i in range(len(lists))], pa.list_(pa.string())),
                ],
                plain + names,
            )

    return docs.mapInArrow(scan, schema)


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW_WORDS,
    block_windows: int = BLOCK_WINDOWS,
) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` with their findings, and the names of the columns that hold them: ``words``
    (their number), ``starts`` and ``ends`` (of hit runs, in words; runs of several blocks may overlap), ``items``."""
    roles = ["digest", "words", "starts", "ends", "items"]
    taken = list(docs.columns)
    names = []
    for role in roles:
        names.append(fresh(taken, f"hit_{role}"))
        taken.append(names[-1])
    at = dict(zip(roles, names, strict=True))
    windows = stored(benchmark_windows(benchmark, item_column, item_text, size), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))

    def scan(number: int) -> DataFrame:
        return _scan(docs, text_column, WindowIndex(windows.where(block == number).collect()), names)

    if blocks == 1:
        return scan(0), at
    # One index at a time is on the driver: what it finds is stored before the next one is made.
    hits = [stored(scan(b).where(F.size(at["starts"]) > 0).select(id_column, *names), "hits") for b in range(blocks)]
    found = reduce(DataFrame.union, hits)
    whole = _scan(docs, text_column, WindowIndex([]), names)
    # Equal rows have equal findings, so uniting by id and digest of the text needs no key of the row.
    found = found.groupBy(F.col(id_column).alias("key"), F.col(at["digest"]).alias("digest")).agg(
        *(F.flatten(F.collect_set(at[c])).alias(c) if c == "items" else F.flatten(F.collect_list(at[c])).alias(c) for c in ("starts", "ends", "items"))
    )
    every = whole.drop(at["starts"], at["ends"], at["items"])
    joined = every.join(found, every[id_column].eqNullSafe(found["key"]) & (every[at["digest"]] == found["digest"]), "left")
    empty = {"starts": "array<int>", "ends": "array<int>", "items": "array<string>"}
    return joined.select(
        *(every[c] for c in every.columns),
        *(
            F.coalesce(F.array_distinct(found[c]) if c == "items" else found[c], F.array().cast(kind)).alias(at[c])
            for c, kind in empty.items()
        ),
    ), at


def hit_words(at: dict[str, str]) -> F.Column:
    """Number of distinct words inside the runs: runs in order, each counted from where the ones before it ended."""
    runs = F.array_sort(F.arrays_zip(F.col(at["starts"]).alias("a"), F.col(at["ends"]).alias("b")))
    zero = F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end"))
    return F.aggregate(
        runs,
        zero,
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).cast("int").alias("n"),
            F.greatest(s["end"], r["b"]).alias("end"),
        ),
        lambda s: s["n"].cast("long"),
    )


def report(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, joined by commas), contaminated."""
    found, at = find_hits(docs, benchmark, **options)
    n_hit = hit_words(at)
    return found.select(
        F.col(str(options.get("id_column", "doc_id"))).alias("doc_id"),
        F.col(at["words"]).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(at["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(at["items"]), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents without any hit, with their own columns."""
    found, at = find_hits(docs, benchmark, **options)
    return found.where(F.size(at["starts"]) == 0).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options: object) -> DataFrame:
    """All documents, their texts without the hit words and what stands between them."""
    found, at = find_hits(docs, benchmark, text_column=text_column, **options)
    columns, starts, ends = docs.columns, at["starts"], at["ends"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            place = batch.schema.get_field_index(text_column)
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            runs = zip(batch.column(batch.schema.get_field_index(starts)).to_pylist(), batch.column(batch.schema.get_field_index(ends)).to_pylist(), strict=True)
            for i, (a, b) in enumerate(runs):
                if a:
                    spans = [m.span() for m in _WORD.finditer(texts[i])]
                    kept, end = [], 0
                    for first, last in sorted(zip(a, b, strict=True)):
                        kept.append(texts[i][end : max(end, spans[first][0])])
                        end = max(end, spans[last - 1][1])
                    texts[i] = b"".join([*kept, texts[i][end:]])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            arrays[columns.index(text_column)] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return found.select(*columns, starts, ends).mapInArrow(cut, docs.schema)
