"""Removal of repeated byte strings by bucket-pointer refinement over a sample of suffixes.

Every byte covered by a string of ``length`` bytes that starts elsewhere too is removed. Of each window of that length
one suffix stands for it: the one with the least hash of its first ``Q`` bytes, which equal windows choose at the
same place (winnowing). So one suffix in about 140 bytes is kept, with the run of windows it stands for, and no
repeated window is missed. The suffixes are sorted into buckets, and the buckets refined:

1. The initial bucket of a suffix is its q-gram. Suffixes alone in their bucket leave, by an aggregate on identifiers.
2. A bucket is refined by the identifier of all bytes from the first to the last window of the suffix's run. Suffixes
   that share it are repeated through all their windows; they are settled, and one stands for all from now on.
3. What differs in a bucket is refined window by window, from coarse to fine: runs are cut into steps of 16 windows;
   the bytes that all windows of a step share are its identifier, and steps alone with theirs leave. In the buckets
   that remain the bytes before and behind decide: equal ones settle the step, others are refined to single windows.

Each refinement takes the buckets left by the one before, and is a shuffle of identifiers and counts with sums
made before it, so a passage in a third of all documents is a few rows for each task. Texts are read where they lie:
what is wanted of them is joined to their scan, as a broadcast if counted to be small enough, else as a shuffle.

The same refinement runs over words (byte strings between blanks) in place of bytes if strings are measured in words:
a word is its 64-bit hash, positions count words, and words are equal whatever blanks stand between them.

Defined cases: null is the empty text; matches do not cross documents; the same document and overlaps count; rows with
equal ids or texts are documents of their own (and so repeat each other); shorter texts lose nothing. A character of
which some bytes are removed is dropped from the cut text as a whole; digests are taken of the exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import RangeHash, fresh, mixed, sized, slices, stored, texts_of

LENGTH = 400
Q = 128
STEP = 16
# Windows handled at once; longer texts are taken piece by piece. Arrays of some 150 bytes for each window are held.
PIECE = 500_000
# Documents whose spans are united at once.
UNITED = 1000
_LOW = np.uint64(0xFFFFFFFF)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in the bytes of a text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    return edges[::2], edges[1::2]


def _symbols(texts: list[bytes], words: bool, hashes: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, or hashes of all their words, one text after another, and where each text ends."""
    if not words:
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_bounds(data)
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        hashes.load(data[starts[at] : ends[stop - 1]])
        out[at:stop] = hashes.of(starts[at:stop] - starts[at], ends[at:stop] - starts[at])
        at = stop
    return out, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``: from the least ones before and behind block borders."""
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def choose_suffixes(data: np.ndarray, ends: np.ndarray, hashes: RangeHash, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Suffixes of texts that lie one after another up to ``ends``: (position, first window, last window, q-gram
    identifier, identifier of the bytes of all these windows)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if len(data) < length:
        return none
    hashes.load(data)
    at = np.arange(len(data) - q + 1)
    grams = hashes.of(at, at + q)
    # The low half makes later positions win among equal hashes, wherever the window stands.
    least = _sliding_least((grams & ~_LOW) | (_LOW - at.astype(np.uint64)), length - q + 1)
    chosen = (_LOW - (least & _LOW)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(chosen)), side="right")
    windows = np.flatnonzero(np.arange(len(chosen)) + length <= ends[text])
    if not len(windows):
        return none
    position = chosen[windows]
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(position) != 0) | (np.diff(windows) != 1))))
    low, high = windows[begins], windows[np.append(begins[1:], len(windows)) - 1]
    at = position[begins]
    around = hashes.of(low, high + length) ^ mixed((at - low + 1).astype(np.uint64))
    return at, low, high, grams[at], around


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def suffixes(docs: DataFrame, id_column: str, text_column: str, length: int, q: int, words: bool = False) -> DataFrame:
    """A row (doc, id, text_key) for each document and a row (doc, gram, around, at, low, high) for each suffix."""
    key = docs.schema[id_column].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        hashes = RangeHash()
        names = ["doc", "id", "text_key", "gram", "around", "at", "low", "high"]

        def made(doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, gram: np.ndarray, around: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
            n = len(doc)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array(gram.view(np.int64)), pa.array(around.view(np.int64))]
                + [pa.array(x.astype(np.int32)) for x in (at, low, high)],
                names,
            )

        for batch in slices(batches, "text", PIECE):
            texts = texts_of(batch, "text")
            n = len(texts)
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + n)), batch.column(0), batch.column(2)] + [pa.nulls(n, pa.int64())] * 2 + [pa.nulls(n, pa.int32())] * 3,
                names,
            )
            whole, ends = _symbols(texts, words, hashes)
            if n == 1:
                for a in range(0, max(1, len(whole) - length + 1), PIECE):
                    data = whole[a : a + PIECE + length - 1]
                    at, low, high, gram, around = choose_suffixes(data, np.array([len(data)]), hashes, length, q)
                    yield made(np.full(len(at), number), at + a, low + a, high + a, gram, around, kind)
            else:
                at, low, high, gram, around = choose_suffixes(whole, ends, hashes, length, q)
                own = np.searchsorted(ends, low, side="right")
                base = np.concatenate(([0], ends[:-1]))[own]
                yield made(number + own, at - base, low - base, high - base, gram, around, kind)
            number += n

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), _key(F.col(text_column)).alias("text_key"))
    return texts.mapInArrow(rows, f"doc long, id {key}, text_key long, gram long, around long, at int, low int, high int")


def _steps(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, length: int, words: bool) -> DataFrame:
    """Steps of the wanted suffixes: (gram, step, core, outer, doc, origin, first, last, before, behind).

    Window i of a step (first <= i <= last) starts i bytes before ``origin``. ``core`` identifies what all windows of
    a whole step share, ``before`` and ``behind`` are the bytes that single windows hold besides, ``outer`` identifies both.
    """
    texts = docs.select(F.col(id_column).alias("text_id"), F.col(text_column).alias("text"))
    meets = F.col("text_id").eqNullSafe(F.col("id")) & (_key(F.col("text")) == F.col("text_key"))
    rows = texts.join(sized(wanted, "suffixes"), meets).select("doc", "suffixes", "text").dropDuplicates(["doc"])
    inner = length - STEP + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RangeHash()
        for batch in slices(batches, "text", PIECE):
            for doc, found, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, "text"), strict=True):
                gram, at, low, high = (np.array([x[k] for x in found], np.int64) for k in ("gram", "at", "low", "high"))
                # Step k of a suffix: windows that start 16 k to 16 k + 15 bytes before it.
                least, most = (at - high) // STEP, (at - low) // STEP
                which = np.repeat(np.arange(len(at)), most - least + 1)
                step = np.arange(len(which)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1) + least[which]
                origin = at[which] - STEP * step
                first = np.maximum(0, origin - high[which])
                last = np.minimum(STEP - 1, origin - low[which])
                data, _ = _symbols([text], words, hashes)
                core = np.zeros(len(origin), np.uint64)
                outer = np.zeros(len(origin), np.uint64)
                order = np.argsort(origin, kind="stable")
                for a in range(0, len(order), 4096):
                    part = order[a : a + 4096]
                    base = int((origin[part] - last[part]).min())
                    stop = int((origin[part] - first[part]).max()) + length
                    hashes.load(data[base:stop])
                    o = origin[part] - base
                    core[part] = hashes.of(o, o + inner)
                    outer[part] = hashes.of(o - last[part], o - first[part] + length) + mixed((first[part] * STEP + last[part] + 1).astype(np.uint64))
                held, wide = (data.tobytes(), data.itemsize) if words else (text, 1)
                before = [held[wide * (o - b) : wide * o] for o, b in zip(origin.tolist(), last.tolist(), strict=True)]
                behind = [held[wide * (o + inner) : wide * (o + length - a)] for o, a in zip(origin.tolist(), first.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[which]), pa.array(step.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(outer.view(np.int64)),
                        pa.array(np.full(len(which), doc)), pa.array(origin.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                        pa.array(before, pa.binary()), pa.array(behind, pa.binary()),
                    ],
                    ["gram", "step", "core", "outer", "doc", "origin", "first", "last", "before", "behind"],
                )

    return rows.mapInArrow(
        cut, "gram long, step int, core long, outer long, doc long, origin int, first int, last int, before binary, behind binary"
    )


def repeated_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, q: int = Q, words: bool = False
) -> DataFrame:
    """A row (id, text_key, spans) for each document with removed bytes; spans are maximal byte ranges, in order. With
    ``words``, ``length``, ``q`` and the ranges count words."""
    if not STEP <= length >= q:
        raise ValueError(f"strings of {length} are shorter than a step of {STEP} windows or a q-gram of {q}")
    rows = stored(suffixes(docs, id_column, text_column, length, q, words), "suffixes")
    own = rows.where("gram IS NOT NULL").drop("id", "text_key")

    # Initial buckets: q-grams that occur once leave.
    grams = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("a"), F.max("around").alias("b"))
    grams = grams.where("n > 1").select("gram", (F.col("a") == F.col("b")).alias("settled"))
    left = stored(own.join(sized(stored(grams, "grams")), "gram"), "buckets")
    windows = [left.where("settled").select("doc", F.col("low").alias("start"), (F.col("high") + length).alias("stop"))]

    # Refined by all bytes of the run of windows.
    open_ = left.where("NOT settled")
    runs = open_.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at", "low", "high")).alias("one"))
    runs = stored(runs, "runs")
    again = open_.join(runs.where("n > 1").select("gram", "around"), ["gram", "around"])
    windows.append(again.select("doc", F.col("low").alias("start"), (F.col("high") + length).alias("stop")))

    # One suffix of each run goes on, in steps of windows.
    named = rows.where("gram IS NULL").select("doc", "id", "text_key")
    wanted = runs.select("gram", "one.*").groupBy("doc").agg(F.collect_list(F.struct("gram", "at", "low", "high")).alias("suffixes"))
    wanted = stored(wanted.join(named, "doc"), "wanted")
    steps = stored(_steps(docs, wanted, id_column, text_column, length, words), "steps")
    place = ["gram", "step", "core"]
    cores = steps.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min("outer").alias("a"), F.max("outer").alias("b"))
    cores = cores.where("n > 1").select(*place, (F.col("a") == F.col("b")).alias("settled"))
    left = stored(steps.join(sized(stored(cores, "cores")), place), "buckets")
    whole = ["doc", (F.col("origin") - F.col("last")).alias("start"), (F.col("origin") - F.col("first") + length).alias("stop")]
    windows.append(left.where("settled").select(*whole))

    # Refined by the bytes before and behind; one step of each kind goes on, window by window.
    open_ = left.where("NOT settled")
    kinds = open_.groupBy(*place, "outer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "origin")).alias("one"))
    kinds = stored(kinds, "kinds")
    again = open_.join(kinds.where("n > 1").select(*place, "outer"), [*place, "outer"])
    windows.append(again.select(*whole))
    ones = kinds.select(*place, "outer", "one.*")
    single = open_.join(ones, [*place, "outer", "doc", "origin"]).dropDuplicates([*place, "outer", "doc", "origin"])
    single = single.withColumn("i", F.explode(F.sequence("first", "last")))
    wide = 8 if words else 1
    rest = F.xxhash64(
        F.expr(f"substring(before, length(before) - {wide} * i + 1, {wide} * i)"),
        F.expr(f"substring(behind, 1, {wide} * ({STEP - 1} - i))"),
    )
    single = single.select(*place, "i", rest.alias("rest"), "doc", (F.col("origin") - F.col("i")).alias("start"))
    single = stored(single, "windows")
    shared = single.groupBy(*place, "i", "rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = single.join(shared, [*place, "i", "rest"])
    windows.append(found.select("doc", "start", (F.col("start") + length).alias("stop")))

    every = windows[0]
    for more in windows[1:]:
        every = every.union(more)
    spans = every.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # Equal rows repeat each other whole, so uniting their spans changes nothing.
    return _united(spans.join(named, "doc").groupBy("id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document (id, text_key, spans), in any order and overlapping, as maximal runs in order."""
    kind = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    for whole in batches:
        for a in range(0, whole.num_rows, UNITED):
            batch = whole.slice(a, UNITED)
            spans = batch.column(2)
            sizes = spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            # Each document's offsets lie behind those of the one before, so one pass unites all.
            base = np.repeat(np.arange(len(sizes), dtype=np.int64) << 32, sizes)
            start, stop = (x.to_numpy(zero_copy_only=False) + base for x in spans.flatten().flatten())
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(stop[order])
            first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1]))[: len(start)])
            last = np.append(first[1:] - 1, len(start) - 1)[: len(first)]
            row, low = start[first] >> 32, np.int64(0xFFFFFFFF)
            bounds = [pa.array((x & low).astype(np.int32)) for x in (start[first], reach[last])]
            ends = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(bounds, fields=list(kind)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], out], ["id", "text_key", "spans"])


def _united(rows: DataFrame) -> DataFrame:
    """Spans of a document as maximal runs."""
    return rows.mapInArrow(united, f"id {dict(rows.dtypes)['id']}, text_key long, spans array<struct<start: int, stop: int>>")


def _with_spans(docs: DataFrame, spans: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    name = fresh(docs.columns, "repeated")
    spans = stored(spans, "spans")
    side = sized(spans.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")), "_spans")
    meets = docs[id_column].eqNullSafe(side["_id"]) & (_key(docs[text_column]) == side["_key"])
    return docs.join(side, meets, "left").select(*(docs[c] for c in docs.columns), side["_spans"].alias(name)), name


def _cut(text: bytes, spans: list[dict[str, int]] | None) -> tuple[bytes, int, int]:
    """Text without the spans, bytes removed, spans removed."""
    kept, end, removed = [], 0, 0
    for s in spans or ():
        kept.append(text[end : s["start"]])
        end = s["stop"]
        removed += end - s["start"]
    return b"".join([*kept, text[end:]]), removed, len(spans or ())


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, name = _with_spans(docs.select(id_column, text_column), repeated_spans(docs, id_column, text_column, **options), id_column, text_column)
    key = docs.schema[id_column].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            out = [_cut(x, s) for x, s in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), name)
    return rows.mapInArrow(digest, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _in_bytes(text: bytes, spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """Spans, some of them counted in words, as maximal byte ranges in order."""
    starts = ends = None
    every = []
    for s in spans:
        if s["by_word"] and starts is None:
            starts, ends = word_bounds(np.frombuffer(text, np.uint8))
        every.append((int(starts[s["start"]]), int(ends[s["stop"] - 1])) if s["by_word"] else (s["start"], s["stop"]))
    out: list[dict[str, int]] = []
    for start, stop in sorted(every):
        if out and start <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], stop)
        else:
            out.append({"start": start, "stop": stop})
    return out


def cut_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int | None = None,
    spared: DataFrame | None = None,
    **options: int,
) -> DataFrame:
    """All documents with their own columns, texts without the repeated strings. Null texts stay null.

    With ``words``, strings of that many words that start elsewhere too are removed besides. Documents of ``spared`` (with
    the same two columns) repeat others' strings, and keep their own texts.
    """
    def named(spans: DataFrame, by_word: bool) -> DataFrame:
        one = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(by_word).alias("by_word"))
        return spans.select("id", "text_key", F.transform("spans", one).alias("spans"))

    spans = named(repeated_spans(docs, id_column, text_column, **options), False)
    if words is not None:
        more = named(repeated_spans(docs, id_column, text_column, words, max(1, words // 3), words=True), True)
        spans = spans.union(more).groupBy("id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    if spared is not None:
        keys = spared.select(F.col(id_column).alias("own_id"), _key(F.col(text_column)).alias("own_key"))
        keys = sized(stored(keys.distinct(), "spared"))
        spans = spans.join(keys, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left_anti")
    rows, name = _with_spans(docs, spans, id_column, text_column)
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            texts = arrays[columns.index(text_column)].cast(pa.binary()).to_pylist()
            spans = batch.column(batch.schema.get_field_index(name)).to_pylist()
            kept = [x if not s else _cut(x, _in_bytes(x, s))[0].decode(errors="ignore") for x, s in zip(texts, spans, strict=True)]
            arrays[columns.index(text_column)] = pa.array([x.decode() if isinstance(x, bytes) else x for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return rows.mapInArrow(cut, docs.schema)
