"""Near-duplicate documents by b-bit MinHash: bands of minima give candidates, packed low bits estimate their
similarity, and full shingle sets confirm every link.

Documents with the same words are one class from the start (an aggregate), so exact copies cost nothing more.
Of a class one row is kept with its signature: the low four bits of each of 128 minima, packed, and 32 hashes of four
minima each, its bands. Classes that share a band are candidates:

1. In each band bucket the member that meets most others is the hub, and all others are compared with it: as many
   pairs as members, however large the bucket. The estimate, corrected for chance collisions of the low bits, drops
   pairs that are far from the limit; the rest is confirmed on full sets, and links are joined to components.
2. Members of a bucket that are in different components by now get signatures of 1,024 minima and are compared in
   blocks of these inside tasks; only pairs that pass this finer estimate leave them, and are confirmed in turn.

Buckets are counted and split by aggregates and joins, members of a hub are spread over salted keys, and a
task that confirms links streams over its rows and holds the hub's set only. No pair in a shared band is skipped
unless its classes are connected already. A pair at the limit shares no band in 5 of a million cases.

Defined cases: fewer words than a shingle: the whole sequence is one shingle; null, empty and blank texts have no
shingle and link with nothing; rows with equal ids are rows of their own, each with the component of its text;
components take the smallest id that is not null (a component without any has none); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import mixed, sized, slices, stored, texts_of
from ledgerleaf.llm.graph import components

SHINGLE = 5
PERCENT = 75
HASHES, BANDS, BITS = 128, 32, 4
# Minima of the signatures that tell members of a bucket apart after the first links.
FINE_HASHES = 1024
# Standard errors of the estimate that a pair at the limit may fall short before it is dropped unconfirmed.
MARGIN = 5.0
BLOCK = 1024
MEMBERS_PER_SALT = 256


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _spans(count: int, size: int) -> int:
    return count - size + 1 if count >= size else min(count, 1)


def shingle_sets(lists: list[list[bytes]], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each list of words. Words are hashed by a keyed function and mixed by
    place, so that no structure of the letters makes different shingles alike."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    first = np.concatenate(([0], np.cumsum(counts)))
    spans = np.fromiter((_spans(n, size) for n in counts.tolist()), np.int64, len(lists))
    edges = np.concatenate(([0], np.cumsum(spans)))
    flat = [w for words in lists for w in words]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in lists]
    own = np.empty(len(flat), object)
    own[:] = flat
    hashes = hash_array(own)
    starts = np.repeat(first[:-1], spans) + np.arange(edges[-1]) - np.repeat(edges[:-1], spans)
    lengths = np.minimum(size, np.repeat(counts, spans))
    values = lengths.astype(np.uint64)
    places = mixed(np.arange(1, size + 1, dtype=np.uint64))
    for k in range(size):
        part = mixed(hashes[np.minimum(starts + k, len(flat) - 1)] + places[k])
        values += np.where(lengths > k, part, np.uint64(0))
    values = mixed(values)
    return [np.unique(values[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    return {tuple(words[i : i + size]) for i in range(_spans(len(words), size))}


def _same_words(words: list[bytes]) -> bytes:
    """Digest of a sequence of words: equal only for equal sequences."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def similar_words(a: set, b: set, percent: int) -> bool:
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) == 0 or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _factors(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Least value of each hash function (first axis) over each set; no set is empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    minima = np.empty((hashes, len(sets)), np.uint64)
    product = np.empty_like(flat)
    for k, factor in enumerate(_factors(hashes)):
        np.multiply(flat, factor, out=product)
        minima[k] = np.minimum.reduceat(product, starts)
    return minima


def _packed(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima of each set, sixteen to a 64-bit word."""
    low = mixed(minima) & np.uint64((1 << BITS) - 1)
    lanes = 64 // BITS
    shifts = (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS))[:, None]
    return np.stack([np.bitwise_or.reduce(low[i : i + lanes] << shifts, axis=0) for i in range(0, len(minima), lanes)], axis=1)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (eight words for each set) and band hashes of sets that are not empty."""
    minima = _minima(sets, HASHES)
    rows = HASHES // BANDS
    by_band = minima.reshape(BANDS, rows, -1) * _factors(rows)[None, :, None]
    bands = mixed(by_band.sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])
    return _packed(minima), bands.T.copy()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures (last axis): lanes that differ are counted as bits, and the share
    of equal lanes is freed from the 1 in 2^b that agree by chance."""
    differ = a ^ b
    differ = differ | (differ >> np.uint64(2))
    differ = differ | (differ >> np.uint64(1))
    lanes = a.shape[-1] * 64 // BITS
    equal = 1 - np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=-1) / lanes
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT, hashes: int = HASHES) -> float:
    limit, chance = percent / 100, 1 / (1 << BITS)
    agree = chance + (1 - chance) * limit
    return limit - MARGIN * (agree * (1 - agree) / hashes) ** 0.5 / (1 - chance)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def describe(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A row for each document: row (a number of its own), id, n (set size), set (digest of its words), signature, bands."""
    key = docs.schema[id_column].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text"):
            lists = [words_of(x) for x in texts_of(batch, "text")]
            sets = shingle_sets(lists)
            filled = [i for i, x in enumerate(sets) if len(x)]
            packed: list[bytes | None] = [None] * len(sets)
            bands: list[bytes | None] = [None] * len(sets)
            if filled:
                low, band_hashes = signatures([sets[i] for i in filled])
                for i, a, b in zip(filled, low, band_hashes, strict=True):
                    packed[i], bands[i] = a.tobytes(), b.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + len(sets))),
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_same_words(x) for x in lists], pa.binary()),
                    pa.array(packed, pa.binary()),
                    pa.array(bands, pa.binary()),
                ],
                ["row", "id", "digest", "n", "set", "signature", "bands"],
            )
            number += len(sets)

    texts = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), _digest(F.col(text_column)).alias("digest")
    )
    return texts.mapInArrow(rows, f"row long, id {key}, digest binary, n long, set binary, signature binary, bands binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """Rows (bucket, node, members) of the buckets that hold several classes."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(nodes)], ["bucket", "node"])

    rows = classes.select("node", "bands").mapInArrow(explode, "bucket long, node long")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(sized(stored(shared, "shared")), "bucket")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate is not far below the limit."""
    narrow = classes.select("node", "signature", "n")
    one = narrow.select(F.col("node").alias("a"), F.col("signature").alias("s"), F.col("n").alias("n"))
    two = narrow.select(F.col("node").alias("b"), F.col("signature").alias("t"), F.col("n").alias("m"))
    least = least_estimate(percent)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array(estimate(s, t) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    # Sets whose sizes alone rule the similarity out need no estimate.
    size = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    return pairs.join(one, "a").join(two, "b").where(size).select("a", "b", "s", "t").mapInArrow(passed, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar as full sets. Texts of a go to the text of b, in several shares if they are many."""
    shares = stored(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_SALT).alias("shares")), "shares")
    members = pairs.join(sized(shares), "b").select("b", F.expr("pmod(xxhash64(a), shares)").alias("share"), F.lit(1).alias("kind"), F.col("a").alias("node"))
    heads = shares.select("b", F.explode(F.expr("sequence(0L, shares - 1)")).alias("share"), F.lit(0).alias("kind"), F.col("b").alias("node"))
    rows = members.unionByName(heads).join(texts, "node").repartition("b", "share").sortWithinPartitions("b", "share", "kind")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_words, whole = None, [], None
        for batch in slices(batches, "text"):
            lists = [words_of(x) for x in texts_of(batch, "text")]
            found = []
            for hub, kind, node, words, own in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), lists, shingle_sets(lists), strict=True):
                if kind == 0:
                    head, head_words, whole = own, words, None
                elif similar(own, head, percent):
                    # Hashes only spare most of the work: the words decide.
                    whole = shingles(head_words) if whole is None else whole
                    if similar_words(shingles(words), whole, percent):
                        found.append((node, hub))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("b", "kind", "node", "text").mapInArrow(confirm, "a long, b long")


def _fine(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (node, signature, n) with long signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets([words_of(x) for x in texts_of(batch, "text")])
            packed = [x.tobytes() for x in _packed(_minima(sets, FINE_HASHES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array([len(x) for x in sets], pa.int64())], ["node", "signature", "n"])

    return texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(sign, "node long, signature binary, n long")


def _across(buckets: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in a bucket that pass the finer estimate, compared in blocks of signatures."""
    placed = buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parted = placed.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")
    )
    parted = stored(parted.where("low != high").select("bucket", "blocks"), "parted")
    rows = stored(placed.join(sized(parted), "bucket"), "across")
    fine = stored(_fine(rows.select("node").distinct(), texts), "fine").dropDuplicates(["node"])
    rows = rows.withColumn("own", F.expr("pmod(xxhash64(node), blocks)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.join(fine.join(classes.select("node", "bands"), "node"), "node")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    least = least_estimate(percent, FINE_HASHES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def pairs() -> pa.RecordBatch:
            node, root, own, n = (np.array([x[k] for x in held]) for k in range(4))
            low, bands = (np.frombuffer(b"".join(x[k] for x in held), np.uint64).reshape(len(held), -1) for k in (4, 5))
            bucket = np.int64(unit[0]).astype(np.uint64)
            one, two = [], []
            for x in range(len(held) - 1):
                y = np.arange(x + 1, len(held))
                # In a unit of two blocks, those within a block belong to another unit.
                y = y[(root[y] != root[x]) & ((own[y] != own[x]) | (unit[1] == unit[2]))]
                y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
                y = y[estimate(low[x], low[y]) >= least] if len(y) else y
                # A pair leaves in the first band that it shares.
                y = y[bands[y, (bands[y] == bands[x]).argmax(axis=1)] == bucket] if len(y) else y
                one.append(np.minimum(node[x], node[y]))
                two.append(np.maximum(node[x], node[y]))
            a, b = (np.concatenate([*v, np.zeros(0, np.int64)]) for v in (one, two))
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

        for batch in batches:
            for *key, node, root, own, n, signature, band_hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != unit:
                    if len(held) > 1:
                        yield pairs()
                    unit, held = key, []
                held.append((node, root, own, n, signature, band_hashes))
        if len(held) > 1:
            yield pairs()

    return rows.select("bucket", "i", "j", "node", "root", "own", "n", "signature", "bands").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row for each document: row, id, digest, n_shingles, set, group (the component's own number, null for a document
    alone), component_id (smallest id reachable, its own included)."""
    described = stored(describe(docs, id_column, text_column), "signatures")
    groups = described.where("n > 0").groupBy("set").agg(F.min("id").alias("least_id"), F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    first = described.select(F.col("row").alias("node"), "id", "n", "signature", "bands")
    # node, set, least_id, copies; id names the row that the class's text is read from
    classes = stored(groups.join(first, "node"), "classes")
    buckets = stored(_buckets(classes), "buckets")

    met = buckets.groupBy("node").agg(F.sum("members").alias("met"))
    hubs = buckets.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("b"))
    pairs = buckets.join(hubs, "bucket").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    pairs = stored(_estimated(pairs, classes, percent), "pairs")

    wanted = stored(buckets.select("node").distinct().join(classes.select("node", "id", "set"), "node"), "wanted")
    texts = docs.select(F.col(id_column).alias("text_id"), F.col(text_column).alias("text"))
    found = texts.join(sized(wanted), F.col("text_id").eqNullSafe(F.col("id"))).select("node", "set", "text")
    held = stored(_with_set(found), "texts")

    links = stored(_confirmed(pairs, held, percent), "confirmed")
    roots = stored(components(links), "roots")
    more = _across(buckets, roots, classes, held, percent)
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(more.join(tested, ["a", "b"], "left_anti"), "pairs")
    links = links.union(_confirmed(more, held, percent))
    roots = stored(components(links), "roots")

    least = classes.select("node", "set", "least_id", "copies").join(roots, "node", "left")
    by_root = least.where("root IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("component"))
    least = least.join(by_root, "root", "left").where("copies > 1 OR root IS NOT NULL")
    # A class may hold a large part of all rows: its row is met under eight keys.
    shares = 8
    least = least.select("set", F.coalesce("component", "least_id").alias("component"), F.coalesce("root", "node").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    rows = described.select("row", "id", "digest", "n", "set", F.expr(f"cast(pmod(row, {shares}) AS int)").alias("share"))
    joined = rows.join(least, ["set", "share"], "left")
    return joined.select(
        "row", "id", "digest", F.col("n").alias("n_shingles"), "set", F.when(F.col("n") > 0, F.col("group")).alias("group"),
        F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
    )


def _with_set(rows: DataFrame) -> DataFrame:
    """Rows (node, text) whose text has the node's words: tells rows with equal ids apart. One row is kept for a node."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests = (_same_words(words_of(x)) for x in texts_of(batch, "text"))
            keep = pa.array([x == y for x, y in zip(digests, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], ["node", "text"])

    return rows.mapInArrow(same, "node long, text string")


def report(docs: DataFrame, **options: object) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(docs, **options)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: object) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id (of a group without ids, of all), of
    several texts with that id the one with the smallest digest, of equal rows one. Texts without shingles stay."""
    found = near_duplicates(docs, id_column, text_column, **options).where("group IS NOT NULL")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    chosen = found.groupBy("group").agg(F.min(order).alias("chosen"))
    stays = F.col("id").eqNullSafe(F.col("chosen.id")) & (F.col("digest") == F.col("chosen.digest"))
    marked = found.join(chosen, "group").withColumn("stays", stays)
    marked = stored(marked.groupBy("id", "digest", "stays").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR NOT stays"), "marked")
    goes, repeated = sized(marked.where("NOT stays")), sized(marked.where("stays"))

    def meets(rows: DataFrame) -> Column:
        return docs[id_column].eqNullSafe(rows["id"]) & (_digest(docs[text_column]) == rows["digest"])

    kept = docs.join(goes, meets(goes), "left_anti")
    if repeated.isEmpty():
        return kept
    once = docs.join(repeated, meets(repeated), "left_semi").dropDuplicates([id_column, text_column])
    return kept.join(repeated, meets(repeated), "left_anti").unionByName(once)
