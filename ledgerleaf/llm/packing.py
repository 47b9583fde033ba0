"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut; the first piece takes what is left
over). What decides the packing is how many pieces have which length, which is at most ``capacity`` numbers however
many documents there are: the driver packs lengths with multiplicities, and tasks look up the place of each piece by
its length and its rank among the pieces of that length. Ranks need no sort: each tokenising task numbers its own
pieces of a length, and the counts of earlier tasks are added. Texts and token ids are never shuffled.

The reduction fixes, for good, sets that dominate every other set holding the same piece: a piece that nothing fits
beside, two pieces that fill a sequence exactly, and the longest partner where no two further pieces fit together or
where no fitting pair is longer than it. What remains is packed longest first into the fullest sequence it fits.

Defined cases: a null or empty text is one piece of the end token only; rows with equal ids or texts are each packed;
an empty table gives no pieces; ids and other columns may hold nulls.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import slices, stored

CAPACITY = 2048
END = 0
_SPECIAL, _SPECIAL_ID = "<|endoftext|>", 50256


def encoder(path: str) -> Callable[[str], bytes]:
    """Function from a text to its ids as little-endian unsigned 32-bit bytes: byte-level BPE of the tokenizer file at
    ``path`` (``.json`` with its ``.tiktoken`` twin beside it, whose library gives the same ids in a quarter of the
    time), special strings as their ids, nothing added."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary
    special = np.array([_SPECIAL_ID], "<u4").tobytes()
    return lambda text: special.join(array("I", plain(part)).tobytes() for part in text.split(_SPECIAL))


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, task, rank[, ids]): ``rank`` numbers a task's pieces of a length."""
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    schema += ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([END], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            rows = []
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                a, piece = 0, 0
                while a < n:
                    b = a + ((n - a) % capacity or capacity) if n > capacity else n
                    own = ids[4 * a : 4 * b]
                    rows.append((key, piece, a, b - a, zlib.crc32(own), task, int(seen[b - a]), own))
                    seen[b - a] += 1
                    a, piece = b, piece + 1
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"]
            columns = zip(*rows, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            n_columns = 8 if with_ids else 7
            yield pa.RecordBatch.from_arrays(arrays[:n_columns], names[:n_columns])

    return docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).mapInArrow(cut, schema)


class Packing:
    """Places by length: rows (length, first rank, pieces in a row in one sequence, first sequence, first offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0  # pieces placed by the reduction
        self._reduce()
        self._best_fit()
        order = sorted(self.rows)
        self.first = {}
        for row in order:
            self.first.setdefault(row[0], []).append(row)

    def _place(self, length: int, n: int, per: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), per, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def _fix(self, lengths: list[int], n: int) -> None:
        """``n`` sequences, each with one piece of each of the lengths."""
        offset = 0
        for length in lengths:
            self._place(length, n, 1, self.sequences, offset)
            offset += length
        self.sequences += n
        self.fixed += n * len(lengths)

    def _dominating(self, j: int) -> tuple[list[int], int] | None:
        """Lengths of a set that dominates all others with a piece of length ``j``, and how often it can be fixed."""
        self.left[j] -= 1
        try:
            room = self.capacity - j
            fitting = np.flatnonzero(self.left[: room + 1] > 0)
            if not len(fitting):
                # Without a second piece of this length among the partners, each of them stands alone.
                return [j], int(self.left[j]) + 1
            k = int(fitting[-1])
            smallest = [int(x) for x in fitting[:3] for _ in range(min(3, int(self.left[x])))][:3]
            if k != room:
                if len(smallest) > 1 and smallest[0] + smallest[1] <= room:
                    if len(smallest) > 2 and sum(smallest) <= room:
                        return None
                    # At most two more pieces fit: the longest fitting pair against the longest single piece.
                    partner = np.searchsorted(fitting, room - fitting, side="right") - 1
                    ok = partner >= 0
                    a, b = fitting[ok], fitting[partner[ok]]
                    alone = (a == b) & (self.left[a] < 2)
                    b = np.where(alone, np.where(partner[ok] > 0, fitting[np.maximum(partner[ok] - 1, 0)], -self.capacity), b)
                    if len(a) and int((a + b).max()) > k:
                        return None
            if k == j:
                return [j, j], (int(self.left[j]) + 1) // 2
            return [j, k], int(min(self.left[j] + 1, self.left[k]))
        finally:
            self.left[j] += 1

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.left[j] > 0 and (found := self._dominating(j)):
                    self._fix(*found)
                    changed = True

    def _best_fit(self) -> None:
        """Open sequences are kept as ranges with the same room; a range is filled as if one by one."""
        rooms: dict[int, list[tuple[int, int]]] = {}
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                n = int(self.left[length])
                room = min((r for r in rooms if r >= length), default=None)
                if room is None:
                    room = self.capacity
                    rooms[room] = [(self.sequences, -(-n // (room // length)))]
                    self.sequences += rooms[room][0][1]
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                per, offset = room // length, self.capacity - room
                full = min(many, n // per)
                if full:
                    self._place(length, full * per, per, first, offset)
                    if rest := room - per * length:
                        rooms.setdefault(rest, []).append((first, full))
                if full < many:
                    if some := min(n - full * per, per):
                        self._place(length, some, per, first + full, offset)
                        if rest := room - some * length:
                            rooms.setdefault(rest, []).append((first + full, 1))
                        full += 1
                    if full < many:
                        rooms.setdefault(room, []).append((first + full, many - full))

    def arrays(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {k: tuple(np.array(c, np.int64) for c in list(zip(*rows, strict=True))[1:]) for k, rows in self.first.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a stored table of ``pieces``) with ``sequence_id`` and ``offset`` instead of ``task`` and ``rank``."""
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task and length, not for each piece.
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Packing(counts, capacity).arrays()
    kept = [c for c in cut.columns if c not in ("task", "rank")]
    ranked = cut.join(base, ["length", "task"]).select(*kept, (F.col("rank") + F.col("base")).alias("rank"))
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.drop("rank").dtypes) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            ranks = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                length = int(lengths[rows[0]])
                first, per, seq, off = places[length]
                at = np.searchsorted(first, ranks[rows], side="right") - 1
                i = ranks[rows] - first[at]
                sequence[rows] = seq[at] + i // per[at]
                offset[rows] = off[at] + i % per[at] * length
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options: object) -> DataFrame:
    """Tokenise, cut and pack: a row for each piece with its sequence and place."""
    return pack(stored(pieces(docs, tokenizer, capacity=capacity, **options), "pieces"), capacity)
