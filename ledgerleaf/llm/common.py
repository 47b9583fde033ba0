"""Helpers that the operators of this subpackage share: reading, folds, stored results, byte-wise batches, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ledgerleaf.session import scratch_path

# Texts handled at once by array code; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(key: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves ``rest``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == rest, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back, so that it is computed once and has no lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not taken (names are compared without case, as Spark does)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def extended(schema: StructType, names: list[str], kinds: str) -> StructType:
    """The schema with further fields, their types given as ``type; type``."""
    more = [StructField(n, DataType.fromDDL(k)) for n, k in zip(names, kinds.split("; "), strict=True)]
    return StructType([*schema.fields, *more])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over all positions."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """64-bit hashes of ranges of a buffer of bytes, or of 64-bit values, from prefix sums of values times powers of an odd
    base."""

    _BASE = 0x5851F42D4C957F2D
    _INVERSE = pow(_BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self._values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self._powers = self._inverses = np.ones(1, np.uint64)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def load(self, data: np.ndarray) -> RangeHash:
        n = len(data) + 1
        if n > len(self._powers):
            self._powers, self._inverses = self._series(self._BASE, n), self._series(self._INVERSE, n)
        self._sums = np.zeros(n, np.uint64)
        values = self._values[data] if data.dtype == np.uint8 else mixed(data)
        np.cumsum(values * self._powers[: n - 1], out=self._sums[1:])
        return self

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hashes: equal for equal ranges."""
        return (self._sums[ends] - self._sums[starts]) * self._inverses[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.raw(starts, ends) + (ends - starts).astype(np.uint64))


class Words:
    """Words of a batch of texts as one buffer: each text's words joined by a blank, texts apart from each other.

    ``doc`` is the text of each word, ``first`` the index of each text's first word and, at the end, of all.
    """

    def __init__(self, lists: list[list[bytes]]) -> None:
        joined = b" ".join(b" ".join(words) for words in lists if words)
        self.data = np.frombuffer(joined, np.uint8)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.doc = np.repeat(np.arange(len(lists)), counts)
        blanks = np.flatnonzero(self.data == 32)
        if len(self.doc):
            self.starts = np.concatenate(([0], blanks + 1))
            self.ends = np.concatenate((blanks, [len(self.data)]))
        else:
            self.starts = self.ends = np.zeros(0, np.int64)


# Rows (and array elements in them) of a join side that may be broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 500_000


def sized(side: DataFrame, items: str | None = None) -> DataFrame:
    """A stored, narrow join side, marked for broadcast if it is counted to be small enough, with the elements of the
    array ``items``. Stored sides of a shuffle join also let Spark split the keys that are hot."""
    extra = F.sum(F.size(items)) if items else F.lit(0)
    rows, more = side.agg(F.count(F.lit(1)), extra).first()
    return F.broadcast(side) if rows + (more or 0) <= BROADCAST_ROWS else side
