"""Sharding by jump consistent hashing: a key and the number of shards decide the shard, without a table of shards.

Each key jumps upwards from shard 0, by steps that a generator seeded with its hash draws; the last place below the
number of shards is its shard. A further shard is entered only by keys whose next jump ends there, so appended shards
take rows, about their fair share, and no row moves between the others. The hash is the first 64 bits of the MD5 of the
key as text, so it does not depend on the key's type, the table's layout or the cluster.

``place`` is a projection without a shuffle. ``number`` gives the rows of each shard gapless slots in the order of the
hash, which is a random order that stays as it is when the table is read in other splits: rows are range-partitioned
and sorted, and a shard's rows may lie in many partitions. ``write_shards`` writes whole rows as files by shard.

Defined cases: a null key is a key like any other, equal to the empty text, so all rows without key share a shard; rows
with equal keys share a shard and follow each other; an empty table has no rows; further columns stay as they are, and
the names of the added ones are made unlike those present.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import fresh, sized, stored

SHARDS = 16
# Rows of a file of a shard.
FILE_ROWS = 1_000_000
# Fixed values of the published generator.
_FACTOR, _SPAN = 2862933555777941757, float(1 << 31)


def jumps(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each 64-bit hash among ``shards``, and among one more."""
    state = hashes.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * np.uint64(_FACTOR) + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((shard[moving] + 1) * (_SPAN / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard, np.where(ahead == shards, shards, shard)


def place(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """All rows and columns with their shard, their shard among one more, and the hash as 16 hexadecimal digits; and the
    names of these three columns."""
    names: list[str] = []
    for role in ("shard", "grown_shard", "hash"):
        names.append(fresh([*docs.columns, *names], role))
    both = fresh([*docs.columns, *names], "both")

    @F.pandas_udf("shard int, grown int")
    def of_hash(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            shard, grown = jumps(part.to_numpy(), shards)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "grown": grown.astype(np.int32)})

    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 16)
    rows = docs.withColumn(names[2], digits)
    rows = rows.withColumn(both, of_hash(F.conv(names[2], 16, -10).cast("long")))
    placed = (F.col(both)["shard"].alias(names[0]), F.col(both)["grown"].alias(names[1]), names[2])
    return rows.select(*docs.columns, *placed), names


def number(rows: DataFrame, shard: str, order: list[str]) -> tuple[DataFrame, str]:
    """All rows and columns with their slot in their shard, gapless from 0 by ``order`` (nulls first), and its name.

    The rows are read twice (bounds of the ranges are estimated first). Rows that are equal in ``order`` may lie in
    several partitions, so a key with a third of all rows is spread.
    """
    taken = [*rows.columns, "slot"]
    names = []
    for role in ("salt", "at", "task", "base", "first", "n"):
        names.append(fresh([*taken, *names], role))
    salt, at, task, base, first, n = names
    spread = rows.withColumn(salt, F.monotonically_increasing_id())
    spread = spread.repartitionByRange(shard, *order, salt).sortWithinPartitions(shard, *order)
    # Ids of a partition's rows are consecutive in its order, with the partition's number above bit 33.
    placed = stored(spread.drop(salt).withColumn(at, F.monotonically_increasing_id()), "places")
    placed = placed.withColumn(task, F.shiftright(at, 33))
    runs = placed.groupBy(shard, task).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(shard).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(shard, task, (F.coalesce(before, F.lit(0)) - F.col(first)).alias(base))
    slot = fresh(rows.columns, "slot")
    numbered = placed.join(sized(stored(runs, "runs")), [shard, task])
    return numbered.select(*rows.columns, (F.col(at) + F.col(base)).alias(slot)), slot


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """Write all rows and columns to ``folder``, a sub-folder for each shard, in the order of the hash; return them read
    back. The only shuffle spreads each shard over several files by ranges of the hash."""
    rows, (shard, _, digits) = place(docs, shards, key)
    salt = fresh(rows.columns, "salt")
    rows = rows.withColumn(salt, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(shard, digits, salt).sortWithinPartitions(shard, digits)
    kept = rows.select(*docs.columns, shard)
    kept.write.partitionBy(shard).option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(kept.schema).parquet(folder)


def moving(docs: DataFrame, shards: int, more: int = 1, key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """The rows that leave their shard when ``more`` shards are appended to ``shards``, with the shard they leave and the
    one they enter, and the names of these columns."""
    before, (left, grown, digits) = place(docs, shards, key)
    after, (entered, later, again) = place(before.drop(grown, digits), shards + more, key)
    return after.where(F.col(left) != F.col(entered)).drop(later, again), [left, entered]
