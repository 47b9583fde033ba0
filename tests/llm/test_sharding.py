import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

from ledgerleaf.llm import sharding


def hash_of(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)


def shard_of(key, shards):
    """One key at a time, as published."""
    state, shard, ahead = hash_of(key), -1, 0
    while ahead < shards:
        shard = ahead
        state = (state * 2862933555777941757 + 1) % 2**64
        ahead = int((shard + 1) * (float(2**31) / float((state >> 33) + 1)))
    return shard


def test_jumps_equal_one_key_at_a_time():
    keys = list(range(3000))
    hashes = np.array([hash_of(k) for k in keys], np.uint64).view(np.int64)
    for shards in (1, 2, 7, 16, 1000):
        own, grown = sharding.jumps(hashes, shards)
        assert own.tolist() == [shard_of(k, shards) for k in keys]
        assert grown.tolist() == [shard_of(k, shards + 1) for k in keys]
        if shards <= 16:
            counts = np.bincount(own, minlength=shards)
            expected = len(keys) / shards
            assert abs(counts - expected).max() < 6 * np.sqrt(expected) + 1
            moved = own != grown
            assert (grown[moved] == shards).all()
            assert abs(moved.mean() - 1 / (shards + 1)) < 0.04


def test_place_and_number_with_odd_rows(spark, docs):
    rows = docs.select(*(c for c in docs.columns if c != "row"), F.lit("x").alias("shard"), F.lit(2).alias("SLOT"), F.lit(3).alias("hash"))
    placed, (shard, grown, digits) = sharding.place(rows, 16)
    assert (shard, grown, digits) == ("shard_", "grown_shard", "hash_")
    numbered, slot = sharding.number(placed, shard, [digits, "doc_id", "text"])
    assert slot == "slot_"
    found = numbered.collect()
    assert len(found) == rows.count()
    assert set(rows.columns) <= set(numbered.columns)
    slots = collections.defaultdict(list)
    for r in found:
        assert r[shard] == shard_of(r.doc_id, 16)
        assert r[grown] == shard_of(r.doc_id, 17)
        slots[r[shard]].append((r[slot], r[digits]))
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own)))
        assert [h for _, h in own] == sorted(h for _, h in own)


def test_slots_do_not_depend_on_the_layout(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"))
    found = []
    for parts in (1, 7):
        placed, (shard, _, digits) = sharding.place(rows.repartition(parts), 4)
        numbered, slot = sharding.number(placed, shard, [digits, "doc_id"])
        found.append(sorted(map(repr, numbered.collect())))
    assert found[0] == found[1]


def test_a_key_with_a_third_of_all_rows_is_spread(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"))
    placed, (shard, _, digits) = sharding.place(rows, 4)
    spread = placed.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(8, shard, digits, "salt")
    sizes = spread.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * 30_000 / 8
    numbered, slot = sharding.number(placed, shard, [digits, "doc_id"])
    for r in numbered.groupBy(shard).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(slot).alias("d"), F.max(slot).alias("m")).collect():
        assert r.n == r.d == r.m + 1


def test_files_by_shard_and_appended_shards(spark, docs, tmp_path):
    written = sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {f"shard={i}" for i in range(4)}
    own = docs.select("doc_id", "text", "lang")
    assert sorted(map(repr, written.select("doc_id", "text", "lang").collect())) == sorted(map(repr, own.collect()))
    assert all(r.shard == shard_of(r.doc_id, 4) for r in written.collect())
    moved, (left, entered) = sharding.moving(docs, 4, 3)
    rows = moved.collect()
    assert {r[entered] for r in rows} <= {4, 5, 6}
    assert all((r[left], r[entered]) == (shard_of(r.doc_id, 4), shard_of(r.doc_id, 7)) for r in rows)
    assert len(rows) == sum(shard_of(r.doc_id, 4) != shard_of(r.doc_id, 7) for r in docs.collect())


def test_empty_table(none):
    placed, (shard, _, digits) = sharding.place(none, 16)
    numbered, _ = sharding.number(placed, shard, [digits])
    assert numbered.count() == 0
