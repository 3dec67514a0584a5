"""External shuffle and SSTable shards: uniformity, plans at scale, what is read of a file, and brute force."""

import io
import random
from collections import Counter

import numpy as np
import pytest

from coderill.llm import extshuffle, sstable


def test_repeated_rows_scatter_like_any(spark):
    text = "boilerplate " * 20
    df = spark.range(20_000).selectExpr("cast(if(id % 4 = 0, id, 7) as bigint) as doc_id", f"if(id % 4 = 0, repeat(cast(id as string), 40), '{text}') as text").repartition(6)
    out = extshuffle.external_shuffle(df, bucket_bytes=240_000)
    sizes = sorted(Counter(r.shard for r in out.select("shard").collect()).values())
    assert len(sizes) > 10 and max(sizes) < 1.3 * sizes[len(sizes) // 2] and sum(sizes) == 20_000
    # also where all copies lie in partitions of their own, one in each
    few = spark.range(0, 64, 1, 64).selectExpr("7L as doc_id", "'same' as text")
    spread = Counter(r.shard for r in extshuffle.external_shuffle(few, bucket_bytes=100).collect())
    assert len(spread) > 4 and max(spread.values()) < 30


@pytest.mark.parametrize("most", [10_000, 3])
def test_each_bucket_is_the_permutation_it_should_be(spark, most):
    df = spark.range(3000).selectExpr("id as doc_id", "cast(id % 900 as string) as text").repartition(3).cache()
    seed, groups_each = 5, extshuffle.plan(extshuffle.payload_bytes(df), 1 << 30, 3000, most)
    assert (groups_each[0] > 1) == (most == 3)
    got = extshuffle.external_shuffle(df, seed=seed, bucket_bytes=3000, most=most).collect()
    assert len({(r.shard, r.position) for r in got}) == 3000 and sorted(r.doc_id for r in got) == list(range(3000))
    keyed = extshuffle.numbered(df.withColumn("h", extshuffle.row_hash(df, seed)), "h", "k")
    from pyspark.sql import functions as F

    key = {r.doc_id: r.x for r in keyed.select("doc_id", F.xxhash64(F.lit(seed), "h", F.spark_partition_id(), "k").alias("x")).collect()}
    for at in {r.shard for r in got}:
        rows = sorted((r for r in got if r.shard == at), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        canonical = sorted((r.doc_id for r in rows), key=key.get)
        rng, order = np.random.Generator(np.random.PCG64([seed, at])), list(range(len(rows)))
        draws = rng.integers(np.arange(len(rows), 1, -1)).tolist() if len(rows) > 1 else []
        for i, j in zip(range(len(rows) - 1, 0, -1), draws, strict=True):
            order[i], order[j] = order[j], order[i]
        assert [r.doc_id for r in rows] == [canonical[k] for k in order]


def test_numbers_of_equal_rows_do_not_depend_on_their_order(spark):
    df = spark.createDataFrame([(k % 3,) for k in range(10)], "h bigint").coalesce(1)
    for x in (df, df.orderBy("h").coalesce(1)):
        got = Counter((r.h, r.n) for r in extshuffle.numbered(x, "h", "n").collect())
        assert got == Counter({(h, n): 1 for h in range(3) for n in range(4 if h == 0 else 3)})


def test_plan_of_a_hundred_terabytes():
    for task_bytes in (1 << 30, 4 << 30, 16 << 30):
        groups, each = extshuffle.plan(100 << 40, task_bytes)
        assert each <= 10_000 and groups * each * max(32 << 20, task_bytes // 32) >= 100 << 40 and groups <= 400
    assert extshuffle.plan(0, 1 << 30) == (1, 1) and extshuffle.plan(33 << 20, 1 << 20) == (1, 2)


def test_a_lookup_reads_few_bytes():
    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            Counting.n += len(got)
            return got

    rng = random.Random(1)
    rows = [(k, "%0600x" % rng.getrandbits(2400)) for k in range(4000)]
    raw = b"".join(r[9] for r in sstable.sections(iter(rows), 0, 8 << 10, 1 << 30))
    table = sstable.SSTable(Counting(raw))
    opened = Counting.n
    assert table.get(1234) == [rows[1234][1]] and Counting.n - opened < 3 * (8 << 10) and opened < 0.1 * len(raw)
    before = Counting.n
    missing = sum(table.get(-k) != [] for k in range(1, 200))
    assert missing == 0 and Counting.n - before < 20 * (8 << 10)
    for bad in (b"", b"x" * 200, raw[:-1]):
        with pytest.raises(ValueError):
            sstable.SSTable(bad)


def test_shards_against_a_dictionary(spark, tmp_path):
    rows = [(k % 50 if k % 2 else 1000 - k, f"text {k % 7}" * (k % 11)) for k in range(2000)] + [(None, "n"), (None, None), (3, None), (3, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = sstable.write_files(sstable.to_shards(df, block_bytes=3000, shard_bytes=60_000), tmp_path.as_uri()).collect()
    tables = [sstable.SSTable.open(r.path) for r in sorted(found, key=lambda r: r.shard_id)]
    assert len(tables) > 2
    for i in {i for i, _ in rows} | {10**9, -5}:
        got = [v for t in tables for v in t.get(i)]
        assert Counter(got) == Counter(v for k, v in rows if k == i)


def test_number_of_shards_follows_the_bytes(spark):
    df = spark.range(400).selectExpr("id as doc_id", "repeat('ab', 500) as text")
    assert sstable.to_shards(df, block_bytes=4000, shard_bytes=20_000).select("shard_id").distinct().count() >= 20
