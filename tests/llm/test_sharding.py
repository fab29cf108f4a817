import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirework.llm import sharding as S


def laws(rows, docs, shards=16):
    """One row for each record, gapless slots, right sizes and checksums."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = S.assign_shards(docs).collect()
    held = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    laws(rows, held)
    bytes_ = Counter()
    for r in rows:
        bytes_[r.shard] += r.size
    mean, largest = sum(bytes_.values()) / 16, max(r.size for r in rows)
    assert len(bytes_) == 16 and all(abs(b - mean) <= largest for b in bytes_.values())
    # equal texts share a shard
    at = {r.doc_id: r.shard for r in rows}
    by_text = defaultdict(set)
    for i, t in held:
        by_text[t].add(at[i])
    assert sum(len(s) > 1 for s in by_text.values()) <= 1


def test_hot_group_and_repeated_row_are_subdivided(spark):
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    docs = docs.unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("again").alias("text")))
    rows = S.assign_shards(docs).collect()
    laws(rows, [tuple(r) for r in docs.collect()])
    bytes_ = Counter()
    for r in rows:
        bytes_[r.shard] += r.size
    mean = sum(bytes_.values()) / 16
    assert max(bytes_.values()) < 1.05 * mean and min(bytes_.values()) > 0.95 * mean


def test_shards_and_slots_are_runs_in_the_order_of_the_keys(spark):
    """By brute force: the records sorted by (hash of the text, id), cut where their bytes reach each share of the whole."""
    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    key = {i: ((h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64), i) for i, t in text.items()}
    rows = sorted(S.assign_shards(docs).collect(), key=lambda r: key[r.doc_id])
    total, most = sum(r.size for r in rows), Counter(text.values()).most_common(1)[0][1] * max(r.size for r in rows)
    before, last = 0, (0, -1)
    for r in rows:
        assert (r.shard, r.slot) in ((last[0], last[1] + 1), (r.shard, 0)) and r.shard >= last[0]
        if r.shard > last[0]:
            assert all(abs(before - total * k / 16) <= most for k in range(last[0] + 1, r.shard + 1))
        before, last = before + r.size, (r.shard, r.slot)


def test_many_empty_texts_make_no_range_of_many_rows(spark):
    """200,000 empty texts with ids of their own among 2,000 long ones, and 100,000 that are one row."""
    docs = spark.range(202_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 101 > 0, "").otherwise(F.repeat(F.col("id").cast("string"), 2000)).alias("text"))
    docs = docs.unionByName(spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("").alias("text")))
    records, total, ranges = S.blocks_of(S.durable(S.records_of(docs)), 1024)
    cuts = S.plan_ranges(records, ranges)
    ranged = records.withColumn("r", S.range_of(S._key(), cuts, S._literal(cuts)))
    most = ranged.groupBy("r").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("b")).agg(F.max("n"), F.max("b")).first()
    assert most[0] < 10 * 302_000 / 1024 and most[1] < 10 * total / 1024
    out = S.assign_shards(docs)
    sums = out.groupBy("shard").agg(F.count("slot").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"), F.sum("size").alias("b")).collect()
    assert sum(r.n for r in sums) == 302_000 and all(r.n == r.d == r.m + 1 for r in sums)
    assert all(abs(r.b - total / 16) < 20_000 for r in sums)


def test_same_result_however_the_input_lies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted(map(tuple, S.assign_shards(docs).collect()))
    assert one == sorted(map(tuple, S.assign_shards(docs.repartition(7, "n_chars")).collect()))


def test_odd(odd, odd_rows, none):
    laws(S.assign_shards(odd).collect(), [r[:2] for r in odd_rows])
    assert S.assign_shards(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 20])
def test_range_of(spark, n):
    cuts = [k * 10 for k in range(n)]
    df = spark.range(-5, n * 10 + 5)
    got = df.select("id", S.range_of(F.col("id"), cuts, S._literal(cuts)).alias("r")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) for r in got)
