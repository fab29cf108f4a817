"""Exact duplicates by a heavy-hitter split.

1. Every partition keeps a Misra-Gries summary of its digests; the summaries
   are summed and reduced to ``counters`` candidates. A digest with more than
   ``n / (counters + 1)`` rows cannot be missing. The counters grow with n, one
   for each ``LIGHT_ROWS`` rows between COUNTERS and MOST_COUNTERS, so up to 2^36
   rows no light digest has more than LIGHT_ROWS.
2. The candidates are counted exactly; those at or over the bound are the
   verified winners. At most ``counters`` rows, they are broadcast, and their
   rows are decided where they lie, without a shuffle.
3. All other digests are shuffled; none of them has more than
   ``n / (counters + 1)`` rows.

To mark duplicates only (id, SHA-256) pairs move, never texts; to drop them the
rows of light digests move once, after the copies within each partition are gone.

Defined results: a null text equals the empty one. A null id ranks below all
others. Of rows that agree in text and id exactly one stays. An empty table
gives an empty result. Further columns of the input are ignored by
``mark_duplicates`` and kept by ``drop_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import col, durable, fresh, ship_package
from .copies import dealt

COUNTERS, MOST_COUNTERS = 256, 65_536
LIGHT_ROWS = 1 << 20


def reduce_summary(counts: Counter, counters: int) -> Counter:
    """Misra-Gries: take the (counters + 1)-th largest count from all, keep what is above 0."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            if len(held) > 8 * counters:
                held = reduce_summary(held, counters)
        held = reduce_summary(held, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())}
        )

    return run


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def counters_for(n: int) -> int:
    return min(MOST_COUNTERS, max(COUNTERS, n // LIGHT_ROWS))


def verified_winners(digests: DataFrame, counters: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size, n_top) of each heavy digest; at most ``counters`` rows.

    ``digests`` has the columns id and digest. n_top: rows of the group that have keep_id.
    """
    n = digests.count()
    counters = counters or counters_for(n)
    bound = max(2, -(-n // (counters + 1)))
    merged = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
    # the sum of mergeable summaries still holds every digest over the bound, and its largest counts are enough
    top = merged.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)
    found = digests.join(F.broadcast(top.select("digest")), "digest")
    exact = durable(
        found.groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= bound)
    )
    on_top = F.col("id").eqNullSafe(F.col("keep_id"))
    return durable(
        digests.join(F.broadcast(exact), "digest")
        .groupBy("digest", "keep_id", "group_size")
        .agg(F.count_if(on_top).alias("n_top"))
    )


def _light_marks(light: DataFrame) -> DataFrame:
    group = Window.partitionBy("digest")
    first = group.orderBy(F.col("id").desc_nulls_last())
    return light.select(
        "id",
        "digest",
        F.max("id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept"),
    )


def mark_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    ship_package(docs.sparkSession)
    digests = durable(docs.select(col(id_col).alias("id"), _digest(text_col).alias("digest")))
    winners = F.broadcast(verified_winners(digests, counters))
    heavy = digests.join(winners, "digest")
    on_top = F.col("id").eqNullSafe(F.col("keep_id"))
    cols = ["id", "digest", "keep_id", "group_size"]
    plain = heavy.where(~on_top | (F.col("n_top") == 1)).select(*cols, on_top.alias("kept"))
    # rows that agree in text and id: counted first, then dealt out again, one of them kept
    tied = (
        heavy.where(on_top & (F.col("n_top") > 1))
        .groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    tied = dealt(tied, "n", "copy").select(*cols, (F.col("copy") == 1).alias("kept"))
    light = _light_marks(digests.join(winners, "digest", "left_anti"))
    return (
        plain.unionByName(tied)
        .unionByName(light)
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            "kept",
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None
) -> DataFrame:
    """The rows of ``docs``, all columns, that ``mark_duplicates`` keeps.

    Rows of heavy digests are dropped where they lie. The rest is shuffled once
    by digest. If rows that agree in text and id differ elsewhere, any one stays.
    """
    ship_package(docs.sparkSession)
    names = docs.columns
    digests = durable(docs.select(col(id_col).alias("id"), _digest(text_col).alias("digest")))
    winners = verified_winners(digests, counters)
    d, keep, top, rank = (fresh(docs, x) for x in ("qw_digest", "qw_keep", "qw_top", "qw_rank"))
    wide = docs.withColumn(d, _digest(text_col))
    small = F.broadcast(winners.select(F.col("digest").alias(d), F.col("keep_id").alias(keep), F.col("n_top").alias(top)))
    heavy = wide.join(small, d).where(col(id_col).eqNullSafe(col(keep)))
    once = heavy.where(col(top) == 1).select(*map(col, names))
    # dropDuplicates combines within each partition first, so one much repeated row is no hot group
    tied = heavy.where(col(top) > 1).dropDuplicates([d]).select(*map(col, names))
    order = Window.partitionBy(col(d)).orderBy(col(id_col).desc_nulls_last())
    light = (
        wide.join(small, d, "left_anti")
        .withColumn(rank, F.row_number().over(order))
        .where(col(rank) == 1)
        .select(*map(col, names))
    )
    return once.unionByName(tied).unionByName(light)
