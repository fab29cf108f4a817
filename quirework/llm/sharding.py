"""Sharding by sampled splitters, with built-in functions only.

Records are ordered by a key (``group``, ``id``), the group being a hash of the
text, so equal texts lie together.

1. A size-weighted sample of the groups is drawn: a record is in it with a
   probability in proportion to its load, its share of all bytes and of all
   rows, decided by a hash of its key. Its expected number of rows is a
   parameter, so the driver may hold it.
2. Quantiles of the sample are the splitters; the ranges between them take
   records by a binary search inside the scan. Loads, sizes and counts of the
   ranges are summed exactly. There are a range for each RANGE_ROWS rows, within
   bounds, so neither many short texts nor few long ones make a range large.
3. Ranges over the bound, as one group can make them, are subdivided: their
   records are sampled again, now by (group, id).
4. The running sums over the ranges say in which range each shard must end;
   only these (at most shards - 1) ranges are looked into to set the cut. A
   range of whole groups is cut between two groups, a subdivided one between
   two records. So equal texts share a shard unless their group is overfull.

Records are narrow (id, group, size, checksum), written once; texts never move.
Slots are numbered within the ranges, each of which has a bounded share of the
bytes and of the rows.

Rows that agree in all four columns are counted first, so that a row that
repeats without end is no hot key; the copies are then blocks of bounded size,
numbered as a third part of the key, and slots are dealt out to them in the end.

Defined results: a null text has no bytes, size 1 and the checksum of no bytes,
0. A null id sorts first. Shards may be empty when there are fewer records than
shards. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import col, durable

SHARDS = 16
RANGES_PER_SHARD = 64
RANGE_ROWS = 1 << 18
MOST_RANGES = 1 << 14
SAMPLES_PER_RANGE = 8
_LEAST = -(2**63)


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group, size, crc, n): the records to deal out, equal ones counted."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(
            col(id_col).cast("long").alias("id"),
            F.xxhash64(text).alias("group"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
        )
        .groupBy("id", "group", "size", "crc")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def range_of(key: Column, splitters: list, steps: str) -> Column:
    """How many of the sorted ``splitters`` are at or below ``key``: a binary search in the row."""
    if not splitters:
        return F.lit(0)
    power = 1
    while power * 2 <= len(splitters):
        power *= 2
    strides = []
    while power:
        strides.append(power)
        power //= 2
    return F.aggregate(
        F.array(*(F.lit(s) for s in strides)),
        F.lit(0),
        lambda at, s: at
        + F.when((at + s <= len(splitters)) & (key >= F.get(F.expr(steps), at + s - 1)), s).otherwise(0),
    )


def _literal(splitters: list) -> str:
    if splitters and isinstance(splitters[0], tuple):
        return "array(" + ",".join(f"struct({_long(g)} as g, {_long(i)} as i, {_long(k)} as k)" for g, i, k in splitters) + ")"
    return "array(" + ",".join(_long(g) for g in splitters) + ")"


def _long(v: int) -> str:
    return "(-9223372036854775807L - 1L)" if v == _LEAST else f"({v}L)"


def _key() -> Column:
    return F.struct(F.col("group").alias("g"), F.coalesce("id", F.lit(_LEAST)).alias("i"), F.col("block").alias("k"))


def blocks_of(records: DataFrame, ranges: int) -> tuple[DataFrame, int, int]:
    """``records`` with their copies in blocks of at most the bytes and rows of a range, and their loads; the bytes of all.

    A record's load is the mean of its shares of all bytes and of all rows; the loads of all add up to 1.
    """
    total, rows = records.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    total, rows = total or 0, rows or 0
    ranges = max(ranges, min(MOST_RANGES, rows // RANGE_ROWS))
    most = F.least(F.lit(total / ranges) / F.col("size"), F.lit(rows / ranges))
    each = F.greatest(F.lit(1), F.floor(most)).cast("long")
    cut = records.withColumn("each", each).withColumn("block", F.explode(F.expr("sequence(0L, (n - 1) div each)")))
    cut = cut.withColumn("n", F.least("each", F.col("n") - F.col("block") * F.col("each"))).drop("each")
    load = F.col("n") * (F.col("size") / F.lit(2.0 * (total or 1)) + F.lit(0.5 / (rows or 1)))
    return cut.withColumn("load", load), total, ranges


def _sampled(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """Rows in proportion to their load; ``rate``: expected samples of all."""
    weight = F.col("load") * F.lit(float(rate))
    draw = F.pmod(F.xxhash64("group", "id", "block", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return rows.where(draw < weight)


def _quantiles(keys: list, pieces: int) -> list:
    keys = sorted(keys)
    return sorted({keys[k * len(keys) // pieces] for k in range(1, pieces)}) if keys else []


def plan_ranges(records: DataFrame, ranges: int, seed: int = 7) -> list[tuple]:
    """Splitters (group, id, block) that cut ``records`` into about ``ranges`` of like load."""
    want = ranges * SAMPLES_PER_RANGE
    drawn = [r[0] for r in _sampled(records, want, seed).select("group").collect()]
    firsts = _quantiles(drawn, ranges)
    # a group drawn again and again gets a range of its own
    times = Counter(drawn)
    often = [g for g in firsts if times[g] >= SAMPLES_PER_RANGE]
    firsts = sorted({*firsts, *(g + 1 for g in often if g < 2**63 - 1)})
    at = range_of(F.col("group"), firsts, _literal(firsts))
    sums = {r[0]: r[1] for r in records.groupBy(at.alias("r")).agg(F.sum("load")).collect()}
    bound = 2 / ranges + 1e-9  # sums differ in their last digits with the order of the rows
    over = sorted(r for r, b in sums.items() if b > bound)
    cuts = {(g, _LEAST, _LEAST) for g in firsts}
    if over:
        inside = records.withColumn("r", at).where(F.col("r").isin(over))
        finer = _sampled(inside, 2 * want, seed + 1)
        held: dict[int, list] = {}
        for r, key in finer.select("r", _key()).collect():
            held.setdefault(r, []).append(tuple(key))
        for r, keys in held.items():
            cuts.update(_quantiles(keys, math.ceil(2 * sums[r] * ranges - 1e-6)))
    return sorted(cuts)


def assign_shards(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = RANGES_PER_SHARD,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs``."""
    records = durable(records_of(docs, id_col, text_col))
    records, total, ranges = blocks_of(records, shards * ranges_per_shard)
    splitters = plan_ranges(records, ranges) if total else []
    ranged = records.withColumn("r", range_of(_key(), splitters, _literal(splitters)))
    stats = sorted(ranged.groupBy("r").agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).collect())
    # the ranges in which the shards end
    starts, before = [], 0
    for r, b, _ in stats:
        starts.append((before, r))
        before += b
    goals: dict[int, list[float]] = {}
    for k in range(1, shards if total else 1):
        goal = total * k / shards
        at = bisect_right(starts, (goal, 1 << 62)) - 1
        goals.setdefault(starts[at][1], []).append(goal)
    offset = {r: b for b, r in starts}
    cuts = []
    if goals:
        # within a range of whole groups the unit is the group, else the record
        whole = _whole_groups(splitters)
        inside = ranged.where(F.col("r").isin(sorted(goals)))
        merged = F.col("r").isin(sorted(whole & set(goals)))
        unit = F.when(merged, F.struct(F.lit(_LEAST).alias("i"), F.lit(_LEAST).alias("k"))).otherwise(
            F.struct(F.coalesce("id", F.lit(_LEAST)).alias("i"), F.col("block").alias("k"))
        )
        units = inside.groupBy("r", "group", unit.alias("unit")).agg(F.sum(F.col("size") * F.col("n")).alias("b"))
        upto = F.sum("b").over(Window.partitionBy("r").orderBy("group", "unit"))
        plan = [(r, float(g - offset[r])) for r, gs in goals.items() for g in gs]
        wanted = docs.sparkSession.createDataFrame(plan, "r int, goal double")
        # the first unit whose middle is at or past the goal opens the next shard
        found = (
            units.withColumn("mid", upto - F.col("b") / 2)
            .join(F.broadcast(wanted), "r")
            .where(F.col("mid") >= F.col("goal"))
            .groupBy("r", "goal")
            .agg(F.min(F.struct("group", "unit")).alias("c"))
        )
        got = {(x["r"], x["goal"]): (x["c"]["group"], *x["c"]["unit"]) for x in found.collect()}
        after = {r: n for (r, *_), (n, *_) in zip(stats, stats[1:], strict=False)}
        for r, g in plan:
            if (r, g) in got:
                cuts.append(got[r, g])
            elif r in after:
                cuts.append(splitters[after[r] - 1])
            else:
                cuts.append((2**63 - 1,) * 3)
    cuts.sort()
    # ranges and shards at once: a splitter at every cut
    both = sorted({*splitters, *cuts})
    shard_of = [bisect_right(cuts, key) for key in both]
    ranged = records.withColumn("r", range_of(_key(), both, _literal(both)))
    counts = dict(ranged.groupBy("r").agg(F.sum("n")).collect())
    first, seen = [], [0] * (shards + 1)
    table = []
    for r in range(len(both) + 1):
        s = 0 if r == 0 else shard_of[r - 1]
        table.append(s)
        first.append(seen[s])
        seen[s] += counts.get(r, 0)
    shard = F.get(F.expr("array(" + ",".join(map(str, table)) + ")"), F.col("r"))
    base = F.get(F.expr("array(" + ",".join(f"{x}L" for x in first) + ")"), F.col("r"))
    order = Window.partitionBy("r").orderBy("group", "id", "block", "size", "crc")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        ranged.withColumn("last", upto)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            shard.cast("int").alias("shard"),
            (base + F.col("last") - F.col("copy")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _whole_groups(splitters: list[tuple]) -> set[int]:
    """Ranges that begin and end between two groups."""
    edge = [True, *(i == _LEAST for _, i, _ in splitters), True]
    return {r for r in range(len(splitters) + 1) if edge[r] and edge[r + 1]}
