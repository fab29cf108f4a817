"""Best-fit packing of documents into bins, under conflicts.

Documents go into bins of ``capacity`` words. A bin takes at most one item of a
source and one of a cluster of duplicates. Documents over the capacity are cut
into pieces of it and a rest; the pieces conflict with one another.

The documents are dealt by a hash into groups of about ``GROUP_ROWS``, and each
group is packed by itself: items by falling size, each into the bin with the
least room that is enough and with which it has no conflict. Bins stand in
order of their room and carry a bitmap of sources and one of clusters; when the
tightest bin conflicts, the search goes on to its successor until one is
compatible, and only then is a bin opened.

Only (id, source, cluster, size) are shuffled. Rows that agree in all of these
are counted first and dealt out as copies, so no id, source or cluster makes a
group large.

Defined results: null and empty texts have size 0 and take part. A null source
or cluster conflicts with none, except that pieces of one document never share
a bin. Items of one size are taken by id (nulls first), piece and copy. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import col, durable, ship_package
from .copies import dealt

CAPACITY = 2048
GROUP_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def best_fit(items: list[tuple[int, object, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size, source, cluster, document), taken in the given order.

    Bins are numbered as they are opened. Of bins with equal room the first is taken.
    """
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels = 0  # bit r: there are bins with room r
    room: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for size, source, cluster, document in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(("doc", document) if cluster is None else ("cluster", cluster), len(cluster_bit))
        found = -1
        left = levels >> size << size
        while left and found < 0:
            level = (left & -left).bit_length() - 1
            for b in by_room[level]:
                if not (sources[b] & s or clusters[b] & c):
                    found = b
                    break
            left &= left - 1
        if found < 0:
            found = len(room)
            room.append(capacity)
            sources.append(0)
            clusters.append(0)
        else:
            by_room[room[found]].remove(found)
            if not by_room[room[found]]:
                levels &= ~(1 << room[found])
        placed.append((found, capacity - room[found]))
        room[found] -= size
        sources[found] |= s
        clusters[found] |= c
        insort(by_room[room[found]], found)
        levels |= 1 << room[found]
    return placed


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-r["length"], r["id"] is not None, r["id"] or 0, r["piece"], r["copy"], str(r["source"]), r["cluster"] or 0))
        placed = best_fit([(r["length"], r["source"], r["cluster"], (r["id"], r["copy"], r["size"])) for r in rows], capacity)
        kinds = {f.name: f.type for f in table.schema}
        return pa.table(
            {
                "id": pa.array([r["id"] for r in rows], kinds["id"]),
                "piece": pa.array([r["piece"] for r in rows], pa.int64()),
                "start": pa.array([r["piece"] * capacity for r in rows], pa.int64()),
                "length": pa.array([r["length"] for r in rows], pa.int64()),
                "bin": pa.array([(r["part"] << 32) + b for r, (b, _) in zip(rows, placed, strict=True)], pa.int64()),
                "offset": pa.array([o for _, o in placed], pa.int64()),
            }
        )

    return run


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(id, piece, start, length, bin, offset), in words, of each piece of each row of ``docs``.

    ``cluster``: what duplicates share; by default a hash of the text, null for a null text.
    """
    ship_package(docs.sparkSession)
    text = col(text_col).cast("string")
    rows = durable(
        docs.select(
            col(id_col).cast("long").alias("id"),
            col(source_col).cast("string").alias("source"),
            (F.when(text.isNotNull(), F.xxhash64(text)) if cluster is None else cluster).cast("long").alias("cluster"),
            words_of(text).alias("size"),
        )
        .groupBy("id", "source", "cluster", "size")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = rows.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / capacity)).cast("long")
    items = (
        dealt(rows, "n", "copy")
        .withColumn("part", F.pmod(F.xxhash64("id", "cluster", "size", "copy"), F.lit(groups)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("length", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("long"))
        .select("part", "id", "source", "cluster", "size", "copy", "piece", "length")
    )
    made = items.groupBy("part").applyInArrow(_packed(capacity), "id long, piece long, start long, length long, bin long, offset long")
    return made.select(F.col("id").alias(id_col), "piece", "start", "length", "bin", "offset")
