"""Near duplicates by SimHash: a tiled, exact comparison of all fingerprints.

Each text's 64-bit fingerprint is the majority, bit by bit, of the hashes of its
shingles. Equal fingerprints are one. The distinct ones are sorted into cells by
the population counts of their two halves, and the cells cut into tiles. A pair
of tiles is skipped if the ranges of its counts are further apart than the
radius, as two fingerprints differ in at least as many bits as their counts do.
All other pairs are compared whole, with numpy's exclusive-or and bit counts.

Each pair of tiles returns a star for each of its linked groups, not the links,
so a group of n near copies costs n rows for each pair of tiles. Components are
found by distributed star contraction. What reaches the driver are the sizes of
the cells (at most 33 x 33) and, from them, the tiles' ranges; the pairs of
tiles are made and chosen in executors.

The comparison is quadratic in the number of distinct fingerprints; the tiles
grow with it, up to ``TILE_MOST``, to hold down what is shuffled.

Defined results: a null or blank text has no words and the fingerprint 0, linked
like any other. Fewer words than a shingle has are one shingle. Rows with a null
id take part; a component's id is the least that is not null. Repeated rows each
get their row. An empty table gives an empty result. Other columns are ignored
by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import col, durable, fresh, ship_package
from .components import components

WORDS = 4
RADIUS = 4
SEED = 42
TILES = 64
TILE_LEAST, TILE_MOST = 1024, 65536
PAIRS_PER_TASK = 16
ROWS = 256
_BLOCK = 1 << 18  # comparisons at a time: a buffer of 2 MB


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of ``text``; bytes.split takes exactly the white space meant here."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return 0
    joined = b" ".join(toks)
    n = max(1, len(toks) - words + 1)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    first = np.concatenate(([0], gaps + 1))[:n]
    last = np.concatenate((gaps, [len(joined)]))[-n:]
    hash_of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        pairs = zip(first[k : k + (1 << 16)].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)
        h = np.array([hash_of(joined[a:b], seed) for a, b in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            fp = pa.array(np.array(made, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(words, seed), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _counts(x: np.ndarray) -> np.ndarray:
    """The population counts of the four quarters of each fingerprint."""
    return np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16)


class _Rows:
    """A tile's rows, sorted by the counts of their quarters, in blocks with the ranges of these counts."""

    def __init__(self, x: np.ndarray):
        counts = _counts(np.ascontiguousarray(x))
        self.order = np.lexsort((counts[:, 3], counts[:, 1], counts[:, 2], counts[:, 0]))
        self.x = x[self.order]
        counts = counts[self.order]
        self.starts = np.arange(0, len(x), ROWS)
        self.low = np.minimum.reduceat(counts, self.starts, axis=0)
        self.high = np.maximum.reduceat(counts, self.starts, axis=0)


def star_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what links of at most ``radius`` bits within ``a`` and ``b`` connect.

    Blocks of rows are skipped as tiles are, by the counts of the quarters.
    """
    left = _Rows(a)
    right = left if same else _Rows(b)
    nodes = left.x if same else np.concatenate((left.x, right.x))
    off = 0 if same else len(a)
    label = np.arange(len(nodes))
    for k, start in enumerate(left.starts):
        apart = np.maximum(0, np.maximum(right.low - left.high[k], left.low[k] - right.high)).sum(axis=1)
        near = np.flatnonzero(apart <= radius)
        if same:
            near = near[near >= k]
        rows = left.x[start : start + ROWS]
        for n in range(0, len(near), _BLOCK // (ROWS * ROWS)):
            part = near[n : n + _BLOCK // (ROWS * ROWS)]
            cols = (right.starts[part][:, None] + np.arange(ROWS)).ravel()
            cols = cols[cols < len(right.x)]
            hit = np.bitwise_count(rows[:, None] ^ right.x[cols][None, :]) <= radius
            if not hit.any():
                continue
            r, c = np.nonzero(hit)
            r, c = r + start, cols[c] + off
            r, c = r[r != c], c[r != c]
            while len(r):
                x, y = label[r], label[c]
                differ = x != y
                if not differ.any():
                    break
                r, c, x, y = r[differ], c[differ], x[differ], y[differ]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(label, up := label[label]):
                    label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        fps = table["fps"].combine_chunks()
        order = np.argsort(table["tile"].to_numpy(), kind="stable")
        tiles = [fps[int(i)].values.to_numpy(zero_copy_only=False).view(np.uint64) for i in order]
        u, v = star_links(tiles[0], tiles[-1], radius, len(tiles) == 1)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def plan_tiles(cells: list[tuple[int, int, int]], size: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Cells (low, high, n) of population counts to tiles of about ``size`` rows.

    Returns for each cell (low, high, first tile, number of tiles), and for each
    tile its ranges (low from, low to, high from, high to).
    """
    placed, tiles, room = [], [], 0
    for low, high, n in sorted(cells):
        if n > size:
            k = -(-n // size)
            placed.append((low, high, len(tiles), k))
            tiles += [(low, low, high, high)] * k
            room = 0
        elif n <= room:
            a, b, c, d = tiles[-1]
            tiles[-1] = (a, max(b, low), min(c, high), max(d, high))
            placed.append((low, high, len(tiles) - 1, 1))
            room -= n
        else:
            placed.append((low, high, len(tiles), 1))
            tiles.append((low, low, high, high))
            room = size - n
    return placed, tiles


def tile_pairs(spark: SparkSession, tiles: list[tuple[int, int, int, int]], radius: int) -> DataFrame:
    """(i, j), i <= j: pairs of tiles whose population counts are not further apart than the radius.

    Tiles stand in the order of their low counts, so those near enough by these
    are a run that starts with the tile itself.
    """
    names = "low_from", "low_to", "high_from", "high_to"
    lows = [t[0] for t in tiles]
    made = [(k, bisect_right(lows, t[1] + radius) - 1, *t) for k, t in enumerate(tiles)]
    left = spark.createDataFrame(made, "i long, last long, " + ", ".join(f"{n} int" for n in names))
    right = left.select(F.col("i").alias("j"), *(F.col(n).alias(f"{n}_j") for n in names))

    def apart(side: str):
        return F.greatest(
            F.lit(0), F.col(f"{side}_from_j") - F.col(f"{side}_to"), F.col(f"{side}_from") - F.col(f"{side}_to_j")
        )

    return (
        left.withColumn("j", F.explode(F.sequence("i", "last")))
        .join(right, "j")
        .where(apart("low") + apart("high") <= radius)
        .select("i", "j")
    )


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): stars over the distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    spark = distinct.sparkSession
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    counted = distinct.select("fp", low.cast("int").alias("low"), high.cast("int").alias("high"))
    cells = [tuple(r) for r in counted.groupBy("low", "high").count().collect()]
    size = min(TILE_MOST, max(TILE_LEAST, sum(n for *_, n in cells) // TILES))
    placed, tiles = plan_tiles(cells, size)
    pairs = durable(tile_pairs(spark, tiles, radius))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS_PER_TASK))
    # at most 33 x 33 rows
    where = F.broadcast(spark.createDataFrame(placed, "low int, high int, first int, k int"))
    packed = durable(
        counted.join(where, ["low", "high"])
        .groupBy((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("k"))).alias("tile"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    return (
        pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
        .join(packed, "tile")
        # by number, as pairs cost time rather than bytes and must not be put together by size
        .repartition(tasks, "i", "j")
        .groupBy("i", "j")
        .applyInArrow(_compare(radius), "u long, v long")
    )


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """(id, fingerprint, component_id) of each row of ``docs``."""
    rows = durable(fingerprints(docs, id_col, text_col, words))
    distinct = durable(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct, radius))
    rooted = durable(
        distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
    )
    # written first: the join then is one of two tables, which Spark can split where a component has many rows
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = durable(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is their component's.

    Rows that share an id are one document and stay or go together; rows without
    an id stay if their whole component has none.
    """
    marked = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, radius=radius)
    mine = fresh(docs, "qw_keep")
    keep = marked.where(col(id_col).eqNullSafe(F.col("component_id"))).select(col(id_col).alias(mine)).distinct()
    return docs.join(keep, col(id_col).eqNullSafe(col(mine)), "left_semi")
