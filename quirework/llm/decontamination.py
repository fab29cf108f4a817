"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; only positions with a 1 are
hashed, so a substitution at an ignored position leaves the hash as it is. The
masked hashes of the documents are joined with those of the benchmark. Around
each hit the two texts are laid over each other and compared token by token: a
document is contaminated by an item if some stretch of at least
``min(tokens of the item, LEAST)`` tokens agrees in at least ``SHARE`` of them,
or if ``VERBATIM`` tokens in a row agree. So an item of n tokens, up to LEAST,
may have n / 5 of them substituted, from 5 tokens on one; shorter items must
occur as they are. The masks of an item depend on its length and leave no
pattern of substitutions in such a stretch without a hit (tests try all up to 20
tokens); longer stretches hold several chances.

The benchmark is taken in blocks of bounded bytes, each sent to the executors
once; a benchmark beyond one block means more passes over the documents, not a
larger broadcast. Each worker process builds a block's index once. The documents
are not shuffled, and each is decided whole within its task. Tokens that agree
are counted for all hits of a slice of documents at a time, in bounded pieces,
so a seed that many items share costs comparisons in numpy; only hits with
enough of them are looked into one by one.

Tokens are the words between white space, lower-cased, without punctuation at
either end; words of punctuation alone are none.

Defined results: null and empty texts and items have no tokens and match
nothing. Repeated items and rows each count. Null ids are kept, ids of items may
have any type. A text column of another type is read as a string. Empty tables
give empty results. Other columns are ignored by ``contaminated`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from ..runtime import col, fresh, ship_package
from .words import Memo, coded, runs, text_runs, trimmed

# The masks and the number of tokens from which on items have them, until the next entry's. A shorter
# item has more of fewer tokens, as it leaves less room; one below the first entry is its own seed.
MASKS = (
    (5, ("1111", "11011", "10111", "11101")),
    (10, ("1111", "110101", "1011001", "1100101")),
    (12, ("11111", "1110101", "1101011", "1011000101")),
)
LEAST = 20
VERBATIM = 13
SHARE = 0.8
BLOCK_BYTES = 8 << 20
_TEXT_BYTES = 4 << 20  # of text that are looked through at a time
_COMPARED = 1 << 20  # tokens that are laid over each other at a time
_ODD = 0x9E3779B97F4A7C15


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` tokens."""
    found: tuple[str, ...] = ("1" * n,) if n else ()
    for least, masks in MASKS:
        if n >= least:
            found = masks
    return found


class SeedIndex:
    """The masked hashes of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], least: int = LEAST, share: float = SHARE, verbatim: int | None = VERBATIM):
        self.least, self.share, self.verbatim = least, share, verbatim
        known: dict[str, int] = {}
        self.names, self.items = [], []
        for name, text in items:
            toks = [t for t in map(trimmed, (text or "").split()) if t]
            self.names.append(name)
            self.items.append(np.array([known.setdefault(t, len(known) + 1) for t in toks], np.int64))
        # the ids of the benchmark's tokens: 0 for other tokens, -1 for none
        self.ids = Memo(lambda word: known.get(t, 0) if (t := trimmed(word)) else -1)
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*self.items, np.zeros(0, np.int64)])
        need = np.minimum(self.sizes, least)
        self.shortest = need if verbatim is None else np.minimum(need, verbatim)
        self.fewest = np.ceil(need * share - 1e-9)
        if verbatim is not None:
            self.fewest = np.minimum(self.fewest, verbatim)
        by_mask: dict[str, list[int]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            for mask in masks_of(n):
                by_mask.setdefault(mask, []).append(i)
        self.seeds = []
        for mask, of in by_mask.items():
            at = [k for k, c in enumerate(mask) if c == "1"]
            keys = np.concatenate([masked(self.items[i], at, len(mask)) for i in of])
            counts = [len(self.items[i]) - len(mask) + 1 for i in of]
            item = np.repeat(of, counts)
            pos = np.concatenate([np.arange(n) for n in counts])
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << 16, bool)
            table[keys >> np.uint64(48)] = True
            self.seeds.append((at, len(mask), keys[order], item[order], pos[order], table))
        self.gap = max([s for _, s, *_ in self.seeds], default=1)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts' tokens, one after the other, and each text's number of tokens."""
        raws, codes, lengths = coded(texts)
        ids = np.array([self.ids[r] for r in raws], np.int64)[codes]
        real = ids >= 0
        upto, ends = np.concatenate(([0], np.cumsum(real))), np.cumsum(lengths)
        return ids[real], upto[ends] - upto[ends - lengths]

    def hits(self, line: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, place of the item's first token in the line) of every seed that a document shares with an item, each once."""
        docs, items, places = [], [], []
        for at, span, keys, item, pos, table in self.seeds:
            n = len(line) - span + 1
            if n <= 0:
                continue
            where = np.flatnonzero(np.logical_and.reduce([line[a : a + n] > 0 for a in at]))
            h = hashed(line, at, where)
            near = table[h >> np.uint64(48)]
            h, where = h[near], where[near]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            met = hi > lo
            lo, counts, where = lo[met], (hi - lo)[met], where[met]
            each = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            docs.append(np.repeat(np.searchsorted(starts, where, "right") - 1, counts))
            items.append(item[each])
            places.append(np.repeat(where, counts) - pos[each])
        if not docs:
            return (np.zeros(0, np.int64),) * 3
        d, i, p = map(np.concatenate, (docs, items, places))
        order = np.lexsort((p, i, d))
        d, i, p = d[order], i[order], p[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1])
        return d[new], i[new], p[new]

    def overlap(self, same: np.ndarray, need: int) -> tuple[int, int, int] | None:
        """(matched, start, length) of the best stretch of ``same`` that is long enough."""
        if len(same) >= need:
            score = np.concatenate(([0.0], np.cumsum(same - self.share)))
            gain = score[need:] - np.minimum.accumulate(score)[: len(score) - need]
            if gain.max() >= -1e-9:
                end = int(gain.argmax()) + need
                start = int(score[: end - need + 1].argmin())
                return int(same[start:end].sum()), start, end - start
        return _verbatim(same, self.verbatim)

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, doc start, item start, length, matched): the best stretch of each text for each item, by number."""
        ids, lengths = self.tokens(texts)
        # the texts in one line, with room between them that no seed spans
        starts = np.cumsum(lengths) - lengths + self.gap * (1 + np.arange(len(lengths)))
        line = np.zeros(len(ids) + self.gap * (len(lengths) + 1), np.int64)
        line[np.arange(len(ids)) + self.gap * (1 + np.repeat(np.arange(len(lengths)), lengths))] = ids
        d, i, p = self.hits(line, starts)
        a = np.maximum(0, starts[d] - p)
        n = np.minimum(self.sizes[i], starts[d] + lengths[d] - p) - a
        long = n >= self.shortest[i]
        d, i, p, a, n = d[long], i[long], p[long], a[long], n[long]
        best: dict[tuple[int, int], tuple] = {}
        for k, e in runs(n, _COMPARED):
            upto = np.cumsum(n[k:e])
            step = np.arange(upto[-1]) - np.repeat(upto - n[k:e], n[k:e])
            same = self.flat[np.repeat(self.first[i[k:e]] + a[k:e], n[k:e]) + step] == line[np.repeat(p[k:e] + a[k:e], n[k:e]) + step]
            enough = np.add.reduceat(same, upto - n[k:e], dtype=np.int64) >= self.fewest[i[k:e]]
            for j in np.flatnonzero(enough).tolist():
                x = k + j
                m = self.overlap(same[upto[j] - n[x] : upto[j]], min(int(self.sizes[i[x]]), self.least))
                if m:
                    matched, start, length = m
                    row = (matched, int(p[x] + a[x] - starts[d[x]]) + start, int(a[x]) + start, length)
                    key = (int(d[x]), int(i[x]))
                    if key not in best or row > best[key]:
                        best[key] = row
        return [(*key, ds, s, n, m) for key, (m, ds, s, n) in sorted(best.items())]

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, doc start, item start, length, matched) of one text."""
        return [(self.names[i], *row) for _, i, *row in self.find(pa.array([text], pa.string()))]


def _verbatim(same: np.ndarray, least: int | None) -> tuple[int, int, int] | None:
    """The longest run of equal tokens, if it is long enough, as ``overlap`` gives it."""
    if least is None:
        return None
    ends = np.flatnonzero(~np.concatenate(([False], same, [False])))
    lengths = np.diff(ends) - 1
    k = int(lengths.argmax())
    return (int(lengths[k]), int(ends[k]), int(lengths[k])) if lengths[k] >= least else None


def hashed(x: np.ndarray, at: list[int], where: np.ndarray) -> np.ndarray:
    h = np.zeros(len(where), np.uint64)
    for a in at:
        h = (h + x[where + a].astype(np.uint64)) * np.uint64(_ODD)
        h ^= h >> np.uint64(29)
    return h * np.uint64(_ODD)


def masked(x: np.ndarray, at: list[int], span: int) -> np.ndarray:
    return hashed(x, at, np.arange(len(x) - span + 1))


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in lists of at most ``block_bytes`` of text, or one item if it is longer."""
    block, size = [], 0
    for name, text in benchmark.select(col(id_col), col(text_col).cast("string")).toLocalIterator():
        more = len((text or "").encode())
        if block and size + more > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += more
    if block:
        yield block


_INDEXES: dict[str, SeedIndex] = {}


def _index(name: str, shared) -> SeedIndex:
    """The index of a block, made once for each worker process; one is held at a time."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = SeedIndex(shared.value)
    return _INDEXES[name]


def _matching(name: str, shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(1), _TEXT_BYTES):
                row, item, *rest = list(zip(*index.find(texts), strict=True)) or [[]] * 6
                ids = batch.column(0).slice(at, len(texts)).take(pa.array(row, pa.int64()))
                items = pa.array([index.names[i] for i in item], item_type)
                yield pa.RecordBatch.from_arrays(
                    [ids, items, *(pa.array(c, pa.int64()) for c in rest)], ["id", "item_id", "doc_start", "item_start", "length", "matched"]
                )
                at += len(texts)

    return run


def _clean(name: str, shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch in batches:
            stay, first = np.ones(batch.num_rows, bool), 0
            for texts in text_runs(batch.column(at), _TEXT_BYTES):
                stay[[first + row for row, *_ in index.find(texts)]] = False
                first += len(texts)
            yield batch.filter(pa.array(stay))

    return run


def _sent(spark, block: list[tuple]) -> tuple:
    return uuid.uuid4().hex, spark.sparkContext.broadcast(block)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item id, doc_start, item_start, length, matched), in tokens, of each contaminated document and item."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"id {kind}, item_id {item_kind.simpleString()}, doc_start long, item_start long, length long, matched long"
    out = None
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        part = rows.mapInArrow(_matching(*_sent(spark, block), to_arrow_type(item_kind)), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "doc_start", "item_start", "length", "matched")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates; no shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    kept = docs
    if not isinstance(docs.schema[text_col].dataType, StringType):
        kept = docs.withColumn(fresh(docs, "qw_text"), col(text_col).cast("string"))
    at = docs.columns.index(text_col) if kept is docs else len(docs.columns)
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        kept = kept.mapInArrow(_clean(*_sent(spark, block), at), kept.schema)
    return kept if len(kept.columns) == len(docs.columns) else kept.drop(kept.columns[-1])
