"""LM scoring by masked pseudo-likelihood.

A bidirectional window network, trained here in numpy, predicts every token from
``SIDE`` tokens on either side. A document's score is the sum of the conditional
log-probabilities of its tokens.

* Vocabulary: words are counted over all documents; the most frequent have an
  id each, in the order of their counts, all others share ``HASHED`` ids. A
  token without its own id costs its id and its spelling (``spelling.py``), so
  each of any number of words has its own conditional probability. As context
  such a word counts by the id it shares.
* Ids: texts are split once, into 16-bit ids that are written and that all later
  steps read; with them what the spelling of each document's rare words costs.
* Network: the embeddings of the tokens around, each scaled by a vector of its
  place in the window, are added up; their sum, through softsign, predicts the
  token's class (id // CLASS), and, shifted by the class's own vector, the token
  within the class. The vocabulary costs 2 x 64 outputs, not 4,096.
* Start: the exact counts of the ids over all documents, so what is learned is how
  context moves a token's probability away from its share of the corpus.
* Training: in each round every partition takes the same start, predicts the
  tokens of each ``rounds``-th batch of its documents, others each round, and
  descends; so every token is a target once. The parameters are then averaged
  over the partitions, weighted by their targets, in blocks and in two steps,
  so that no task gathers more than the square root of the number of partitions.
  What is shuffled grows with the corpus; what reaches the driver, the averaged
  network, does not.
* Scoring: every token of every document, whole, in windows that do not cross
  documents.

Probabilities depend, in their last digits, on how the input is partitioned.

Defined results: a null or empty text has no tokens, log-probability 0 and a
null mean. Null ids are kept, repeated rows each count and get their row, an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col, durable, ship_package
from . import spelling
from .words import coded, runs, text_runs, trimmed

CLASS = 64
VOCABULARY = CLASS * CLASS
HASHED = 1024
SIDE = 2
HIDDEN = 32
ROUNDS = 2
BATCH = 4096
RATE = 0.2
_FIRST = 1e-6  # AdaGrad's sums of squares at the start
BLOCK = 4096
_FLUSH = 500_000
_TEXT_BYTES = 8 << 20  # of text that are split at a time
_TOKENS = 1 << 20  # that are laid out at a time
PAD = VOCABULARY  # the id beyond either end of a document
_PLACES = (*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1))  # where a token's context begins in the line around it


def word_of(raw: str) -> str:
    """What is counted and looked up for a raw word: itself without punctuation, or all of it if it is nothing else."""
    return trimmed(raw) or raw


class Vocabulary:
    """Raw words to ids, and to what their spelling costs; ``words``: the frequent ones, most frequent first."""

    def __init__(self, words: list[str], speller: spelling.Speller | None = None):
        self.frequent, self.speller = {w: i for i, w in enumerate(words)}, speller or spelling.Speller.flat(HASHED)

    def look_up(self, raws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``raws``, and log P(word | its id): 0 for the frequent ones."""
        names = list(map(word_of, raws))
        ids = np.fromiter(map(self.frequent.get, names, repeat(-1)), np.int64, len(names))
        cost = np.zeros(len(names))
        rare = np.flatnonzero(ids < 0)
        cost[rare], bucket = self.speller.in_bucket([names[k] for k in rare.tolist()])
        ids[rare] = VOCABULARY - HASHED + bucket
        return ids.astype(np.int16), cost

    def ids(self, text: str | None) -> np.ndarray:
        return self.look_up((text or "").split())[0]


class WindowNetwork:
    """The network's parameters, its loss and its steps."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        shape = {
            "e": (VOCABULARY + 1, HIDDEN),
            "s": (2 * SIDE, HIDDEN),
            "b": (HIDDEN,),
            "wc": (HIDDEN, CLASS),
            "bc": (CLASS,),
            "c": (CLASS, HIDDEN),
            "wm": (HIDDEN, CLASS),
        }
        self.prior = np.zeros((CLASS, CLASS), np.float32)
        self.p = {k: (rng.standard_normal(s) * 0.1 if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        self.p["s"] += 1
        # one sum of squares for each row of the sparse tables, one for each of the other parameters
        self.g2 = {k: np.full(len(v) if k in "ec" else v.shape, _FIRST, np.float32) for k, v in self.p.items()}

    def start(self, counts: np.ndarray) -> WindowNetwork:
        """Lets the network begin as the distribution of ``counts``, by id, from which context moves it."""
        share = (counts.astype(np.float64) + 0.5).reshape(CLASS, CLASS)
        self.prior = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        self.p["bc"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> WindowNetwork:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def forward(self, line: np.ndarray):
        """log-probabilities of the tokens of ``line`` but SIDE at either end, 0 for PADs; and what a step needs."""
        p, n = self.p, len(line) - 2 * SIDE
        target = line[SIDE : SIDE + n]
        real = target != PAD
        x = p["e"].take(line, axis=0)
        z = np.tile(p["b"], (n, 1))
        for k, at in enumerate(_PLACES):
            z += x[at : at + n] * p["s"][k]
        h = _softsign(z)
        cls, member = np.divmod(np.where(real, target, 0), CLASS)
        lc, ec = _log_softmax_at(h @ p["wc"] + p["bc"], cls)
        z += p["c"].take(cls, axis=0)
        h2 = _softsign(z)
        lm, em = _log_softmax_at(h2 @ p["wm"] + self.prior.take(cls, axis=0), member)
        return np.where(real, lc + lm, 0), (x, h, h2, ec, em, cls, member, real)

    def step(self, line: np.ndarray, rate: float = RATE) -> float:
        """One AdaGrad step on the mean loss over the tokens that ``forward`` predicts; returns it."""
        p = self.p
        logp, (x, h, h2, (dc, of_c), (dm, of_m), cls, member, real) = self.forward(line)
        each, n = np.arange(len(real)), max(1, int(real.sum()))
        weight = (real / np.float32(n)).astype(dc.dtype)
        dc *= (weight / of_c)[:, None]
        dm *= (weight / of_m)[:, None]
        dc[each, cls] -= weight
        dm[each, member] -= weight
        dz2 = (dm @ p["wm"].T) * _softsign_slope(h2)
        dz = (dc @ p["wc"].T) * _softsign_slope(h) + dz2
        dx = np.zeros_like(x)
        ds = np.empty_like(p["s"])
        for k, at in enumerate(_PLACES):
            ds[k] = np.einsum("ij,ij->j", dz, x[at : at + len(dz)])
            dx[at : at + len(dz)] += dz * p["s"][k]
        for k, g in (("wc", h.T @ dc), ("bc", dc.sum(0)), ("wm", h2.T @ dm), ("b", dz.sum(0)), ("s", ds)):
            self._move(k, g, rate)
        self._move_rows("c", *_row_sums(cls, dz2), rate)
        self._move_rows("e", *_row_sums(line, dx), rate)
        return float(-logp.sum() / n)

    def _move(self, k: str, g: np.ndarray, rate: float) -> None:
        self.g2[k] += g * g
        self.p[k] -= rate * g / np.sqrt(self.g2[k])

    def _move_rows(self, k: str, at: np.ndarray, g: np.ndarray, rate: float) -> None:
        squares = self.g2[k][at] + np.einsum("ij,ij->i", g, g) / HIDDEN
        self.g2[k][at] = squares
        g *= (rate / np.sqrt(squares))[:, None]
        self.p[k][at] -= g


def _softsign(z: np.ndarray) -> np.ndarray:
    return z / (1 + np.abs(z))


def _softsign_slope(h: np.ndarray) -> np.ndarray:
    return (1 - np.abs(h)) ** 2


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The log-probability of one entry of each row of scores; the rows' exponentials, in place of ``x``, and their sums."""
    if np.abs(x).max() > 60:  # beyond this, sums could leave the range of single precision
        x -= x.max(axis=1, keepdims=True)
    chosen = x[np.arange(len(at)), at]
    e = np.exp(x, out=x)
    sums = e @ np.ones(CLASS, e.dtype)
    return chosen - np.log(sums), (e, sums)


def _row_sums(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of ``at`` and, for each, the sum of its rows of ``g``."""
    order = np.argsort(at.astype(np.int16), kind="stable")  # ids fit, and short numbers are sorted by radix
    at = at.take(order)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first].astype(np.int64), np.add.reduceat(g.take(order, axis=0), first, axis=0)


def windows(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' ids in one row, ``SIDE`` PADs around each, and the positions of their tokens."""
    line = np.full(len(ids) + SIDE * (len(lengths) + 1), PAD, np.int16)
    at = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(lengths)), lengths))
    line[at] = ids
    return line, at


def batches_of(line: np.ndarray) -> Iterator[np.ndarray]:
    """``line`` in parts of ``BATCH`` tokens, with the ``SIDE`` at either end of each that are only context."""
    for k in range(0, len(line) - 2 * SIDE, BATCH):
        yield line[k : k + BATCH + 2 * SIDE]


def log_probabilities(net: WindowNetwork, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pseudo-log-likelihood of each document; ``ids``: those of all documents, one after the other."""
    line, at = windows(ids, lengths)
    each = [net.forward(part)[0] for part in batches_of(line)]
    sums = np.concatenate(([0.0], np.cumsum(np.concatenate(each)[at - SIDE], dtype=np.float64))) if len(at) else np.zeros(1)
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        made: Counter = Counter()
        for raw, n in held.items():
            made[word_of(raw)] += n
        held.clear()
        return pa.RecordBatch.from_pydict({"w": pa.array(list(made), pa.string()), "n": pa.array(list(made.values()), pa.int64())})

    for batch in batches:
        for texts in text_runs(batch.column(0), _TEXT_BYTES):
            raws, codes, _ = coded(texts)
            for raw, n in zip(raws, np.bincount(codes, minlength=len(raws)).tolist(), strict=True):
                held[raw] += n
            if len(held) > _FLUSH:
                yield out()
    yield out()


def _most_frequent(table: pa.Table) -> pa.Table:
    """The rows of the largest counts, ties by word, as many as the vocabulary takes."""
    order = pc.sort_indices(table, [("n", "descending"), ("w", "ascending")])
    return table.take(order.slice(0, VOCABULARY - HASHED))


def _most_frequent_of_part(fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = _most_frequent(more if held is None else pa.concat_tables([held, more]))
        if held is not None:
            part = pa.array([TaskContext.get().partitionId() % fan] * held.num_rows, pa.int32())
            yield from held.append_column("part", part).combine_chunks().to_batches()

    return run


def word_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): how often each word of all documents occurs, exactly."""
    counts = docs.select(col(text_col).cast("string").alias("t")).mapInArrow(_word_counts, "w string, n long")
    return counts.groupBy("w").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent words of all documents, most frequent first."""
    return most_frequent(word_sums(docs, text_col))


def most_frequent(sums: DataFrame) -> list[str]:
    """The most frequent of ``sums``, most frequent first.

    They are chosen within each partition of the counts, then among the square
    root of their number of partitions, then of those.
    """
    fan = max(1, math.isqrt(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = "w string, n long, part int"
    near = sums.mapInArrow(_most_frequent_of_part(fan), schema).groupBy("part").applyInArrow(_most_frequent, schema)
    top = near.orderBy(F.desc("n"), "w").limit(VOCABULARY - HASHED)
    return [r[0] for r in top.select("w").collect()]


def trigram_counts(sums: DataFrame, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of bytes of all of ``sums`` but ``words``, and their counts."""
    made = sums.mapInArrow(spelling.counted(words), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return made["k"].to_numpy(), made["n"].to_numpy()


def packed_ids(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary of 16-bit ids for each document."""
    ends = np.concatenate(([0], np.cumsum(lengths) * 2)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<i2"))])


def unpacked_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents, one after the other, and each one's number."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat).view("<i2"), np.diff(ends).astype(np.int64) // 2


def _encoded(words: list[str], speller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(words, speller.value if speller else None)
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(1), _TEXT_BYTES):
                raws, codes, lengths = coded(texts)
                ids, cost = known.look_up(raws)
                upto = np.concatenate(([0.0], np.cumsum(cost[codes])))
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), packed_ids(ids[codes], lengths), pa.array(upto[ends] - upto[ends - lengths])],
                    ["id", "ids", "spelled"],
                )
                at += len(texts)

    return run


def encode(docs: DataFrame, words: list[str], speller=None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, spelled) of each row of ``docs``: its tokens' ids and what their spelling adds to its score.

    ``speller``: a broadcast speller, or none, by which ``spelled`` is 0.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(words, speller), f"id {kind}, ids binary, spelled double")


def _documents(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, lengths) of documents that have about _TOKENS tokens at most."""
    ids, lengths = unpacked_ids(column)
    at = 0
    for a, b in runs(lengths, _TOKENS):
        n = int(lengths[a:b].sum())
        yield ids[at : at + n], lengths[a:b]
        at += n


def learn(net: WindowNetwork, column: pa.Array, offset: int, stride: int) -> int:
    """A step on each ``stride``-th batch of the documents in ``column``, from ``offset`` on; how many targets there were."""
    seen = 0
    for ids, lengths in _documents(column):
        for part in islice(batches_of(windows(ids, lengths)[0]), offset, None, stride):
            net.step(part)
            seen += int((part[SIDE:-SIDE] != PAD).sum())
    return seen


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for ids, _ in _documents(batch.column(0)):
            total += np.bincount(ids, minlength=VOCABULARY)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"k": pa.array(seen), "n": pa.array(total[seen])})


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in all of ``encoded``."""
    made = encoded.select("ids").mapInArrow(_id_counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(VOCABULARY, np.int64)
    counts[made["k"].to_numpy()] = made["n"].to_numpy()
    return counts


def _trained(start, counts: np.ndarray, offset: int, stride: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net = WindowNetwork().start(counts).load(np.frombuffer(start.value, np.float32))
        seen = sum(learn(net, batch.column(0), offset, stride) for batch in batches)
        if seen:
            flat = net.flat()
            part = TaskContext.get().partitionId() % fan
            for k in range(0, len(flat), BLOCK):
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([k // BLOCK], pa.int32()),
                        "part": pa.array([part], pa.int32()),
                        "n": pa.array([float(seen)]),
                        "v": pa.array([flat[k : k + BLOCK].tobytes()], pa.binary()),
                    }
                )

    return run


def _averaged(table: pa.Table) -> pa.Table:
    n = table["n"].to_numpy()
    total = np.zeros(len(table["v"][0].as_py()) // 4)
    for w, v in zip(n, table["v"], strict=True):
        total += w * np.frombuffer(v.as_py(), np.float32)
    return pa.table(
        {
            "block": table["block"].slice(0, 1),
            "part": table["part"].slice(0, 1),
            "n": pa.array([float(n.sum())]),
            "v": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary()),
        }
    )


def train(encoded: DataFrame, counts: np.ndarray, *, rounds: int = ROUNDS) -> np.ndarray:
    """The parameters of a network trained on all of ``encoded``, with each token as the target in one of the rounds."""
    sc = encoded.sparkSession.sparkContext
    rows = encoded.select("ids")
    flat = WindowNetwork().start(counts).flat()
    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    schema = "block int, part int, n double, v binary"
    for k in range(rounds):
        start = sc.broadcast(flat.astype(np.float32).tobytes())
        made = rows.mapInArrow(_trained(start, counts, k, rounds, fan), schema)
        made = made.groupBy("block", "part").applyInArrow(_averaged, schema)
        made = made.groupBy("block").applyInArrow(_averaged, schema)
        blocks = sorted(made.select("block", "v").collect())
        if not blocks:
            break
        flat = np.concatenate([np.frombuffer(v, np.float32) for _, v in blocks])
    return flat


def _scored(params, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = WindowNetwork().start(counts).load(np.frombuffer(params.value, np.float32))
        for batch in batches:
            made = [(lengths, log_probabilities(net, ids, lengths)) for ids, lengths in _documents(batch.column(1))]
            lengths, sums = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0))
            sums = sums + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.array(sums)], ["id", "n_tokens", "log_prob"])

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) of each row of ``docs``, by a network trained on all of them."""
    spark = docs.sparkSession
    ship_package(spark)
    seen = durable(word_sums(docs, text_col))
    words = most_frequent(seen)
    speller = spark.sparkContext.broadcast(spelling.Speller(*trigram_counts(seen, words), words, HASHED))
    encoded = durable(encode(docs, words, speller, id_col=id_col, text_col=text_col))
    counts = id_counts(encoded)
    params = spark.sparkContext.broadcast(train(encoded, counts, rounds=rounds).astype(np.float32).tobytes())
    kind = encoded.schema["id"].dataType.simpleString()
    made = encoded.mapInArrow(_scored(params, counts), f"id {kind}, n_tokens long, log_prob double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return made.select(F.col("id").alias(id_col), "n_tokens", "log_prob", mean.alias("mean_log_prob"))
