"""Toxicity by classifier chains.

The categories are predicted one after the other, each by a linear (logistic)
model over word features and the probabilities of all earlier categories. In
training, those come from out-of-fold models, so a later model learns from
probabilities as good as it will see.

Categories are columns of the labels, a parameter: by default low quality, then
toxic. The last one decides. A category whose column the labels lack is left
out; a label that is null is unknown, and its document does not train that
category's model.

Features are words and their first four and five letters, so that stems with
many endings count as one: for each category's model all that at least
LEAST_DOCS documents hold and whose association (G2) with the category reaches
LEAST_ASSOCIATION; there is no cap on their number. The models are fitted on a bounded sample, ``TRAIN_ROWS``
labelled documents in the order of a hash of their id, which also deals them to
the folds; every document is scored, in whole, without a shuffle.

Defined results: null and empty texts have no features. Null ids are kept,
repeated rows each get their row; a repeated label counts as a category's if any
of it does; labels without the last category or an id are ignored. Of labelled
rows that share an id the text with the least hash trains. With no labelled
document, or one class only, every probability is the class's share, 0 without
labels. Empty tables give empty results. A text column of another type is read
as a string. Other columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..runtime import col, durable, fresh, ship_package
from .words import coded, text_runs, trimmed

TRAIN_ROWS = 10_000
LEAST_DOCS = 4
LEAST_ASSOCIATION = 23.93  # what one in a million features without any association reaches
FOLDS = 3
RIDGE = 0.03
CUT = 0.5
_NONE = (None, None, None)
_TEXT_BYTES = 4 << 20  # of text that are looked through at a time

# (name, column of the labels, the value that means yes); the last decides
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def features(word: str) -> tuple[str, ...]:
    """The features of a raw word."""
    w = trimmed(word)
    if not w:
        return ()
    return (w, *(f"{w[:n]}*" for n in (4, 5) if len(w) > n))


def feature_counts(texts: pa.Array, known: Callable[[str], tuple[int, ...]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of every feature of every text; ``known``: a raw word's features, numbers below ``size``."""
    raws, codes, lengths = coded(texts)
    some = [(k, found) for k, found in enumerate(map(known, raws)) if found]
    counts = np.zeros(len(raws), np.int64)
    counts[[k for k, _ in some]] = [len(found) for _, found in some]
    flat = np.array([i for _, found in some for i in found], np.int64)
    first = np.cumsum(counts) - counts
    held = counts[codes] > 0
    text, codes = np.repeat(np.arange(len(lengths)), lengths)[held], codes[held]
    each = counts[codes]
    at = flat[np.repeat(first[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    key, times = np.unique(np.repeat(text, each) * size + at, return_counts=True)
    return key // size, key % size, times


def _sums(n_categories: int):
    """(feature, for each category the documents that are of it, and those that are not) within the partition, now and then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(0), _TEXT_BYTES):
                labels = np.array([batch.column(1 + k).slice(at, len(texts)).fill_null(-1).to_numpy(zero_copy_only=False) for k in range(n_categories)])
                at += len(texts)
                ids: dict[str, int] = {}
                text, f, _ = feature_counts(texts, lambda raw, ids=ids: tuple(ids.setdefault(x, len(ids)) for x in features(raw)), 1 << 32)
                cols = [pa.array(np.bincount(f[y[text] == v], minlength=len(ids))) for y in labels for v in (1, 0)]
                names = [f"{c}{k}" for k in range(n_categories) for c in ("pos", "neg")]
                yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), *cols], ["f", *names])

    return run


def association(pos: float, neg: float, all_pos: float, all_neg: float) -> float:
    """The log-likelihood ratio (G2) of a feature's and a class's documents."""
    n = all_pos + all_neg
    g = 0.0
    for seen, f, c in (
        (pos, pos + neg, all_pos),
        (neg, pos + neg, all_neg),
        (all_pos - pos, n - pos - neg, all_pos),
        (all_neg - neg, n - pos - neg, all_neg),
    ):
        if seen > 0:
            g += seen * math.log(seen * n / (f * c))
    return 2 * g


def _association_column(pos: Column, neg: Column, all_pos: int, all_neg: int) -> Column:
    n = float(all_pos + all_neg)
    f = pos + neg
    terms = [(pos, f, float(all_pos)), (neg, f, float(all_neg)), (all_pos - pos, n - f, float(all_pos)), (all_neg - neg, n - f, float(all_neg))]
    total = F.lit(0.0)
    for seen, a, c in terms:
        total = total + F.when(seen > 0, seen * F.log(seen * n / (a * c))).otherwise(0.0)
    return 2 * total


class Sparse:
    """A matrix by its entries, with dense columns behind the sparse ones."""

    def __init__(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, shape: tuple[int, int], dense: np.ndarray | None = None):
        """``row`` must rise."""
        self.row, self.at, self.value, (self.rows, self.columns) = row, at, value.astype(float), shape
        self.dense = np.zeros((self.rows, 0)) if dense is None else dense

    @classmethod
    def of(cls, x: np.ndarray) -> Sparse:
        row, at = np.nonzero(x)
        return cls(row, at, x[row, at], x.shape)

    @property
    def width(self) -> int:
        return self.columns + self.dense.shape[1]

    def wider(self, column: np.ndarray) -> Sparse:
        return Sparse(self.row, self.at, self.value, (self.rows, self.columns), np.hstack((self.dense, column[:, None])))

    def of_columns(self, keep: np.ndarray) -> Sparse:
        """The same columns, of which only some have entries."""
        held = keep[self.at]
        return Sparse(self.row[held], self.at[held], self.value[held], (self.rows, self.columns), self.dense)

    def of_rows(self, keep: np.ndarray) -> Sparse:
        place = np.cumsum(keep) - 1
        held = keep[self.row]
        return Sparse(place[self.row[held]], self.at[held], self.value[held], (int(keep.sum()), self.columns), self.dense[keep])

    @cached_property
    def by_row(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have entries, and where those begin."""
        return _begins(self.row)

    @cached_property
    def by_column(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows and values in the order of the columns, the columns that have entries, and where those begin."""
        order = np.argsort(self.at, kind="stable")
        return self.row[order], self.value[order], *_begins(self.at[order])

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        rows, first = self.by_row
        if len(rows):
            out[rows] = np.add.reduceat(self.value * w.take(self.at), first)
        return out + self.dense @ w[self.columns :]

    def transposed_times(self, u: np.ndarray, squared: bool = False) -> np.ndarray:
        out = np.zeros(self.columns)
        row, value, columns, first = self.by_column
        if len(columns):
            out[columns] = np.add.reduceat((value * value if squared else value) * u.take(row), first)
        return np.concatenate((out, (self.dense**2 if squared else self.dense).T @ u))


def _begins(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[first], first


def fit_logistic(x: Sparse, y: np.ndarray, ridge: float = RIDGE, rounds: int = 16, start: np.ndarray | None = None, near: float = 3e-3) -> np.ndarray:
    """Weights, the bias last, of ridge logistic regression; the bias is not shrunk.

    Newton's method, whose steps are found by conjugate gradients, so nothing is
    as large as the square of the number of features. It ends when no weight
    moves by ``near``.
    """
    shrink = np.full(x.width + 1, ridge)
    shrink[-1] = 1e-6
    if start is None:
        w = np.zeros(x.width + 1)
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        w[-1] = math.log(rate / (1 - rate))
    else:
        w = start.copy()
    back = lambda u: np.append(x.transposed_times(u), u.sum())
    for _ in range(rounds):
        p = sigmoid(x.times(w[:-1]) + w[-1])
        grad = back(p - y) + shrink * w
        d = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros(len(w)), grad.copy()
        scale = 1 / (np.append(x.transposed_times(d, True), d.sum()) + shrink)
        z = scale * r
        q, rz = z.copy(), r @ z
        goal = 0.03 * math.sqrt(rz) if rz > 0 else 0.0
        for _ in range(30):
            if math.sqrt(max(0.0, rz)) <= goal:
                break
            hq = back(d * (x.times(q[:-1]) + q[-1])) + shrink * q
            a = rz / (q @ hq)
            step += a * q
            r -= a * hq
            z = scale * r
            rz, before = r @ z, rz
            q = z + rz / before * q
        most = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(1e-9, most))
        if most < near:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Chain:
    """Linear models in sequence; model k sees the features and the k earlier probabilities."""

    def __init__(self, names: list[str], weights: list[np.ndarray], categories: tuple[str, ...]):
        self.names, self.weights, self.categories = names, weights, categories
        self.at = {f: i for i, f in enumerate(names)}

    @classmethod
    def fit(cls, names: list[str], x: Sparse, labels: np.ndarray, fold: np.ndarray, categories: tuple[str, ...], uses: np.ndarray | None = None) -> Chain:
        """``labels``: a column for each category, 1, 0 or, where it is unknown, -1; ``fold``: each row's.

        ``uses``: for each category the features that its model may use; all, if it is None.
        """
        weights, before = [], x
        for k in range(labels.shape[1]):
            y = labels[:, k]
            seen = before if uses is None else before.of_columns(uses[k])
            weights.append(_fitted(seen, y, y >= 0, None))
            out = np.zeros(x.rows)
            for f in np.unique(fold):
                w = _fitted(seen, y, (y >= 0) & (fold != f), weights[-1])
                mine = fold == f
                out[mine] = sigmoid(seen.of_rows(mine).times(w[:-1]) + w[-1])
            before = before.wider(out)
        return cls(names, weights, categories)

    def probabilities(self, text: np.ndarray, at: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """(n, categories): of every category for each of ``n`` texts, from their features' counts."""
        x = Sparse(text, at, np.log1p(times), (n, len(self.names)))
        for w in self.weights:
            x = x.wider(sigmoid(x.times(w[:-1]) + w[-1]))
        return x.dense

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        return self.probabilities(*feature_counts(texts, self.known, len(self.names) + 1), len(texts))

    def known(self, word: str) -> tuple[int, ...]:
        """The numbers of the features of a raw word; ``features`` says which there are."""
        w, get = trimmed(word), self.at.get
        found = (get(w), get(w[:4] + "*") if len(w) > 4 else None, get(w[:5] + "*") if len(w) > 5 else None)
        return () if found == _NONE else tuple(i for i in found if i is not None)


def _fitted(x: Sparse, y: np.ndarray, use: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    some = y[use].astype(float)
    if len(some) and 0 < some.sum() < len(some):
        return fit_logistic(x.of_rows(use), some, rounds=16 if start is None else 8, start=start)
    return constant(x.width, some)


def constant(n: int, y: np.ndarray) -> np.ndarray:
    w = np.zeros(n + 1)
    rate = float(y.mean()) if len(y) else 0.0
    w[-1] = 40.0 if rate >= 1 else -40.0 if rate <= 0 else math.log(rate / (1 - rate))
    return w


def _counted(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chain(names, [], ()).known
        for batch in batches:
            first = 0
            for texts in text_runs(batch.column(0), _TEXT_BYTES):
                text, at, times = feature_counts(texts, known, len(names) + 1)
                ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (at, times)]
                kept = [batch.column(k).slice(first, len(texts)) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, *lists], [*batch.schema.names[1:], "at", "n"])
                first += len(texts)

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[tuple[str, str, object], ...] = CATEGORIES,
    train_rows: int = TRAIN_ROWS,
    folds: int = FOLDS,
) -> Chain:
    """Fit a chain on at most ``train_rows`` labelled documents."""
    ship_package(docs.sparkSession)
    used = [c for c in categories if c[1] in labels.columns]
    names = tuple(c[0] for c in used)
    of = lambda c: F.max((col(c[1]) == F.lit(c[2])).cast("int"))  # noqa: E731  null where all labels are
    wanted = (
        labels.where(col(used[-1][1]).isNotNull() & col(id_col).isNotNull())
        .groupBy(col(id_col).alias("id"))
        .agg(*(of(c).alias(f"y{k}") for k, c in enumerate(used)))
        .orderBy(F.xxhash64("id"), "id")
        .limit(train_rows)
    )
    ys = [f"y{k}" for k in range(len(used))]
    # at most train_rows narrow rows are broadcast
    rows = durable(
        docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
        .join(F.broadcast(durable(wanted)), "id")
        .groupBy("id", *ys)
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("text", *ys, F.xxhash64("id").alias("order"), F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold"))
    )
    totals = rows.agg(*(f(F.col(y) == v) for y in ys for f, v in ((F.count_if, 1), (F.count_if, 0)))).first()
    counts = [f"{c}{k}" for k in range(len(ys)) for c in ("pos", "neg")]
    sums = (
        rows.select("text", *ys)
        .mapInArrow(_sums(len(ys)), "f string, " + ", ".join(f"{c} long" for c in counts))
        .groupBy("f")
        .agg(*(F.sum(c).alias(c) for c in counts))
    )
    pairs = [(F.col(f"pos{k}"), F.col(f"neg{k}"), totals[2 * k], totals[2 * k + 1]) for k in range(len(ys))]
    held_by = F.col(f"pos{len(ys) - 1}") + F.col(f"neg{len(ys) - 1}")
    reach = [_association_column(*p) >= LEAST_ASSOCIATION for p in pairs]
    # the sample bounds the features, as it bounds the words
    kept = sums.where(held_by >= LEAST_DOCS).select("f", F.array(*reach).alias("uses")).where(F.array_contains("uses", True)).orderBy("f").collect()
    found = [r["f"] for r in kept]
    uses = np.array([[bool(u) for u in r["uses"]] for r in kept], bool).reshape(len(found), len(ys)).T
    schema = ", ".join(f"{y} int" for y in ys) + ", order long, fold int, at array<int>, n array<int>"
    drawn = sorted(rows.mapInArrow(_counted(found), schema).collect(), key=lambda r: r["order"])
    y = np.array([[-1 if r[c] is None else r[c] for c in ys] for r in drawn]).reshape(len(drawn), len(ys))
    row = np.repeat(np.arange(len(drawn)), [len(r["at"]) for r in drawn])
    at, n = (np.array([v for r in drawn for v in r[c]], np.int64) for c in ("at", "n"))
    x = Sparse(row, at, np.log1p(n), (len(drawn), len(found)))
    return Chain.fit(found, x, y, np.array([r["fold"] for r in drawn], int), names, uses)


def _scored(model: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(1), _TEXT_BYTES):
                p = model.of_texts(texts)
                cols = [pa.array(p[:, k]) for k in range(len(model.categories))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *cols], ["id", *(f"p_{c}" for c in model.categories)])
                at += len(texts)

    return run


def score(docs: DataFrame, model: Chain, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, toxic, a probability p_<category> for each category) of each row of ``docs``."""
    ship_package(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_scored(model), f"id {kind}, " + ", ".join(f"p_{c} double" for c in model.categories))
    last = f"p_{model.categories[-1]}"
    return made.select(F.col("id").alias(id_col), (F.col(last) >= cut).alias("toxic"), *(f"p_{c}" for c in model.categories))


def _kept(model: Chain, at: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = [model.of_texts(texts)[:, -1] < cut for texts in text_runs(batch.column(at), _TEXT_BYTES)]
            yield batch.filter(pa.array(np.concatenate([*stay, np.zeros(0, bool)])))

    return run


def drop_toxic(docs: DataFrame, model: Chain, *, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject; no shuffle."""
    ship_package(docs.sparkSession)
    if isinstance(docs.schema[text_col].dataType, StringType):
        return docs.mapInArrow(_kept(model, docs.columns.index(text_col), cut), docs.schema)
    held = docs.withColumn(fresh(docs, "qw_text"), col(text_col).cast("string"))
    return held.mapInArrow(_kept(model, len(docs.columns), cut), held.schema).drop(held.columns[-1])
