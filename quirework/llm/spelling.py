"""Probabilities of words by their spelling.

Words that have no id of their own share ``buckets``, each by a checksum of its
first three bytes. A byte model, trigrams with Witten-Bell interpolation down to
a uniform byte, spells the word and its end, and the bucket's share is divided
out. So P(bucket) P(word | bucket) is a distribution over all strings of bytes
but the words with an id: no two words share a probability by sharing a bucket.

The counts are exact, over all words without an id. What is gathered are the
distinct trigrams of bytes; UTF-8 bounds them, not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

START, END = 254, 255  # never a byte of UTF-8


def encoded(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


def bucket_of(word: str, buckets: int) -> int:
    """The bucket of a word: a checksum of its first three bytes, or fewer and its end."""
    a, b, c = (encoded(word[:3]) + b"\xff\xff\xff")[:3]
    return (((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) * buckets >> 32


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of words whose first three symbols are ``keys``."""
    return (((keys.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _buckets_after(a: int, buckets: int) -> np.ndarray:
    """The buckets of all words that begin with the byte ``a``, by the next two symbols."""
    return _buckets((a << 16) + np.arange(1 << 16), buckets)


def _line(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\xfe\xfe" + b"\xff\xfe\xfe".join(words) + b"\xff", np.uint8).astype(np.int64)


def trigrams(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams (a << 16 | b << 8 | c) of the words between two STARTs and an END, and how often they occur."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = _line(words)
    each = np.repeat(counts, [len(w) + 3 for w in words])
    keys = line[:-2] << 16 | line[1:-1] << 8 | line[2:]
    real = line[2:] != START
    found, at = np.unique(keys[real], return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, each[2:][real])
    return found, sums


def counted(known: Iterable[str]):
    """For mapInArrow over (w, n): the trigrams of the words not in ``known``."""
    known = frozenset(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(encoded(w), n) for w, n in zip(batch["w"].to_pylist(), batch["n"].to_pylist(), strict=True) if w not in known]
            k, n = trigrams([w for w, _ in rows], np.array([n for _, n in rows], np.int64))
            yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


class Speller:
    """The byte model, of trigrams and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, known: Iterable[str], buckets: int):
        counts = counts.astype(np.float64)
        self.buckets = buckets
        pairs = np.bincount(keys & 0xFFFF, counts, 1 << 16).reshape(256, 256)
        one = _mixed(pairs.sum(0), np.full(256, 1 / 256))
        after = _mixed(pairs, one)
        # Contexts of two symbols to rows of log-probabilities; those never seen have the row of their second symbol.
        self.row = np.tile(np.arange(256), 256)
        seen = np.unique(keys >> 8)
        self.row[seen] = 256 + np.arange(len(seen))
        held = np.bincount((self.row[keys >> 8] - 256) << 8 | keys & 255, counts, len(seen) << 8).reshape(-1, 256)
        self.logs = np.log(np.concatenate((after, _mixed(held, after[seen & 255])))).astype(np.float32)
        self.log_share = np.log(self._shares(list(known)))

    def table(self, a: int) -> np.ndarray:
        """P(c | a, b), by b and c."""
        return np.exp(self.logs[self.row[a << 8 : (a + 1) << 8]].astype(np.float64))

    def _spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log-probabilities of the words' bytes and ends, and their buckets."""
        raw = [encoded(w) for w in words]
        if not raw:
            return np.zeros(0), np.zeros(0, np.int64)
        line = _line(raw)
        each = np.zeros(len(line))
        each[2:] = self.logs[self.row[line[:-2] << 8 | line[1:-1]], line[2:]]
        each[line == START] = 0
        first = np.cumsum([0] + [len(w) + 3 for w in raw[:-1]])
        b, c = line[first + 3], line[np.minimum(first + 4, len(line) - 1)]
        return np.add.reduceat(each, first), _buckets(line[first + 2] << 16 | b << 8 | np.where(b == END, END, c), self.buckets)

    def spelled(self, word: str) -> float:
        """The log-probability of the bytes of ``word`` and its end."""
        return float(self._spelled([word])[0][0])

    def _shares(self, known: Iterable[str]) -> np.ndarray:
        """What each bucket has of all words but those in ``known``."""
        first = self.table(START)[START]
        shares, ended = np.zeros(self.buckets), np.zeros(256)
        ended[END] = 1
        for a in range(256):
            if a == END:
                continue  # no word is empty
            second, third = self.table(START)[a], self.table(a)
            third[END] = ended
            shares += np.bincount(_buckets_after(a, self.buckets), (first[a] * second[:, None] * third).ravel(), self.buckets)
        p, at = self._spelled(known)
        return np.maximum(shares - np.bincount(at, np.exp(p), self.buckets), shares * 1e-6)

    @classmethod
    def flat(cls, buckets: int) -> Speller:
        """One that knows of no word."""
        return cls(np.zeros(0, np.int64), np.zeros(0), (), buckets)

    def in_bucket(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | its bucket) of each word, and its bucket."""
        p, at = self._spelled(words)
        return p - self.log_share[at], at


def _mixed(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Witten-Bell: counts by their last axis, interpolated with ``below`` by the number of kinds seen."""
    kinds = np.maximum((counts > 0).sum(-1, keepdims=True), 1e-9)
    return (counts + kinds * below) / (counts.sum(-1, keepdims=True) + kinds)
