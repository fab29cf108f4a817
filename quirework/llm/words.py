"""Words as several operators here split and compare them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def trimmed(word: str) -> str:
    """``word`` lower-cased, without what is neither letter nor digit at its ends."""
    if word.isalnum():
        return word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


class Memo(dict):
    """What ``made`` gives for a string, kept in about ``limit`` bytes; strings of a sixteenth of that are not kept."""

    def __init__(self, made: Callable, limit: int = 32 << 20):
        self.made, self.limit, self.held = made, limit, 0

    def __missing__(self, word: str):
        found = self.made(word)
        size = sys.getsizeof(word) + 150
        if size <= self.limit >> 4:
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self.held += size
            self[word] = found
        return found


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of ``texts``, every word as its place among them, and each text's number of words.

    Words stand between white space, as for str.split; null texts have none.
    """
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    known = words.dictionary.to_pylist()
    blank = pc.index(words.dictionary, "").as_py()
    if blank >= 0:  # what the split leaves at the ends of a text is no word
        real = codes != blank
        upto, ends = np.concatenate(([0], np.cumsum(real))), np.cumsum(lengths)
        lengths = upto[ends] - upto[ends - lengths]
        codes = codes[real]
        codes = codes - (codes > blank)
        del known[blank]
    return known, codes, lengths


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows of ``sizes`` into runs (from, to) of about ``limit`` at most, or one row if it is larger."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield at, to
        at = to


def text_runs(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """``texts`` in slices of about ``limit`` bytes at most."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in runs(sizes, limit):
        yield texts.slice(a, b - a)
