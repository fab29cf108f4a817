"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries, places where the tokenizer's pre-tokenizer
always splits: before a single space that has non-space characters on both
sides. The token count of a text is then the sum over its units. Texts in which
every space is such a place, nearly all, are split together in Arrow; the others
one by one. Units over ``UNIT_CHARS`` are split further, by the pre-tokenizer's
own pattern, outside the special strings. Units repeat, so each distinct one is
encoded by the library once for each worker, in batches balanced by bytes, and
its length kept in a memo of bounded bytes. Only lengths leave the worker.

Special strings inside a text are handled as the library does by default: they
hold no space, so no boundary falls inside one.

Defined results: a null text is the empty one, with 0 bytes and 0 tokens. Null
ids are kept, repeated rows each get their row, an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col, ship_package
from .words import text_runs

LIMIT = 1024
BATCH_BYTES = 1 << 18
TEXT_BYTES = 8 << 20  # of text that are split at a time
UNIT_CHARS = 1 << 14
MEMO_BYTES = 128 << 20

# Python's \s covers all white space of the tokenizer's pattern and a few control characters more
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r" \s|\s ")
# the same for Arrow, with the ends of a text, by the classes that make up \s
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_ARROW_UNSAFE = rf"\A | \z| {_SPACE}|{_SPACE} "

_COUNTERS: dict[str, TokenCounter] = {}


class TokenCounter:
    """Counts tokens as ``path``'s tokenizer gives them, without added special tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.memo: dict[str, int] = {}
        self.held = 0

    def units(self, text: str) -> list[str]:
        """Pieces of ``text`` whose token counts add up to that of the whole."""
        if not text:
            return []
        parts = _SAFE.split(text) if text[0] == " " or text[-1] == " " or _UNSAFE.search(text) else text.split(" ")
        made = [parts[0], *(" " + p for p in parts[1:])]
        if max(map(len, made)) > UNIT_CHARS:
            made = [u for x in made for u in (self._finer(x) if len(x) > UNIT_CHARS else [x])]
        return made

    def _finer(self, unit: str) -> Iterator[str]:
        for k, part in enumerate(self.specials.split(unit) if self.specials else [unit]):
            if k % 2:
                yield part
            else:
                yield from self.pattern.findall(part)

    def lengths(self, units: list[str]) -> list[int]:
        """The token counts of ``units``, of which each is encoded once; new ones in batches of about BATCH_BYTES."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        found = list(map(self.memo.get, units))
        new = list(dict.fromkeys(u for u, n in zip(units, found, strict=True) if n is None))
        new.sort(key=len)
        made, batch, size = {}, [], 0
        for u in new:
            batch.append(u)
            size += len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass"))
            if size >= BATCH_BYTES:
                self._encode(batch, made)
                batch, size = [], 0
        self._encode(batch, made)
        for u, n in made.items():
            if len(u) <= UNIT_CHARS:
                self.memo[u] = n
                self.held += sys.getsizeof(u) + 100
        return [made[u] if n is None else n for u, n in zip(units, found, strict=True)]

    def _encode(self, batch: list[str], made: dict[str, int]) -> None:
        if batch:
            made.update(zip(batch, map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """The token counts of texts, split one by one."""
        made = [Counter(self.units(t)) for t in texts]
        units = list(dict.fromkeys(u for c in made for u in c))
        of = dict(zip(units, self.lengths(units), strict=True))
        return [sum(of[u] * n for u, n in c.items()) for c in made]

    def count_array(self, texts: pa.Array) -> np.ndarray:
        """The token counts of texts without nulls, split together where they may be."""
        texts = texts.cast(pa.string())
        odd = pc.match_substring_regex(texts, _ARROW_UNSAFE).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        if odd.any():
            out[odd] = self.count(texts.filter(pa.array(odd)).to_pylist())
        plain = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if len(plain):
            split = pc.split_pattern(texts.take(pa.array(plain)), " ")
            words = split.flatten().dictionary_encode()
            codes, known = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
            starts = np.cumsum(sizes := pc.list_value_length(split).to_numpy(zero_copy_only=False)) - sizes
            # every word but a text's first has its space before it
            first, at = np.unique(codes[starts], return_inverse=True)
            lone = np.array(self._whole([known[k] for k in first]))
            inner = np.ones(len(codes), bool)
            inner[starts] = False
            used = np.zeros(len(known), np.int64)
            later = np.unique(codes[inner])
            used[later] = self._whole([" " + known[k] for k in later])
            each = np.concatenate(([0], np.cumsum(np.where(inner, used[codes], 0))))
            out[plain] = lone[at] + each[starts + sizes] - each[starts]
        return out

    def _whole(self, units: list[str]) -> list[int]:
        """The token counts of units, long ones by their parts."""
        if not units or max(map(len, units)) <= UNIT_CHARS:
            return self.lengths(units)
        parts = [list(self._finer(u)) if len(u) > UNIT_CHARS else [u] for u in units]
        found = iter(self.lengths([p for ps in parts for p in ps]))
        return [sum(islice(found, len(ps))) for ps in parts]


def counter(path: str) -> TokenCounter:
    """One for each worker process and path."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of = counter(path)
        for batch in batches:
            made = [of.count_array(texts) for texts in text_runs(batch.column(1), TEXT_BYTES)]
            lengths = pa.array(np.concatenate(made) if made else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lengths], ["id", "n_bytes", "n_tokens"])

    return run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of ``docs``."""
    ship_package(docs.sparkSession)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_counts(path or default_path()), f"id {kind}, n_bytes long, n_tokens long")
    return made.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
