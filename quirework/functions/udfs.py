"""The few scalar functions that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def derive_key(passphrase: str, salt: bytes, rounds: int = 210_000) -> bytes:
    """The AES-256 key of a passphrase, by PBKDF2 with SHA-256."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)


def wrap_secret(secret, key: bytes):
    """AES-GCM: a column of (12-byte IV, ciphertext, tag) as bytes."""
    return F.aes_encrypt(secret, F.lit(key), F.lit("GCM"))


def unwrap_secret(wrapped, key: bytes):
    """The secret, or null where the key is wrong."""
    return F.try_aes_decrypt(wrapped, F.lit(key), F.lit("GCM")).cast("string")
