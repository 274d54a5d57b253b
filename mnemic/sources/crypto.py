"""Columns encrypted at rest (AES-GCM), and the key they are encrypted with."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_VARIABLE = "MNEMIC_KEY"


def get_or_create_key(path: str, variable: str = KEY_VARIABLE) -> str:
    """Hex key of 256 bits: from the environment, else from a file only its owner can read, else a new one
    that is written there."""
    if os.environ.get(variable):
        return os.environ[variable]
    if os.path.exists(path):
        with open(path) as f:
            return f.read().strip()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    key = secrets.token_hex(32)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
        f.write(key)
    return key


def encrypted(value: Column, key: str) -> Column:
    return F.aes_encrypt(value.cast("binary"), F.unhex(F.lit(key)), F.lit("GCM"))


def decrypted(value: Column, key: str) -> Column:
    """Null where the value is null or was encrypted with another key or changed."""
    return F.try_aes_decrypt(value, F.unhex(F.lit(key)), F.lit("GCM")).cast("string")


def encrypt(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.withColumns({c: encrypted(F.col(c), key) for c in columns})


def decrypt(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.withColumns({c: decrypted(F.col(c), key) for c in columns})


def shred(path: str) -> None:
    """Overwrite a local file with zeros and remove it."""
    if os.path.isfile(path):
        n = os.path.getsize(path)
        with open(path, "r+b") as f:
            f.write(b"\0" * n)
            f.flush()
            os.fsync(f.fileno())
        os.remove(path)
