"""Local text vectors: signed hashing of letter trigrams, and cosine similarity.

Texts are reduced to small letters, digits and single spaces in the JVM; the hashing is
an Arrow-batched numpy function, since exploding every trigram of every text into rows
would cost far more than the hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions, and the start and factor of 32-bit FNV-1a.
DIMENSIONS = 384
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _step(state: np.ndarray, byte) -> np.ndarray:
    return (state ^ byte) * np.uint32(FNV_PRIME)


def hash_trigrams(text: bytes) -> np.ndarray:
    """Unit vector of an ASCII text; zeros if it has no trigram."""
    out = np.zeros(DIMENSIONS)
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(data) < 3:
        return out
    h = _step(_step(_step(np.uint32(FNV_START), data[:-2]), data[1:-1]), data[2:])
    sign = 1 - 2 * (_step(h, np.uint32(ord("#"))) % 2).astype(np.int64)
    np.add.at(out, h % DIMENSIONS, sign)
    size = np.sqrt((out**2).sum())
    return out / size if size else out


def embed(text: Column) -> Column:
    """A vector of DIMENSIONS for each text; zeros for null and for texts without letters or digits."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([hash_trigrams(t.encode()) for t in texts])

    return vectors(plain(F.coalesce(text, F.lit(""))))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; 0 for null, empty and unlike lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot).otherwise(0.0)


def holding_text(issue: Column, rule: Column, quote: Column) -> Column:
    """What a holding's vector is made from."""
    return F.concat_ws(" ", issue, rule, quote)
