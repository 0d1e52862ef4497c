"""A deterministic embedding: sub-word hashing with sign, scaled to unit length."""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .scalars import embedding_tokens


def _bag_vector(tokens, dims: int) -> list[float]:
    v = np.zeros(dims)
    for t in tokens if tokens is not None else ():
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).astype(np.float32).tolist()


def hash_embedding(dims: int = 1536):
    """``column -> column``: tokens are cut in the JVM, hashing alone runs in Python, on Arrow batches.

    Null text and text without tokens give the zero vector.
    """
    if dims < 1:
        raise ValueError("dims must be positive")

    @F.pandas_udf(ArrayType(FloatType()))
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: _bag_vector(t, dims))

    return lambda text: run(embedding_tokens(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def letter_counts(text) -> Column:
    """How often each letter from a to z occurs, in any case: a small embedding that SQL can state as well."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in string.ascii_lowercase])
