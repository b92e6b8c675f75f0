"""Vector expressions: dot product, cosine, truncation, packed vectors and the offline word-hash embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .text import let, words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_of(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 when a vector is missing, empty, zero or of another length."""
    same = a.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(let(norm_of(a) * norm_of(b), lambda n: F.when(same & (n > 0), dot(a, b) / n)), F.lit(0.0))


def unit(a: Column) -> Column:
    return let(norm_of(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def shorten(a: Column, dimensions: int = 1024) -> Column:
    """A prefix of a nested-dimension embedding, renormalised."""
    return unit(F.slice(a, 1, dimensions))


def valid_vector(a: Column, dimensions: int | None = None) -> Column:
    """Finite, non-zero and of the expected length."""
    finite = ~F.exists(a, lambda x: F.isnan(x) | F.isnull(x) | (F.abs(x) == float("inf")))
    checked = finite & F.exists(a, lambda x: x != 0)
    return F.coalesce(checked if dimensions is None else checked & (F.size(a) == dimensions), F.lit(False))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vector(packed: pd.Series) -> pd.Series:
    """Little-endian float32 bytes (after `unbase64`) to an array."""
    return packed.map(lambda raw: None if raw is None else np.frombuffer(raw, dtype="<f4").tolist())


@F.pandas_udf(T.BinaryType())
def pack_vector(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _bucket_vector(buckets: pd.Series) -> pd.Series:
    rows = [np.zeros(0, np.int64) if row is None else np.asarray(row, np.int64) for row in buckets]
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    counts = np.bincount(owner * 64 + flat, minlength=64 * len(rows)).reshape(-1, 64).astype(np.float64)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return pd.Series(list(counts / np.where(length > 0, length, 1.0)), dtype=object)


def hash_buckets(text: Column) -> Column:
    """The bucket (0..63) of each distinct word: its SHA-256's second byte modulo 64."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.sha2(w, 256), 3, 2), 16, 10).cast("int") % 64))


def hash_embedding(text: Column) -> Column:
    """Deterministic 64-dimension embedding of a text: distinct words hashed to buckets, unit length."""
    return _bucket_vector(hash_buckets(text))
