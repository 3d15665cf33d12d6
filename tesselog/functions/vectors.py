"""Column expressions on array<float> vectors; sums run in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _by_norm(a: Column, scale) -> Column:
    """``scale`` of the norm of ``a``, which is summed once: a value that lambdas of elements use must itself come from a lambda."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), lambda s: scale(F.sqrt(s)))


def unit(a: Column) -> Column:
    """Length 1; vectors that are (nearly) zero or already of length 1 stay."""
    return _by_norm(a, lambda n: F.when((n <= 1e-6) | (F.abs(n - 1) <= 1e-3), a).otherwise(F.transform(a, lambda x: (x / n).cast("float"))))


def scaled(a: Column) -> Column:
    """array<double> of length 1, whatever the length of ``a``; zeros stay zeros."""
    return _by_norm(a, lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def same_size(a: Column, dim: int) -> Column:
    """``a`` itself; an error if it has another size."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.concat(F.lit(f"a vector of size {dim} is needed, this one has "), F.size(a).cast("string"))).cast("array<double>"))


def usable(a: Column, dim: int) -> Column:
    """Right size, no null, NaN or infinity, not all zero."""
    return (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(a, lambda x: x != 0)


def hashed_vector(text: Column, dim: int = 64, seed: str = "mock") -> Column:
    """A unit vector that depends on the text alone: SHA-256 of seed, text and a counter as 32-bit numbers."""
    per = 8
    blocks = F.transform(F.sequence(F.lit(0), F.lit((dim + per - 1) // per - 1)), lambda i: F.sha2(F.concat_ws(":", F.lit(seed), text, i.cast("string")), 256))
    raw = F.flatten(
        F.transform(
            blocks,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.lit(per - 1)),
                lambda j: F.conv(F.substring(h, j * 8 + 1, F.lit(8)), 16, 10).cast("bigint"),
            ),
        )
    )
    signed = F.slice(F.transform(raw, lambda x: F.when(x >= 2**31, x - 2**32).otherwise(x).cast("double") / float(2**31)), 1, dim)
    return scaled(signed)


def hashed_matrix(texts: list[str], dim: int = 64, seed: str = "mock") -> np.ndarray:
    """``hashed_vector`` of many texts as rows, for use in Arrow batches."""
    blocks = -(-dim // 8)
    raw = b"".join(hashlib.sha256(f"{seed}:{t}:{i}".encode("utf-8", "surrogatepass")).digest() for t in texts for i in range(blocks))
    out = np.frombuffer(raw, ">i4").reshape(len(texts), blocks * 8)[:, :dim].astype(np.float64) / 2.0**31
    return out / np.sqrt((out * out).sum(1, keepdims=True)) if len(texts) else out
