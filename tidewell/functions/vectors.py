"""Vector columns over array<float|double>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions.rows import let


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1.0 - dot(a, b) / size)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(
        norm(v),
        lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)),
    )


def fit_dim(v: Column, dim: int) -> Column:
    """Cut or zero-pad to `dim` entries."""
    head = F.slice(F.transform(v, lambda x: x.cast("double")), 1, dim)
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(v), F.lit(0)))
    return F.concat(head, pad)


def truncate_renorm(v: Column, dim: int) -> Column:
    """Cut to `dim` and restore unit length when `dim` is below the model's own size."""
    head = F.slice(F.transform(v, lambda x: x.cast("double")), 1, dim)
    return l2_normalize(head) if dim < K.NATIVE_DIM else head
