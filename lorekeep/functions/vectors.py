"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def doubles(c) -> Column:
    return col(c).cast("array<double>")


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a, b) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """0 where either norm is 0."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def unit(a) -> Column:
    """Divided by its norm, unless that is next to nothing."""
    n = norm(a)
    return F.when(n > 1e-10, F.transform(a, lambda x: x / n)).otherwise(a)


def expanded(a, dim: int) -> Column:
    return unit(F.concat(a, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(a))))


def contracted(a, dim: int, size: int) -> Column:
    """`size` values down to `dim`: means of groups where the ratio is a power of two, else the first ones."""
    ratio = size // dim
    if size % dim == 0 and ratio & (ratio - 1) == 0:
        mean = lambda i: F.aggregate(F.slice(a, i * ratio + 1, F.lit(ratio)), F.lit(0.0), lambda s, x: s + x) / ratio
        return unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), mean))
    return unit(F.slice(a, 1, dim))


def adapted(a, dim: int, size: int) -> Column:
    return a if size == dim else expanded(a, dim) if size < dim else contracted(a, dim, size)


def usable(c, dim: int) -> Column:
    """`dim` finite values that aren't all 0."""
    c = col(c)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dim) & finite & F.exists(c, lambda v: v != 0), F.lit(False))
