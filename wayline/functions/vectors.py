"""Vector arithmetic on array columns, evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def neg_mse(a, b) -> Column:
    sq = F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return -sq / F.size(_d(a))


def l2_normalise(a, eps: float = 1e-12) -> Column:
    """Unit vector; vectors shorter than `eps` are divided by `eps`.

    The norm travels next to each element because a lambda body is evaluated
    once per element: computing it inside would cost O(d^2).
    """
    pairs = F.arrays_zip(_d(a).alias("x"), F.array_repeat(F.greatest(norm(a), F.lit(eps)), F.size(_d(a))).alias("n"))
    return F.transform(pairs, lambda p: p["x"] / p["n"])
