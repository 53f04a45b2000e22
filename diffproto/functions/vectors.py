"""Vector maths on ARRAY<DOUBLE> columns, built from higher-order functions.

Spark has no vector distance functions; everything here is a composition of
``zip_with`` / ``transform`` / ``aggregate``, so it runs inside the JVM with
no Python round trip.  Arrays of unequal length raise (numpy would not
broadcast them either).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` (a one-element array and
    ``transform`` act as a let binding).  Catalyst may inline a column's
    expression into filters or lambdas; inside a let it still runs once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _let2(a, b, fn) -> Column:
    return let(_col(a), lambda x: let(_col(b), lambda y: fn(x, y)))


def _checked(x: Column, y: Column, value: Column) -> Column:
    return F.when(F.size(x) == F.size(y), value).otherwise(
        F.raise_error(F.lit("vectors of different length")))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def diff(evidence, claim, absolute: bool = True) -> Column:
    """Element-wise ``evidence - claim``, absolute by default."""
    if absolute:
        return _let2(evidence, claim, lambda e, c: _checked(e, c, F.zip_with(e, c, lambda x, y: F.abs(x - y))))
    return _let2(evidence, claim, lambda e, c: _checked(e, c, F.zip_with(e, c, lambda x, y: x - y)))


def _sq(x: Column, y: Column) -> Column:
    return _checked(x, y, _sum(F.zip_with(x, y, lambda u, v: (u - v) * (u - v))))


def _dot(x: Column, y: Column) -> Column:
    return _checked(x, y, _sum(F.zip_with(x, y, lambda u, v: u * v)))


def _norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda u: u * u)))


def _cos(x: Column, y: Column) -> Column:
    return let(_norm(x) * _norm(y), lambda den: F.when(den == 0, F.lit(NAN)).otherwise(_dot(x, y) / den))


def _angle(dot, den, variant: str) -> Column:
    cos = F.when(den == 0, F.lit(NAN)).otherwise(dot / den)
    c = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))
    if variant == "reference":
        return F.acos(c) + F.lit(math.radians(10))
    if variant == "degrees":
        return F.degrees(F.acos(c)) + F.lit(10.0)
    raise ValueError(f"unknown theta variant: {variant}")


def _bound(x: Column, y: Column, variant: str, f) -> Column:
    """``f(|x|, |y|, theta)``, each computed once a row."""
    return let(_norm(x), lambda nx: let(_norm(y), lambda ny: let(
        _angle(_dot(x, y), nx * ny, variant), lambda th: f(nx, ny, th))))


def _triangle(nx, ny, th) -> Column:
    return nx * ny * F.sin(F.radians(th)) / F.lit(2.0)


def _sector(x: Column, y: Column, nx, ny, th) -> Column:
    return F.lit(math.pi) * F.pow(F.sqrt(_sq(x, y)) + F.abs(nx - ny), F.lit(2.0)) * th / F.lit(360.0)


def sq_distance(a, b) -> Column:
    return _let2(a, b, _sq)


def euclidean(a, b) -> Column:
    """Euclidean distance (smaller is nearer)."""
    return F.sqrt(sq_distance(a, b))


def sim_euclidean(a, b) -> Column:
    """``1 - ||a - b||`` (larger is nearer)."""
    return F.lit(1.0) - euclidean(a, b)


def dot(a, b) -> Column:
    return _let2(a, b, _dot)


def norm(a) -> Column:
    return _norm(_col(a))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector gives NaN (0/0), as numpy does."""
    return _let2(a, b, _cos)


def theta(a, b, variant: str = "reference") -> Column:
    """Angle between a and b plus a 10 degree offset.

    ``reference``: ``acos(cos) + radians(10)``, in radians.
    ``degrees``  : ``degrees(acos(cos)) + 10``, in degrees (published TS-SS).
    The cosine is clamped to [-1, 1] so rounding never leaves acos's domain.
    """
    return _let2(a, b, lambda x, y: _bound(x, y, variant, lambda nx, ny, th: th))


def triangle(a, b, variant: str = "reference") -> Column:
    """``|a| |b| sin(radians(theta)) / 2``; the reference variant converts an
    angle that is already in radians once more."""
    return _let2(a, b, lambda x, y: _bound(x, y, variant, _triangle))


def magnitude_difference(a, b) -> Column:
    return _let2(a, b, lambda x, y: F.abs(_norm(x) - _norm(y)))


def sector(a, b, variant: str = "reference") -> Column:
    """``pi (ED + MD)^2 theta / 360``."""
    return _let2(a, b, lambda x, y: _bound(x, y, variant, lambda nx, ny, th: _sector(x, y, nx, ny, th)))


def ts_ss(a, b, variant: str = "reference") -> Column:
    """Triangle-area times sector-area similarity measure (a distance)."""
    return _let2(a, b, lambda x, y: _bound(
        x, y, variant, lambda nx, ny, th: _triangle(nx, ny, th) * _sector(x, y, nx, ny, th)))


SIMILARITIES = ("euclidean", "cosine")
DISTANCES = ("euclidean", "cosine", "triangle")


def similarity(a, b, metric: str = "euclidean") -> Column:
    """Larger is nearer: ``1 - ED`` or cosine.  Used by the classifier."""
    if metric == "euclidean":
        return sim_euclidean(a, b)
    if metric == "cosine":
        return cosine(a, b)
    raise ValueError(f"unknown similarity metric: {metric!r} (expected one of {SIMILARITIES})")


def distance(a, b, metric: str = "euclidean") -> Column:
    """Metric dispatch of the drift study: ED, cosine or TS-SS."""
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "cosine":
        return cosine(a, b)
    if metric == "triangle":
        return ts_ss(a, b)
    raise ValueError(f"unknown distance metric: {metric!r} (expected one of {DISTANCES})")


def scale(v, factor) -> Column:
    f = _col(factor) if not isinstance(factor, (int, float)) else F.lit(float(factor))
    return F.transform(_col(v), lambda x: x * f)


def l2_normalize(v) -> Column:
    return let(_col(v), lambda x: let(_norm(x), lambda n: F.when(n == 0, x).otherwise(
        F.transform(x, lambda u: u / n))))
