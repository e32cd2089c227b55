"""Columns over vectors in arrays of floats; sums are kept in single precision, as the sources' are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance of vectors of different lengths.
FAR = 3.4028234663852886e38


def squared_distance(a: Column, b: Column) -> Column:
    """The squared Euclidean distance, added up in order in single precision."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0).cast("float"), lambda total, x: (total + x).cast("float"))


def distance(a: Column, b: Column) -> Column:
    """The Euclidean distance; vectors of different lengths are as far as a float can say."""
    return F.when(F.size(a) == F.size(b), F.sqrt(squared_distance(a, b)).cast("float").cast("double")).otherwise(F.lit(FAR))


def encoded(vector: Column, low: Column, scale: Column, levels: int) -> Column:
    """Codes of a vector: (x - low) * scale, clamped to 0..levels and rounded half away from zero."""
    shifted = F.zip_with(vector, low, lambda x, lo: (x - lo).cast("float"))
    scaled = F.zip_with(shifted, scale, lambda x, s: (x * s).cast("float"))
    return F.transform(scaled, lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(levels)), x.cast("double"))) + 0.5).cast("smallint"))


def decoded(code: Column, low: Column, scale: Column) -> Column:
    """The vector that codes stand for: code / scale + low in single precision."""
    steps = F.zip_with(code, scale, lambda c, s: (c.cast("float") / s).cast("float"))
    return F.zip_with(steps, low, lambda x, lo: (x + lo).cast("float"))
