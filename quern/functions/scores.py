"""Similarities and weights as Spark expressions. Inputs are cast to double before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60


def dice(left: Column, right: Column) -> Column:
    """Twice the common members over all members of two sets; 0 if one is empty."""
    total = F.size(left) + F.size(right)
    both = F.size(F.array_intersect(left, right)).cast("double")
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(2.0 * both / total)


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.log((n.cast("double") + 1.0) / (df.cast("double") + 1.0)) + 1.0


def bm25_idf(n: Column, df: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_term(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """The part of one query term in a document's score."""
    tf = tf.cast("double")
    return idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length.cast("double") / mean_length))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    """Inner product of double arrays of one length; others raise."""
    product = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(left) == F.size(right), product).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def magnitude(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of double arrays; a zero vector raises."""
    size = magnitude(left) * magnitude(right)
    return F.when(size > 0, dot(left, right) / size).otherwise(F.raise_error(F.lit("a vector is zero")).cast("double"))


def unit(vector: Column, zero_raises: bool = False) -> Column:
    """The vector over its length; a zero vector stays or raises."""
    size = magnitude(vector)
    zero = F.raise_error(F.lit("a vector is zero")).cast("array<double>") if zero_raises else vector
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(zero)


def rrf(rank: Column) -> Column:
    """The part of one ranking in a fused score; 0 where it has no rank."""
    return F.coalesce(1.0 / (RRF_K + rank), F.lit(0.0))


def guarded_mean(total: Column, count: Column) -> Column:
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))
