"""Vector expressions on ``array`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SEP = r"; |\n"  # between pairs of a row text, and between pooled row texts


def to_doubles(col: Column) -> Column:
    return col.cast("array<double>")


def unit_vector(col: Column) -> Column:
    """The vector divided by its length; a zero vector becomes null."""
    v = to_doubles(col)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # The outer lambda binds the length once; named inside the inner one it is computed per element.
    return F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))[0]


def hash_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token: the first 32 bits of its MD5 modulo ``dim``."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_vector(text: Column, dim: int) -> Column:
    """Row text as a count vector: each ``"col: value"`` pair adds one to its bucket."""
    tokens = F.filter(F.split(text, TOKEN_SEP), lambda t: t != "")  # an empty text has no pair
    buckets = F.transform(tokens, lambda t: hash_bucket(t, dim))
    return F.aggregate(
        buckets,
        F.array_repeat(F.lit(0.0).cast("float"), dim),
        lambda acc, b: F.transform(
            acc, lambda v, i: F.when(i == b, (v + 1).cast("float")).otherwise(v)),
    )
