"""Splits and samples that give the same rows on every run and under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kith.operators.topk import top_per_group


def hash_percent(key: Column, salt: str = "") -> Column:
    """A number 0..99 from the MD5 of a key."""
    text = F.concat(key.cast("string"), F.lit(salt)) if salt else key.cast("string")
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 100).cast("int")


def split(df: DataFrame, weights: Sequence[int], key: str, salt: str = "") -> list[DataFrame]:
    """Disjoint parts by hashed key; ``weights`` are percentages that sum to 100."""
    if sum(weights) != 100:
        raise ValueError("weights must sum to 100")
    parts, low = [], 0
    slot = hash_percent(F.col(key), salt)
    for w in weights:
        parts.append(df.filter((slot >= low) & (slot < low + w)))
        low += w
    return parts


def random_split(df: DataFrame, weights: Sequence[float], seed: int | None = None) -> list[DataFrame]:
    """Spark's own random split, for callers that want its semantics."""
    return df.randomSplit(list(weights), seed)


def sample_per_label(df: DataFrame, label: str, key: str, percent: int = 20, n: int = 10) -> DataFrame:
    """Of each label a hashed ``percent`` share, and of that the first n rows by key."""
    share = df.filter(hash_percent(F.col(key)) < percent)
    return top_per_group(share, [label], [F.col(key)], n, rank_col="__rank").drop("__rank")


def balanced_sample(df: DataFrame, label: str, key: str, n: int, labels: Sequence = (1, 0)) -> DataFrame:
    """The first n rows by key of each of the labels, in one pass."""
    chosen = df.filter(F.col(label).isin(list(labels)))
    return top_per_group(chosen, [label], [F.col(key)], n, rank_col="__rank").drop("__rank")


def limit_ordered(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)
