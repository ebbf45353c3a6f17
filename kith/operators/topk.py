"""Top-n, globally and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_m(df: DataFrame, by: Column, m: int, *tie: Column) -> DataFrame:
    """The m rows that sort first; ties are settled by the given columns."""
    return df.orderBy(by, *tie).limit(m)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank_col: str = "rank", salts: int = 1, salt_by: Sequence[str] = ()) -> DataFrame:
    """The first n rows of each group with their rank.

    Spark cuts each map task to n rows per group before the shuffle. With ``salts`` a group is
    first cut in that many slices, so one group's survivors never meet in one task all at once.
    """
    if salts > 1:
        part = F.pmod(F.xxhash64(*salt_by), F.lit(salts))
        slices = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", part)
                .withColumn(rank_col, F.row_number().over(slices))
                .filter(F.col(rank_col) <= n)
                .drop("__salt", rank_col))
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(whole)).filter(F.col(rank_col) <= n)


def mode_label(df: DataFrame, label: str, count_col: str = "count") -> DataFrame:
    """The most frequent label with its count; equal counts go to the smaller label."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias(count_col))
              .orderBy(F.col(count_col).desc(), F.col(label)).limit(1))
