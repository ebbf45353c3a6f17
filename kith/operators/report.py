"""Counts and profiles asked of a table or an audience."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kith.functions.scalars import exact_sum


def group_count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def count_if(df: DataFrame, **conditions: Column) -> DataFrame:
    """Several filtered counts side by side in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def value_counts(df: DataFrame, values: str) -> DataFrame:
    """Counts of the elements of an array column."""
    return group_count(df.select(F.explode(values).alias("value")), "value")


def profile(df: DataFrame, id_col: str, flag: Column, group: Column, tenure: str) -> DataFrame:
    """One row: flagged rows, rows of a group, and the longest tenure with its owner and years.

    Of equal tenures the smallest id is named.
    """
    longest = F.max(tenure)
    return df.agg(
        F.count_if(flag).alias("n_flagged"), F.count_if(group).alias("n_group"),
        longest.alias("longest_months"),
        F.min_by(id_col, F.when(F.col(tenure).isNotNull(), F.struct(-F.col(tenure), F.col(id_col)))).alias("longest_id"),
        F.floor(longest / 12).alias("longest_years"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; bin 0 and bin ``bins + 1`` hold what lies outside."""
    number = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def group_sum(df: DataFrame, by: Sequence[str], amount: str) -> DataFrame:
    """Totals by group (see ``exact_sum``) and the number of rows."""
    return df.groupBy(*by).agg(exact_sum(F.col(amount)).alias("total"), F.count(F.lit(1)).alias("n"))
