"""Shaping a table before it becomes text: rename, drop, derive, id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kith.functions.text import row_text
from kith.sources.workspace import materialize


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns; absent ones are no error."""
    return df.drop(*columns)


def feature_cols(df: DataFrame, id: str | None = None, label: str | None = None,
                 first_is_id: bool = False) -> list[str]:
    """Columns that describe a row: all but its id and label."""
    out = {id, label} | ({df.columns[0]} if first_is_id else set())
    return [c for c in df.columns if c not in out]


def derive(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Compute a column and put it last, also where one of that name exists."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, value.alias(name))


def constant(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def with_row_id(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "id") -> DataFrame:
    """Add a row id.

    Without ``order_by`` the id is unique and ascends within the input, with gaps and at no cost.
    With it the ids are 0..n-1 in that order: the rows are range-partitioned, sorted and written
    once, and each partition is shifted by the rows before it. The order should be unique.
    """
    if order_by is None:
        return df.withColumn(name, F.monotonically_increasing_id())
    place = F.monotonically_increasing_id()
    parts = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
               .withColumn("__part", F.shiftright(place, 33))
               .withColumn("__place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    parts = materialize(parts, "ordered")
    # One row per partition, so a single window over them stays small.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
                  .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    return (parts.join(F.broadcast(shift), "__part")
                 .withColumn(name, F.col("__before") + F.col("__place"))
                 .drop("__part", "__place", "__before"))


def row_as_text(df: DataFrame, columns: Sequence[str], canonical: bool = False,
                name: str = "row_as_text") -> DataFrame:
    """Add the row text; ``canonical`` writes numbers in one plain form (see ``row_text``)."""
    types = {f.name: f.dataType for f in df.schema.fields} if canonical else None
    return df.withColumn(name, row_text(columns, types))


def text_to_columns(df: DataFrame, columns: Sequence[str], text_col: str = "row_as_text") -> DataFrame:
    """The named values of a row text as string columns."""
    from kith.functions.text import text_map

    parsed = df.withColumn("__pairs", text_map(F.col(text_col)))
    return parsed.withColumns(
        {c: F.try_element_at("__pairs", F.lit(c)) for c in columns}).drop("__pairs")


def extract_steps(df: DataFrame, log: str, observation: str | None = None) -> DataFrame:
    """Add thought, action, action input and observation of each step log, and the full step."""
    from kith.functions.scalars import step_fields

    fields = step_fields(F.col(log))
    if observation is not None:
        fields["observation"] = F.col(observation)
        fields["step"] = F.concat(F.col(log), F.lit(" Observation: "), F.col(observation))
    return df.withColumns(fields)
