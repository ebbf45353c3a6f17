"""Set operations and truth joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows of all inputs; columns are matched by name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def join_truth(predicted: DataFrame, truth: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Predictions beside their true labels (``inner``, or ``left`` to keep unlabelled ones)."""
    return predicted.join(truth, on, how)


def attach_label(neighbors: DataFrame, labels: DataFrame, id_col: str, label_col: str,
                 name: str = "label") -> DataFrame:
    """The true label of each retrieved neighbour, null where there is none.

    Ids kept as text on the neighbour side are compared in the type of the label table.
    """
    kind = labels.schema[id_col].dataType
    side = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias(name))
    key = F.col("neighbor_id")
    if neighbors.schema["neighbor_id"].dataType != kind:
        key = key.try_cast(kind)
    return neighbors.join(side, key == F.col("__id"), "left").drop("__id")
