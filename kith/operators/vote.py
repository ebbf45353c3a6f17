"""Classification by the labels of retrieved neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kith.operators.topk import top_per_group


def vote(labelled: DataFrame, label: str = "label", name: str = "predicted") -> DataFrame:
    """The most frequent neighbour label per seed; equal counts go to the label met first.

    ``labelled`` is a retrieval ``(seed_id, rank, ...)`` with the neighbours' label. Neighbours without a
    label don't vote; a seed that has none with a label gets null.
    """
    per_label = labelled.groupBy("seed_id", label).agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("nearest"))
    voting = F.when(F.col(label).isNotNull(), F.struct("n", -F.col("nearest")))
    return per_label.groupBy("seed_id").agg(F.max_by(label, voting).alias(name))


def vote_reranked(scored: DataFrame, top_m: int, label: str = "label", score_col: str = "pair_score",
                  name: str = "predicted") -> DataFrame:
    """The vote of each seed's ``top_m`` neighbours by pair score."""
    best = top_per_group(
        scored.drop("rank"), ["seed_id"], [F.col(score_col).desc(), F.col("neighbor_id")], top_m)
    return vote(best, label, name)


def label_histogram(labelled: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Distinct neighbours per group and label."""
    return (labelled.select(by, "neighbor_id", label).distinct()
            .groupBy(by, label).agg(F.count(F.lit(1)).alias("n")))
