"""Audiences and labels built from retrieved neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kith.functions.scalars import exact_sum
from kith.operators.knn import knn_join
from kith.options import KnnOptions

POOL_TEXTS = 500  # seed texts joined into one query


def with_neighbor_fields(knn: DataFrame, corpus: DataFrame, fields: Sequence[str], neighbor_id: str = "id") -> DataFrame:
    """Each retrieved pair with fields of its neighbour, beside rank and score."""
    side = corpus.select(F.col(neighbor_id).alias("neighbor_id"), *[F.col(f) for f in fields if f != neighbor_id])
    return knn.join(side, "neighbor_id")


def lookalike(seeds: DataFrame, corpus: DataFrame, k: int, fields: Sequence[str],
              options: KnnOptions = KnnOptions(), *, seed_id: str = "id", neighbor_id: str = "id",
              vector_col: str = "embedding") -> DataFrame:
    """The look-alike audience: the distinct neighbours of all seeds, with the given fields.

    The join moves ids and scores only; the fields are read for the members afterwards.
    """
    knn = knn_join(seeds, corpus, k, options, seed_id=seed_id, neighbor_id=neighbor_id, vector_col=vector_col)
    return audience(knn, corpus, fields, neighbor_id)


def audience(knn: DataFrame, corpus: DataFrame, fields: Sequence[str], neighbor_id: str = "id") -> DataFrame:
    """Distinct neighbours of a retrieval with fields of the corpus."""
    members = knn.select(F.col("neighbor_id").alias(neighbor_id)).distinct()
    return corpus.join(members, neighbor_id, "left_semi").select(*fields).distinct()


def propagate_max(seeds: DataFrame, labelled: DataFrame, label: str = "label", seed_id: str = "id",
                  name: str = "predicted", keep_label: bool = True) -> DataFrame:
    """Each seed row with the largest label among its neighbours (null without any), as a set of rows.

    ``labelled`` is a retrieval that carries the neighbours' label.
    """
    best = labelled.groupBy(F.col("seed_id").alias(seed_id)).agg(F.max(label).alias(name))
    out = seeds.join(best, seed_id, "left").distinct()
    return out if keep_label else out.drop(name)


def pooled_texts(seeds: DataFrame, position: str, text_col: str = "row_as_text", size: int = POOL_TEXTS) -> DataFrame:
    """Up to ``size`` seed texts, in order of their dense position, joined by newlines."""
    batch = F.floor(F.col(position) / size).alias("batch")
    parts = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(text_col))))
    return seeds.groupBy(batch).agg(
        F.concat_ws("\n", F.transform(parts, lambda p: p[text_col])).alias(text_col))


def pooled_vectors(seeds: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """The mean vector of each seed group, added up per map task before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    point = array_to_vector(F.col(vector_col).cast("array<double>"))
    return seeds.groupBy(by).agg(vector_to_array(Summarizer.mean(point)).alias(vector_col))


def knn_pooled(seeds: DataFrame, corpus: DataFrame, k: int, by: str, options: KnnOptions = KnnOptions(), *,
               neighbor_id: str = "id", vector_col: str = "embedding") -> DataFrame:
    """One query per seed group: the k rows nearest to the group's mean vector."""
    return knn_join(pooled_vectors(seeds, by, vector_col), corpus, k, options, seed_id=by,
                    neighbor_id=neighbor_id, vector_col=vector_col)


def audience_score(knn: DataFrame) -> DataFrame:
    """How alike each member is to the seed group: best and mean score, and seeds that found it."""
    hits = F.count(F.lit(1))
    return knn.groupBy("neighbor_id").agg(
        F.max("score").alias("best_score"),
        (exact_sum(F.col("score")) / hits).alias("mean_score"),
        hits.alias("n_seeds"))


def bucket_budget(members: DataFrame, bucket: str, amount: str) -> DataFrame:
    """Per bucket: members, and the mean and total of an amount (see ``exact_sum``)."""
    hits = F.count(F.lit(1))
    total = exact_sum(F.col(amount))
    return members.groupBy(bucket).agg(
        hits.alias("n"), (total / F.count(amount)).alias("mean_amount"), total.alias("total_amount"))
