"""Building and reading a vector index kept as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kith.functions.scalars import meta_get
from kith.operators import kernels
from kith.operators.embed import HashEmbedder, embed
from kith.operators.shape import feature_cols, row_as_text
from kith.sources.readers import read_index
from kith.sources.writers import append_index


def build_index(df: DataFrame, path: str, id_col: str, label_col: str | None = None,
                features: Sequence[str] | None = None, meta_cols: Sequence[str] | None = None,
                embedder=HashEmbedder(), metric: str = "cosine", load: str | None = None) -> DataFrame:
    """Row text (in canonical form), vector, features and metadata of a table, appended to the index at ``path`` (see ``append_index``)."""
    features = features or feature_cols(df, id_col, label_col)
    if meta_cols is None:
        meta_cols = [id_col] + ([label_col] if label_col else [])
    rows = embed(row_as_text(df, features, canonical=True), embedder)
    append_index(rows, path, id_col, meta_cols=meta_cols, features=features, metric=metric, load=load)
    return read_index(df.sparkSession, path)


def index_count(index: DataFrame, name: str = "n") -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias(name))


def covariance(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and covariance of ``vectors (vec)`` in one pass; tasks emit their sums cell by cell, and d x d cells are gathered."""

    def run(batches):
        n, sums, products = 0, 0.0, 0.0
        for batch in batches:
            batch = kernels.usable(batch, "l2", 0)
            if batch.num_rows:
                m = kernels.matrix(batch.column(0))
                n, sums, products = n + len(m), sums + m.sum(axis=0), products + m.T @ m
        if n:
            flat = np.concatenate([[n, len(sums)], sums, products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["cell", "value"])

    value = F.when(F.col("cell") == 1, F.max("value")).otherwise(F.sum("value")).alias("value")
    cells = vectors.mapInArrow(run, "cell long, value double").groupBy("cell").agg(value).orderBy("cell").toArrow().column(1).to_numpy()
    if not len(cells):
        return None
    n, dim = cells[0], int(cells[1])
    mean, products = cells[2:2 + dim] / n, cells[2 + dim:].reshape(dim, dim) / n
    return mean, products - np.outer(mean, mean)


ROUNDS = 12  # rounds of subspace iteration


def principal_axes(cov: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Two orthonormal axes of largest variance, by subspace iteration from a fixed start, each with a positive sum of cubes.

    Cosines of multiples of the place start it, so any engine can repeat the steps.
    """
    place = np.arange(1, len(cov) + 1)
    a, b = np.cos(place), np.cos(2 * place)
    for _ in range(rounds):
        a, b = cov @ a, cov @ b
        a = a / (np.sqrt(a @ a) or 1.0)
        b = b - (a @ b) * a
        b = b / (np.sqrt(b @ b) or 1.0)
    return np.stack([v if (v ** 3).sum() >= 0 else -v for v in (a, b)])


def project_2d(index: DataFrame, label_key: str = "target", vector_col: str = "embedding",
               label=None, rounds: int = ROUNDS) -> DataFrame:
    """Two principal components of every vector beside its label (``Unknown`` without one).

    Fitting passes once over the rows for their covariance; only that d x d matrix is gathered. The axes come from a fixed number of rounds,
    which makes them the same on every run; where variances lie close together they span nearly, not exactly, the leading plane.
    Rows without a usable vector have no point.
    """
    label = meta_get(F.col("metadata"), label_key) if label is None else label
    vec = F.col(vector_col).cast("array<double>")
    rows = index.select("id", label.alias("label"), vec.alias("vec"))
    fitted = covariance(rows.select("vec"))
    if fitted is None:
        return rows.select("id", "label", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    axes = principal_axes(fitted[1], rounds)

    def along(axis: np.ndarray):
        weights = F.array(*[F.lit(float(x)) for x in axis])
        dot = F.aggregate(F.zip_with("vec", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return F.when(finite, dot)

    return rows.select("id", "label", along(axes[0]).alias("x"), along(axes[1]).alias("y"))
