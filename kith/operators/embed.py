"""Text to vector, and pair scoring, with pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kith.functions.text import token_pairs
from kith.functions.vectors import hash_vector


@dataclass(frozen=True)
class HashEmbedder:
    """Counts of hashed ``"col: value"`` pairs; deterministic and without Python workers."""

    dim: int = 64

    def vector(self, text: Column) -> Column:
        return hash_vector(text, self.dim)


@dataclass(frozen=True)
class ModelEmbedder:
    """A user's model: ``loader()`` gives a function from a list of texts to an n x d array.

    The model is loaded once per Python worker, and texts that repeat in a batch are encoded once.
    """

    loader: Callable[[], Callable[[list[str]], np.ndarray]]

    def vector(self, text: Column) -> Column:
        loader = self.loader

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loader()
            for texts in batches:
                codes, unique = pd.factorize(texts)
                vectors = np.asarray(model(list(unique)), dtype=np.float32) if len(unique) else []
                yield pd.Series([None if c < 0 else vectors[c] for c in codes], index=texts.index, dtype=object)

        return encode(text)


def embed(df: DataFrame, embedder=HashEmbedder(), text_col: str = "row_as_text",
          vector_col: str = "embedding") -> DataFrame:
    return df.withColumn(vector_col, embedder.vector(F.col(text_col)))


@dataclass(frozen=True)
class TokenJaccard:
    """Shared pairs over all pairs of two row texts."""

    def score(self, a: Column, b: Column) -> Column:
        pair = F.struct(token_pairs(a).alias("x"), token_pairs(b).alias("y"))
        # Each token list is bound once, then used for its size and for the overlap.
        sizes = F.transform(F.array(pair), lambda p: F.struct(
            F.size(F.array_intersect(p["x"], p["y"])).alias("both"),
            (F.size(p["x"]) + F.size(p["y"])).alias("sum")))
        return F.transform(sizes, lambda n: F.when(
            n["sum"] > 0, n["both"] / (n["sum"] - n["both"])).otherwise(F.lit(0.0)))[0]


@dataclass(frozen=True)
class ModelScorer:
    """A user's pair model: ``loader()`` gives a function from two lists of texts to scores."""

    loader: Callable[[], Callable[[list[str], list[str]], np.ndarray]]

    def score(self, a: Column, b: Column) -> Column:
        loader = self.loader

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = loader()
            for left, right in batches:
                yield pd.Series(np.asarray(model(list(left), list(right)), dtype=float), index=left.index)

        return run(a, b)
