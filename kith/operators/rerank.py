"""Rescoring of retrieved pairs and the cut to the best of them."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kith.operators.embed import TokenJaccard
from kith.operators.shape import with_row_id
from kith.operators.topk import top_per_group
from kith.sources.workspace import materialize

BLOCK_SEEDS = 1024   # seeds in one block of the prefix form
BLOCK_GROUP = 16     # nodes of the tree over blocks that have one parent


def rerank_depth(k: int, at_least: int = 5) -> int:
    """A tenth of k, but not below ``at_least`` (give 0 for the bare tenth)."""
    return max(at_least, int(k * 0.1))


def with_texts(knn: DataFrame, seeds: DataFrame, corpus: DataFrame, seed_id: str = "id",
               neighbor_id: str = "id", text_col: str = "row_as_text") -> DataFrame:
    """Retrieved pairs with both texts."""
    s = seeds.select(F.col(seed_id).alias("seed_id"), F.col(text_col).alias("seed_text"))
    c = corpus.select(F.col(neighbor_id).alias("neighbor_id"), F.col(text_col).alias("neighbor_text"))
    return knn.join(s, "seed_id").join(c, "neighbor_id")


def rescore(pairs: DataFrame, scorer=TokenJaccard(), name: str = "pair_score") -> DataFrame:
    """Score each (seed text, neighbour text) pair; the score is a number, rounded to 9 digits."""
    return pairs.withColumn(name, F.round(scorer.score(F.col("seed_text"), F.col("neighbor_text")), 9))


def rerank(scored: DataFrame, top_m: int, row_cols: Sequence[str] = ("neighbor_id",),
           score_col: str = "pair_score", mode: str = "seed", seed_order: str = "seed_id") -> DataFrame:
    """The distinct rows that are among the best ``top_m``; ties go to the smaller ``row_cols``.

    ``row_cols`` say what makes two retrieved rows the same. In mode ``seed`` each seed keeps its
    own best rows. In mode ``prefix`` seeds share one pool that grows in the order of
    ``seed_order`` (any type that sorts, with any gaps), and a row stays if it is among the best of the
    pool when it first enters it.
    """
    order = [F.col("score").desc(), *[F.col(c) for c in row_cols]]
    kept = dict.fromkeys(["seed_id", seed_order, *row_cols])
    rows = scored.select(*kept, F.col(score_col).alias("score"))
    if mode == "prefix":
        return _prefix(rows, top_m, list(row_cols), seed_order, order)
    if mode != "seed":
        raise ValueError(f"unknown mode: {mode}")
    pool = rows.select("seed_id", *row_cols, "score").distinct()
    return top_per_group(pool, ["seed_id"], order, top_m).select(*row_cols, "score").distinct()


def _prefix(rows: DataFrame, m: int, row_cols: list[str], seed_order: str, order) -> DataFrame:
    """A row that stays is among the best m of its own seed, of its block of seeds, and of all before it.

    Seeds that bring a row for the first time are numbered densely, so that blocks are of equal size whatever the ids. A tree
    over the blocks keeps the best m rows of each node; downwards, a node is given the best m rows before its parent and those
    of its earlier siblings. No task meets more than m rows of each of 2 x BLOCK_GROUP nodes of a parent, or one block.
    """
    first = rows.groupBy(*row_cols, "score").agg(F.min(seed_order).alias("at"))
    first = materialize(top_per_group(first, ["at"], order, m, rank_col="r").drop("r"), "prefix")
    places = materialize(with_row_id(first.select("at").distinct(), ["at"], "pos").withColumnRenamed("at", "seed"), "places")
    last = places.agg(F.max("pos")).first()[0]
    cols, asc = ["score", *row_cols], [False] + [True] * len(row_cols)
    placed = first.join(places, F.col("at").eqNullSafe(F.col("seed"))).select(
        F.floor(F.col("pos") / BLOCK_SEEDS).alias("block"), "pos", *cols)

    def best(df: DataFrame) -> DataFrame:
        return top_per_group(df, ["node"], order, m, rank_col="r").drop("r")

    def widths():
        n = 1 if last is None else last // BLOCK_SEEDS + 1
        while n > 1:
            yield n
            n = math.ceil(n / BLOCK_GROUP)

    parent = F.floor(F.col("node") / BLOCK_GROUP)
    levels = []  # (nodes, their best rows), from the blocks upwards
    for n in widths():
        below = levels[-1][1].withColumn("node", parent) if levels else placed.select(F.col("block").alias("node"), *cols)
        levels.append((n, materialize(best(below), "heads")))

    def spread(df: DataFrame, start, n: int) -> DataFrame:
        """Rows sent to the nodes from ``start`` to the end of a parent, as far as there are nodes."""
        until = F.least((F.col("up") + 1) * BLOCK_GROUP, F.lit(n)) - 1
        return (df.withColumn("to", F.when(start <= until, F.sequence(start, until)))
                  .select(F.explode("to").alias("node"), *cols))

    before = None
    for n, heads in reversed(levels):
        given = spread(heads.withColumn("up", parent), F.col("node") + 1, n)
        if before is not None:
            given = given.unionByName(spread(before.withColumnRenamed("node", "up"), F.col("up") * BLOCK_GROUP, n))
        before = best(given)
    kinds = [placed.schema[c] for c in cols]
    if before is None:  # all seeds are in one block
        before = rows.sparkSession.createDataFrame([], T.StructType([T.StructField("node", T.LongType()), *kinds]))

    def keep(own: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([earlier[cols].assign(pos=-1), own[[*cols, "pos"]]], ignore_index=True)
        both = both.sort_values(cols, ascending=asc, ignore_index=True)  # the index is now a row's rank
        pos, standing, kept = both["pos"].to_numpy(), [], []
        turns = np.lexsort((np.arange(len(pos)), pos))
        for rank in turns.tolist():
            # Within a seed ranks ascend, so a row that finds m better ones is met after them.
            if len(standing) < m or rank < standing[-1]:
                insort(standing, rank)
                del standing[m:]
                if pos[rank] >= 0:
                    kept.append(rank)
        return both.iloc[kept][[*row_cols, "score"]]

    return (placed.groupBy("block").cogroup(before.groupBy(F.col("node").alias("block")))
                  .applyInPandas(keep, T.StructType([*kinds[1:], kinds[0]])))
