"""From a seed table, file or record to a result in one call, against a stored vector index: a plain one, one stored by
cell (``read_cells``, exact, reads only the cells it needs) or a neighbour graph (``read_graph``, approximate).

Seeds need no id: equal seed texts find equal neighbours, so each distinct text is searched once, under a
number of its own, and the results are joined back to the seed rows. Values come from the ``fields`` that
the index stores, not from the row text, so a value may hold the separators of a row text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kith.functions.scalars import meta_get
from kith.operators.cells import CellIndex, knn_join_cells
from kith.operators.embed import HashEmbedder, embed
from kith.operators.graph import GraphIndex, knn_join_graph
from kith.operators.index import build_index
from kith.operators.knn import knn_join
from kith.operators.rerank import rerank, rerank_depth, rescore
from kith.operators.sampling import sample_per_label, split
from kith.operators.sets import join_truth
from kith.operators.shape import feature_cols, row_as_text
from kith.operators.vote import label_histogram, vote, vote_reranked
from kith.options import KnnOptions
from kith.sources.readers import read_seeds, seed_record
from kith.sources.workspace import materialize
from kith.sources.writers import write_result


Index = DataFrame | CellIndex | GraphIndex


def _rows(index: Index) -> DataFrame:
    """The entries of an index, with their texts, metadata and feature values."""
    return index if isinstance(index, DataFrame) else index.rows


def _search(texts: DataFrame, index: Index, k: int, options: KnnOptions) -> DataFrame:
    if isinstance(index, GraphIndex):
        metric = index.options.metric
    else:
        metric = index.metric if isinstance(index, CellIndex) else index.schema["embedding"].metadata.get("metric", options.metric)
    if metric != options.metric:
        raise ValueError(f"the index is stored for {metric}, not {options.metric}")
    if isinstance(index, CellIndex):
        return knn_join_cells(texts, index, k, options, seed_id="seed_id")
    if isinstance(index, GraphIndex):
        return knn_join_graph(texts, index, k, exclude_self=options.exclude_self, seed_id="seed_id")
    return knn_join(texts, index, k, options, seed_id="seed_id")


def retrieve(seeds: DataFrame, index: Index, features: Sequence[str], k: int, embedder=HashEmbedder(),
             options: KnnOptions = KnnOptions()) -> tuple[DataFrame, DataFrame]:
    """The distinct seed texts ``(seed_id, row_as_text, embedding)`` and the k nearest index entries of each.

    Texts are numbered, embedded and written once, so the joins read vectors and never embed again.
    """
    distinct = row_as_text(seeds, features, canonical=True).select("row_as_text").distinct()
    texts = materialize(embed(distinct.withColumn("seed_id", F.monotonically_increasing_id()), embedder), "seeds")
    return texts, _search(texts, index, k, options)


def _value(column: str, name: str) -> Column:
    return F.try_element_at(column, F.lit(name)).alias(name)


def find_audience(seeds: DataFrame, index: Index, features: Sequence[str], k: int, meta: Sequence[str] = (),
                  embedder=HashEmbedder(), options: KnnOptions = KnnOptions()) -> DataFrame:
    """The look-alike audience as a set of rows: features and metadata values, all as text."""
    _, knn = retrieve(seeds, index, features, k, embedder, options)
    members = knn.select(F.col("neighbor_id").alias("id")).distinct()
    return _rows(index).join(members, "id", "left_semi").select(
        *[_value("fields", f) for f in features], *[_value("metadata", m) for m in meta]).distinct()


def _scored(texts, knn, index, scorer, *carried: Column) -> DataFrame:
    """Pairs with both texts, their pair score and what else is carried of the neighbour."""
    rows = _rows(index).select(F.col("id").alias("neighbor_id"), F.col("row_as_text").alias("neighbor_text"), *carried)
    seed = texts.select("seed_id", F.col("row_as_text").alias("seed_text"))
    return rescore(knn.join(seed, "seed_id").join(rows, "neighbor_id"), scorer)


def find_reranked(seeds: DataFrame, index: Index, features: Sequence[str], k: int, scorer,
                  top_m: int | None = None, embedder=HashEmbedder(),
                  options: KnnOptions = KnnOptions()) -> DataFrame:
    """The audience cut to each seed's best rows by pair score: features as text, and the score."""
    texts, knn = retrieve(seeds, index, features, k, embedder, options)
    row = F.struct(*[_value("fields", f) for f in features]).alias("row")
    best = rerank(_scored(texts, knn, index, scorer, row), rerank_depth(k) if top_m is None else top_m, ["neighbor_text", "row"])
    return best.select("row.*", "score")


def _with_label(knn, index, label):
    labels = _rows(index).select(F.col("id").alias("neighbor_id"), meta_get(F.col("metadata"), label).alias("label"))
    return knn.join(labels, "neighbor_id")


def _with_predicted(seeds, features, texts, per_seed):
    """Every seed row with the prediction of its text, null where it found none."""
    found = texts.select("seed_id", F.col("row_as_text").alias("__text")).join(per_seed, "seed_id").drop("seed_id")
    rows = row_as_text(seeds, features, canonical=True, name="__text")
    return rows.join(found, "__text", "left").drop("__text")


def classify(seeds: DataFrame, index: Index, features: Sequence[str], k: int, label: str,
             embedder=HashEmbedder(), options: KnnOptions = KnnOptions()) -> DataFrame:
    """Every seed row with the majority label of its neighbours as ``predicted``."""
    texts, knn = retrieve(seeds, index, features, k, embedder, options)
    return _with_predicted(seeds, features, texts, vote(_with_label(knn, index, label)))


def classify_reranked(seeds: DataFrame, index: Index, features: Sequence[str], k: int, label: str, scorer,
                      top_m: int | None = None, embedder=HashEmbedder(),
                      options: KnnOptions = KnnOptions()) -> DataFrame:
    """As ``classify``, by the neighbours that score best as pairs (a tenth of k, at least one)."""
    texts, knn = retrieve(seeds, index, features, k, embedder, options)
    scored = _scored(texts, knn, index, scorer, meta_get(F.col("metadata"), label).alias("label"))
    votes = vote_reranked(scored, rerank_depth(k, at_least=1) if top_m is None else top_m)
    return _with_predicted(seeds, features, texts, votes)


def spread_label(seeds: DataFrame, index: Index, features: Sequence[str], k: int, label: str,
                 embedder=HashEmbedder(), options: KnnOptions = KnnOptions()) -> DataFrame:
    """Every distinct seed row with the largest (numeric) label of its neighbours as ``predicted``."""
    texts, knn = retrieve(seeds, index, features, k, embedder, options)
    best = _with_label(knn, index, label).groupBy("seed_id").agg(F.max(F.col("label").try_cast("int")).alias("predicted"))
    return _with_predicted(seeds, features, texts, best).distinct()


def evaluate_holdout(df: DataFrame, path: str, id_col: str, features: Sequence[str], label: str, k: int, scorer,
                     train_percent: int = 80, embedder=HashEmbedder(), options: KnnOptions = KnnOptions()) -> DataFrame:
    """Index a hashed share of the rows at ``path`` and classify the others by it.

    Returns ``(id, label, predicted)`` of every row held out, written once, for the reports of ``evaluate``.
    """
    train, test = split(df, [train_percent, 100 - train_percent], id_col)
    index = build_index(train, path, id_col, label, features, embedder=embedder, metric=options.metric)
    got = classify_reranked(test.select(id_col, *features), index, features, k, label, scorer, embedder=embedder, options=options)
    truth = test.select(id_col, F.col(label).alias("label"))
    return materialize(join_truth(got.select(id_col, "predicted"), truth, id_col).withColumnRenamed(id_col, "id"), "judged")


def validate_per_class(df: DataFrame, index: Index, features: Sequence[str], key: str, label: str, k: int,
                       percent: int = 20, n: int = 10, embedder=HashEmbedder(),
                       options: KnnOptions = KnnOptions()) -> DataFrame:
    """Do rows of a class find their class? ``(seed_label, label, n)``.

    A sample of each class is pooled into one query (at most ``n`` texts each); its neighbours are counted by label.
    """
    sample = row_as_text(sample_per_label(df, label, key, percent, n), features, canonical=True)
    parts = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("row_as_text"))))
    pooled = sample.groupBy(F.col(label).cast("string").alias("seed_id")).agg(
        F.concat_ws("\n", F.transform(parts, lambda p: p["row_as_text"])).alias("row_as_text"))
    knn = _search(materialize(embed(pooled, embedder), "pooled"), index, k, options)
    return label_histogram(_with_label(knn, index, label).withColumnRenamed("seed_id", "seed_label"), "seed_label")


def match_file(spark: SparkSession, path: str, schema: T.StructType, index: Index, out: str, k: int,
               meta: Sequence[str] = (), embedder=HashEmbedder(), options: KnnOptions = KnnOptions()) -> str:
    """A seed file, whose first column is the id, to ``<stem>_output.csv`` with its audience; returns that path."""
    seeds = read_seeds(spark, path, schema.names, schema)
    features = feature_cols(seeds, first_is_id=True)
    return write_result(find_audience(seeds, index, features, k, meta, embedder, options), out, path)


def match_record(spark: SparkSession, record: Mapping[str, object], schema: T.StructType, index: Index, k: int,
                 label: str, domain: Mapping[str, tuple | Sequence] | None = None, embedder=HashEmbedder(),
                 options: KnnOptions = KnnOptions()) -> DataFrame:
    """The neighbours of one domain-checked record: ``(neighbor_id, rank, score, label, fields)``."""
    seed = seed_record(spark, record, schema, domain)
    _, knn = retrieve(seed, index, schema.names, k, embedder, options)
    fields = _rows(index).select(F.col("id").alias("neighbor_id"), "fields")
    return _with_label(knn, index, label).join(fields, "neighbor_id").drop("seed_id")


def by_label(neighbors: DataFrame) -> DataFrame:
    """Neighbours per label, with the best of their scores."""
    return neighbors.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best_score"))
