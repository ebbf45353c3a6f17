import numpy as np
import pytest
from pyspark.sql import functions as F

from kith.operators import audience as A
from kith.operators import rerank as R
from kith.operators import vote as V
from kith.operators.embed import HashEmbedder, ModelEmbedder, ModelScorer, TokenJaccard, embed


def pairs(spark, rows):
    return spark.createDataFrame(rows, "seed_id long, neighbor_id long, pair_score double")


def literal_prefix(rows, m):
    """The growing pool, seed by seed: keep what is in its best m after each seed."""
    pool, kept = set(), set()
    for seed in sorted({r[0] for r in rows}):
        pool |= {(n, s) for i, n, s in rows if i == seed}
        kept |= set(sorted(pool, key=lambda p: (-p[1], p[0]))[:m])
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_prefix_rerank_equals_the_growing_pool(spark, monkeypatch, seed):
    monkeypatch.setattr(R, "BLOCK_SEEDS", 3)
    monkeypatch.setattr(R, "BLOCK_GROUP", 2)
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(n), round(float(s), 1)) for i, n, s in
            zip(rng.integers(30, size=200), rng.integers(60, size=200), rng.normal(size=200) * 3)]
    got = R.rerank(pairs(spark, rows), 6, mode="prefix")
    assert {tuple(r) for r in got.collect()} == literal_prefix(rows, 6)
    assert got.count() == len(literal_prefix(rows, 6))


def test_seed_rerank_sorts_scores_as_numbers(spark):
    rows = [(1, n, s) for n, s in enumerate([10.2, 9.1, -5.0, -10.1, 0.3])]
    got = R.rerank(pairs(spark, rows), 2)
    assert {r.score for r in got.collect()} == {10.2, 9.1}


def test_seed_rerank_counts_equal_rows_once(spark):
    rows = [(1, 7, 0.5), (1, 7, 0.5), (1, 8, 0.4), (2, 7, 0.5)]
    assert sorted(tuple(r) for r in R.rerank(pairs(spark, rows), 2).collect()) == [(7, 0.5), (8, 0.4)]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        R.rerank(pairs(spark, [(1, 1, 1.0)]), 1, mode="?")


@pytest.mark.parametrize("k,least,want", [(20, 5, 5), (100, 5, 10), (50, 0, 5), (9, 0, 0)])
def test_rerank_depth(k, least, want):
    assert R.rerank_depth(k, least) == want


def test_rescoring_with_tokens_and_with_a_model(spark):
    df = spark.createDataFrame([("a: 1; b: 2", "a: 1; b: 3"), ("", ""), ("a: 1", "a: 1")], "seed_text string, neighbor_text string")
    assert [r[0] for r in R.rescore(df, TokenJaccard()).select("pair_score").collect()] == [0.333333333, 0.0, 1.0]
    model = ModelScorer(lambda: lambda a, b: [len(x) - len(y) for x, y in zip(a, b)])
    assert [r[0] for r in R.rescore(df, model).select("pair_score").collect()] == [0.0, 0.0, 0.0]


def test_embedders(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, None), (4, "ab")], "id int, row_as_text string")
    model = ModelEmbedder(lambda: lambda texts: [[len(t), 1.0] for t in texts])
    got = {r.id: r.embedding for r in embed(df, model).collect()}
    assert got == {1: [2.0, 1.0], 2: [3.0, 1.0], 3: None, 4: [2.0, 1.0]}
    assert dict(embed(df, HashEmbedder(8)).dtypes)["embedding"] == "array<float>"


def labelled(spark):
    # seed 1: tie of x and y, y is nearer; seed 2: one label only
    return spark.createDataFrame(
        [(1, 10, 1, "y"), (1, 11, 2, "x"), (1, 12, 3, "x"), (1, 13, 4, "y"), (2, 10, 1, "y")],
        "seed_id int, neighbor_id int, rank int, label string")


def test_vote_tie_goes_to_the_label_met_first(spark):
    assert dict(V.vote(labelled(spark)).collect()) == {1: "y", 2: "y"}


def test_reranked_vote_uses_the_best_pairs_only(spark):
    scored = labelled(spark).withColumn("pair_score", F.col("neighbor_id").cast("double"))
    # best three of seed 1: y (13), x (12), x (11)
    assert dict(V.vote_reranked(scored, 3).collect()) == {1: "x", 2: "y"}
    by_x = scored.withColumn("pair_score", F.when(F.col("label") == "x", 10.5).otherwise(1.0))
    assert dict(V.vote_reranked(by_x, 2).collect()) == {1: "x", 2: "y"}


def test_label_histogram_counts_a_neighbour_once(spark):
    df = labelled(spark).withColumn("group", F.lit("g"))
    assert sorted(tuple(r) for r in V.label_histogram(df, "group").collect()) == [("g", "x", 2), ("g", "y", 2)]


def test_propagate_max_is_a_set_and_may_drop_the_label(spark):
    seeds = spark.createDataFrame([(1, "t"), (1, "t"), (2, "u")], "id int, text string")
    nbrs = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "seed_id int, label int")
    assert sorted(tuple(r) for r in A.propagate_max(seeds, nbrs).collect()) == [(1, "t", 1), (2, "u", 0)]
    assert A.propagate_max(seeds, nbrs, keep_label=False).columns == ["id", "text"]


def test_lookalike_is_a_set_with_fields(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b")],
                                   "id long, embedding array<double>, seg string")
    seeds = corpus.filter("id < 3")
    got = A.lookalike(seeds, corpus, 2, ["id", "seg"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, "a")]
    assert A.lookalike(seeds, corpus, 2, ["seg"]).collect() == [("a",)]


def test_pooled_texts_keep_order_and_size(spark):
    df = spark.range(0, 7, 1, 4).select("id", F.concat(F.lit("t"), "id").alias("row_as_text"))
    got = {r.batch: r.row_as_text for r in A.pooled_texts(df, "id", size=3).collect()}
    assert got == {0: "t0\nt1\nt2", 1: "t3\nt4\nt5", 2: "t6"}


def test_pooled_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "g string, embedding array<float>")
    assert dict(tuple(r) for r in A.pooled_vectors(df, "g").collect()) == {"a": [2.0, 3.0], "b": [5.0, 6.0]}


def test_audience_score_and_budget(spark):
    knn = spark.createDataFrame([(1, 9, 0.5), (2, 9, 0.25), (1, 8, 1.0)], "seed_id int, neighbor_id int, score double")
    got = {r.neighbor_id: tuple(r)[1:] for r in A.audience_score(knn).collect()}
    assert got == {9: (0.5, 0.375, 2), 8: (1.0, 1.0, 1)}
    members = spark.createDataFrame([("u", 1.1), ("u", None), ("v", 3.0)], "b string, amount double")
    assert {tuple(r) for r in A.bucket_budget(members, "b", "amount").collect()} == {("u", 2, 1.1, 1.1), ("v", 1, 3.0, 3.0)}


def test_null_labels_dont_vote(spark):
    from kith.operators.vote import vote

    rows = [(1, 1, None), (1, 2, None), (1, 3, "x"), (2, 1, None)]
    got = vote(spark.createDataFrame(rows, "seed_id long, rank int, label string"))
    assert {tuple(r) for r in got.collect()} == {(1, "x"), (2, None)}


def test_a_missing_tenure_is_not_the_longest(spark):
    from pyspark.sql import functions as F

    from kith.operators.report import profile

    df = spark.createDataFrame([(1, 5), (2, None), (3, 30)], "id long, months int")
    row = profile(df, "id", F.lit(True), F.lit(True), "months").first()
    assert (row.longest_id, row.longest_months) == (3, 30)


@pytest.mark.parametrize("kind", ["sparse", "text"])
def test_prefix_rerank_with_any_seed_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(R, "BLOCK_SEEDS", 2)
    monkeypatch.setattr(R, "BLOCK_GROUP", 3)
    rng = np.random.default_rng(5)
    ids = [i * 10**12 - 7 for i in range(40)] if kind == "sparse" else [f"s{i:03d}" for i in range(40)]
    rows = [(ids[i], int(n), round(float(s), 1)) for i, n, s in
            zip(rng.integers(40, size=300), rng.integers(80, size=300), rng.normal(size=300) * 3)]
    df = spark.createDataFrame(rows, f"seed_id {'long' if kind == 'sparse' else 'string'}, neighbor_id long, pair_score double")
    got = [tuple(r) for r in R.rerank(df, 5, mode="prefix").collect()]
    assert len(got) == len(set(got)) and set(got) == literal_prefix(rows, 5)


def test_prefix_rerank_of_nothing(spark):
    assert R.rerank(pairs(spark, []), 5, mode="prefix").count() == 0
