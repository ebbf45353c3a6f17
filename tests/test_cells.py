import numpy as np
import pytest
from pyspark.sql import functions as F

from kith import KnnOptions
from kith.operators.cells import append_cells, knn_join_cells, needed_cells, read_cells, write_cells
from tests.test_knn import brute, frame, rows


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    centers = np.eye(8)
    corpus = centers[rng.integers(8, size=400)] + 0.02 * rng.normal(size=(400, 8))
    corpus[:130] = centers[2]  # a third of the rows are copies of one
    return corpus, centers[[1, 1, 5]] + 0.02 * rng.normal(size=(3, 8))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_stored_cells_are_exact_and_pruned(spark, data, tmp_path, metric, exclude_self):
    corpus, seeds = data
    write_cells(frame(spark, corpus), f"{tmp_path}/i", cells=24, metric=metric)
    index = read_cells(spark, f"{tmp_path}/i")
    assert index.rows.count() == index.count.sum() == 400
    got = knn_join_cells(frame(spark, seeds), index, 7, KnnOptions(metric, exclude_self))
    assert rows(got) == brute(seeds, corpus, 7, metric, exclude_self)
    used = needed_cells(index, seeds / np.linalg.norm(seeds, axis=1, keepdims=True) if metric == "cosine" else seeds, 8)
    assert len(used) < len(index.pivots) / 2
    assert "PartitionFilters: [cell" in got._jdf.queryExecution().executedPlan().toString()


def test_many_seeds_and_all_of_a_small_index(spark, data, tmp_path):
    corpus, seeds = data
    write_cells(frame(spark, corpus[:40]), f"{tmp_path}/i", cells=5)
    index = read_cells(spark, f"{tmp_path}/i")
    assert rows(knn_join_cells(frame(spark, seeds), index, 100)) == brute(seeds, corpus[:40], 100, "cosine")
    got = knn_join_cells(frame(spark, corpus), index, 3, KnnOptions(broadcast_rows=10))
    assert rows(got) == brute(corpus, corpus[:40], 3, "cosine")
    with pytest.raises(ValueError, match="stored for cosine"):
        knn_join_cells(frame(spark, seeds), index, 3, KnnOptions("l2"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_seeds_beyond_the_broadcast_read_few_cells_too(spark, data, tmp_path, metric):
    corpus, seeds = data
    write_cells(frame(spark, corpus), f"{tmp_path}/i", cells=24, metric=metric)
    index = read_cells(spark, f"{tmp_path}/i")
    many = np.repeat(seeds[:2], 8, axis=0) + 1e-4 * np.arange(16)[:, None]
    got = knn_join_cells(frame(spark, many), index, 7, KnnOptions(metric, broadcast_rows=10))
    assert rows(got) == brute(many, corpus, 7, metric)
    assert "PartitionFilters: [cell" in got._jdf.queryExecution().executedPlan().toString()


def test_growing_cells_equal_a_rebuilt_index(spark, tmp_path):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(6, 8))
    m = np.vstack([centers[rng.integers(6, size=500)] + 0.1 * rng.normal(size=(500, 8)), np.repeat(centers[:1], 90, axis=0)])
    rows = [(i, [float(x) for x in v], f"t{i}") for i, v in enumerate(m)] + [(900, None, "none"), (901, [0.0] * 8, "zero")]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, note string")
    path = f"{tmp_path}/cells"
    write_cells(df.filter("id < 100"), path, cells=5)
    assert append_cells(df.filter("id between 100 and 349"), path, "a")
    assert append_cells(df.filter("id >= 350"), path, "b", max_rows=60)
    before = read_cells(spark, path)
    assert not append_cells(df.filter("id between 100 and 349"), path, "a")  # a repeated load
    (df.limit(5).withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(f"{path}/rows/cell_load=broken"))  # a load that broke off
    index = read_cells(spark, path)
    assert index.rows.count() == before.rows.count() == 590 == index.sizes().sum()
    assert len(index.live) > 5 and sorted(index.sizes()[index.live])[-2] <= 90  # all but equal vectors
    write_cells(df, f"{tmp_path}/whole", cells=40)
    for seeds in (df.filter("id % 50 = 0"), df):
        for options in (KnnOptions(), KnnOptions(plan="partitioned", seed_block_rows=64)):
            if seeds is df and options.plan == "auto":
                continue
            got, want = (sorted(map(tuple, knn_join_cells(seeds, x, 7, options).collect())) for x in (index, read_cells(spark, f"{tmp_path}/whole")))
            assert got == want and got
    assert append_cells(df.filter("id > 899"), path, "nothing to find") and read_cells(spark, path).rows.count() == 590


def test_many_cells_are_compared_in_tiles(spark, tmp_path, monkeypatch):
    """No task holds the distances of more than one tile, however many cells an index has grown to."""
    from kith.operators import kernels

    monkeypatch.setattr(kernels, "TILE_CELLS", 500)
    batch = frame(spark, np.random.default_rng(1).normal(size=(90, 4)), parts=1).toArrow().to_batches()
    sizes = [b.num_rows for b in kernels.in_tiles(iter(batch), "cosine", 50)]
    assert sizes == [10] * 9
