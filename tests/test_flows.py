import pytest

from kith.operators import flows
from kith.operators.embed import TokenJaccard
from kith.operators.index import build_index
from kith.options import KnnOptions

SCHEMA = "id long, job string, amt double, label string"


@pytest.fixture
def index(spark, tmp_path):
    rows = [(1, "a; b", 0.0, "x"), (2, "a; b", 2.5, "y"), (3, "c", 7.0, None), (4, None, 7.0, "x")]
    return build_index(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/index", "id", "label", ["job", "amt"])


def test_values_with_separators_survive(spark, index):
    seeds = spark.createDataFrame([("a; b", 0)], "job string, amt int")
    got = flows.find_audience(seeds, index, ["job", "amt"], 1, ["id"]).collect()
    assert [tuple(r) for r in got] == [("a; b", "0.0", "1")]  # 0 and 0.0 give equal text
    best = flows.find_reranked(seeds, index, ["job", "amt"], 4, TokenJaccard(), 1).collect()
    assert [tuple(r) for r in best] == [("a; b", "0.0", 1.0)]


def test_missing_values_and_labels(spark, index):
    seeds = spark.createDataFrame([(None, 7.0)], "job string, amt double")
    got = flows.find_audience(seeds, index, ["job", "amt"], 2, ["label"]).collect()
    assert {tuple(r) for r in got} == {(None, "7.0", "x"), ("c", "7.0", None)}


def test_seeds_without_neighbours_stay(spark, index):
    seeds = spark.createDataFrame([("c", 7.0), (None, None)], "job string, amt double")
    for flow in (flows.classify, flows.spread_label):
        got = {(r.job, r.amt): r.predicted for r in flow(seeds, index, ["job", "amt"], 1, "label").collect()}
        assert set(got) == {("c", 7.0), (None, None)} and got[(None, None)] is None
    assert flows.classify_reranked(seeds, index, ["job", "amt"], 1, "label", TokenJaccard()).count() == 2


def test_the_metric_of_an_index_is_checked(spark, index):
    seeds = spark.createDataFrame([("c", 7.0)], "job string, amt double")
    with pytest.raises(ValueError, match="stored for cosine"):
        flows.find_audience(seeds, index, ["job", "amt"], 1, options=KnnOptions(metric="l2"))


def test_a_record_outside_its_domain_is_an_error(spark, index):
    schema = spark.createDataFrame([], "job string, amt double").schema
    got = flows.match_record(spark, {"job": "c", "amt": 7.0}, schema, index, 1, "label", {"amt": (0, 10)}).collect()
    assert [(r.neighbor_id, r.label) for r in got] == [(3, "Unknown")]
    with pytest.raises(ValueError):
        flows.match_record(spark, {"job": "c", "amt": 70.0}, schema, index, 1, "label", {"amt": (0, 10)})


def test_flows_take_stored_cells_and_graphs(spark, index, tmp_path):
    from kith.operators.cells import append_cells, read_cells, write_cells
    from kith.operators.graph import read_graph, write_graph

    write_cells(index.filter("id < 4"), f"{tmp_path}/cells", cells=2)
    append_cells(index.filter("id = 4"), f"{tmp_path}/cells", "more")
    write_graph(index, f"{tmp_path}/graph")
    seeds = spark.createDataFrame([("c", 7.0), (None, None), ("a; b", 2.5)], "job string, amt double")
    for other in (read_cells(spark, f"{tmp_path}/cells"), read_graph(spark, f"{tmp_path}/graph")):
        for flow in (lambda i: flows.find_audience(seeds, i, ["job", "amt"], 2, ["id", "label"]),
                     lambda i: flows.classify(seeds, i, ["job", "amt"], 2, "label"),
                     lambda i: flows.find_reranked(seeds, i, ["job", "amt"], 3, TokenJaccard())):
            got, want = (sorted(map(tuple, flow(i).collect()), key=str) for i in (other, index))
            assert got == want and got
        with pytest.raises(ValueError, match="stored for cosine"):
            flows.find_audience(seeds, other, ["job", "amt"], 1, options=KnnOptions(metric="l2"))
