import numpy as np
from pyspark.sql import functions as F

from kith.operators import evaluate as E
from kith.operators import report
from kith.operators import audience as A
from kith.operators.index import project_2d


def judged(spark, rows):
    return spark.createDataFrame(rows, "label string, predicted string")


ROWS = [("A", "A"), ("A", "B"), ("B", "B"), ("C", "A"), (None, "A"), ("A", None)]


def test_accuracy_skips_nulls(spark):
    assert E.accuracy(judged(spark, ROWS)).collect() == [(2, 2, 50.0, 50.0)]
    assert E.accuracy(judged(spark, [(None, "A")])).collect() == [(0, 0, 0.0, 0.0)]


def test_binary_metrics(spark):
    r = E.binary_metrics(judged(spark, ROWS), "A", "B").first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 0, 1, 1) and (r.precision, r.recall) == (1.0, 0.5)
    rest = E.binary_metrics(judged(spark, ROWS), "A").first()
    assert (rest.tp, rest.fp, rest.tn, rest.fn) == (1, 1, 1, 1)
    none = E.binary_metrics(judged(spark, [("B", "B")]), "A").first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_multiclass_metrics_cover_absent_classes(spark):
    got = {r["class"]: r for r in E.multiclass_metrics(judged(spark, ROWS), ["A", "B", "C", "D"]).collect()}
    assert {c: (r.tp, r.fp, r.fn) for c, r in got.items()} == {
        "A": (1, 1, 1), "B": (1, 1, 0), "C": (0, 0, 1), "D": (0, 0, 0)}
    assert got["D"].f1 == 0.0 and abs(got["B"].f1 - 2 / 3) < 1e-12
    assert E.multiclass_metrics(judged(spark, ROWS)).count() == 3


def test_confusion_has_zero_cells_and_sums_to_the_rows(spark):
    df, classes = judged(spark, ROWS[:4]), ["A", "B", "C", "D"]
    cells = {(r.truth, r.predicted): r.n for r in E.confusion(df, classes).collect()}
    assert len(cells) == 16 and sum(cells.values()) == 4 and cells["C", "A"] == 1
    wide = E.confusion_wide(df, classes)
    assert wide.columns == ["truth", *classes]
    assert [tuple(r) for r in wide.collect()] == [(t, *[cells[t, p] for p in classes]) for t in classes]


def test_class_counts_in_order(spark):
    got = [tuple(r) for r in E.class_counts(judged(spark, ROWS[:4])).collect()]
    assert got == [("predicted", "A", 2), ("predicted", "B", 2), ("truth", "A", 2), ("truth", "B", 1), ("truth", "C", 1)]


def test_counts(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "id int, tags array<string>")
    assert report.row_count(df).collect() == [(2,)]
    assert sorted(report.value_counts(df, "tags").collect()) == [("a", 2), ("b", 1)]
    assert report.count_if(df, one=F.col("id") == 1, all=F.col("id") > 0).collect() == [(1, 2)]


def test_profile_names_the_smallest_id_of_a_tie(spark):
    df = spark.createDataFrame([(3, 1, "m", 25), (2, 0, "s", 25), (1, 1, "m", 7)], "id int, complain int, status string, months int")
    got = report.profile(df, "id", F.col("complain") == 1, F.col("status") == "m", "months").first()
    assert tuple(got) == (2, 2, 25, 2, 2)


def test_histogram_and_group_sum(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 4.99), ("b", 5.0), ("b", 10.0), ("b", -1.0)], "g string, v double")
    assert {tuple(r) for r in report.histogram(df, "v", 0, 10, 2).collect()} == {(0, 1), (1, 2), (2, 1), (3, 1)}
    assert {tuple(r) for r in report.group_sum(df, ["g"], "v").collect()} == {("a", 4.99, 2), ("b", 14.0, 3)}


def test_projection_orders_variance_and_defaults_the_label(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(200, 5)) * [5, 2, 0.1, 0.1, 0.1]
    rows = [(i, [float(x) for x in p], {"target": "t"} if i % 2 else {}) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>, metadata map<string,string>")
    got = project_2d(df).orderBy("id").collect()
    assert np.var([r.x for r in got]) > np.var([r.y for r in got]) > 1
    assert {r.label for r in got} == {"t", "Unknown"}
    _, _, axes = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)
    want = points @ axes[:2].T
    assert np.allclose(np.abs([[r.x, r.y] for r in got]), np.abs(want), atol=1e-6)


def test_sums_of_large_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0.1), ("a", 0.2), ("a", None), ("big", 1e20), ("big", 0.5), ("nan", nan), ("nan", 1.0), ("inf", inf), ("inf", 1e15), ("both", inf), ("both", -inf), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (str(r.total), r.n) for r in report.group_sum(df, ["g"], "v").collect()}
    assert got == {"a": ("0.3", 3), "big": ("1e+20", 2), "nan": ("nan", 2), "inf": ("inf", 2), "both": ("nan", 2), "none": ("None", 1)}
    budget = {r.g: (str(r.mean_amount), str(r.total_amount), r.n) for r in A.bucket_budget(df, "g", "v").collect()}
    assert budget["a"] == ("0.15", "0.3", 3) and budget["big"] == ("5e+19", "1e+20", 2) and budget["nan"] == ("nan", "nan", 2) and budget["none"] == ("None", "None", 1)


def test_projection_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], {}), (2, None, {"target": "x"}), (3, [float("nan"), 1.0], {}), (4, [3.0, 2.5], {}), (5, [None, 1.0], {})],
                               "id long, embedding array<double>, metadata map<string,string>")
    got = {r.id: (r.label, r.x is None) for r in project_2d(df).collect()}
    assert got == {1: ("Unknown", False), 2: ("x", True), 3: ("Unknown", True), 4: ("Unknown", False), 5: ("Unknown", True)}
    assert project_2d(df.limit(0)).collect() == [] and project_2d(df.filter("id = 2")).first().x is None
