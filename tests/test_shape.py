from pyspark.sql import functions as F

from kith import functions as K
from kith.operators import sampling, sets, shape, topk

# A booking table as a CSV reader gives it, and what its master table must look like.
BOOKINGS = [
    ("34", "No", "Middle Income", "6", "No", "Yes", "0"), ("34", "Yes", "Low Income", "5", "Yes", "No", "1"),
    ("37", "No", "Middle Income", "3", "Yes", "No", "0"), ("30", "No", "Middle Income", "2", "No", "No", "0"),
    ("30", "No Record", "Low Income", "none", "No", "No", "1"),
]
COLUMNS = "Age FrequentFlyer AnnualIncomeClass ServicesOpted AccountSynced BookedHotel Target".split()


def bookings(spark):
    return spark.createDataFrame(BOOKINGS, COLUMNS).coalesce(1)


def master(spark):
    df = shape.rename(bookings(spark), {"FrequentFlyer": "FrequentWatcher", "BookedHotel": "BookedFood"})
    df = shape.with_row_id(df, name="Id")
    return shape.derive(df, "ServicesOpted", K.to_int(F.col("ServicesOpted").try_cast("double") + 2))


def test_master_table(spark):
    df = shape.drop(master(spark), "Target", "absent")
    assert df.columns == ["Age", "FrequentWatcher", "AnnualIncomeClass", "AccountSynced", "BookedFood", "Id",
                          "ServicesOpted"]
    assert [(r.Id, r.ServicesOpted) for r in df.collect()] == [(0, 8), (1, 7), (2, 5), (3, 4), (4, None)]


def test_balanced_sample(spark):
    got = sampling.balanced_sample(master(spark), "Target", "Id", 2, labels=("1", "0"))
    assert sorted(r.Id for r in got.collect()) == [0, 1, 2, 4]


def test_feature_cols(spark):
    df = master(spark)
    assert shape.feature_cols(df, "Id", "Target") == [c for c in df.columns if c not in ("Id", "Target")]
    assert shape.feature_cols(df, first_is_id=True) == df.columns[1:]


def test_constant(spark):
    assert shape.constant(spark.range(2), "d", "x").collect() == [(0, "x"), (1, "x")]


def test_dense_row_id_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).withColumn("v", F.xxhash64("id"))
    got = shape.with_row_id(df.select("v"), ["v"], "n").orderBy("v").collect()
    assert [r.n for r in got] == list(range(5000))


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(2000)
    a, b = sampling.split(df, [80, 20], "id")
    ids = {r.id for r in a.collect()}
    assert ids.isdisjoint({r.id for r in b.collect()}) and a.count() + b.count() == 2000
    assert 0.75 < len(ids) / 2000 < 0.85
    assert {r.id for r in sampling.split(df.repartition(13), [80, 20], "id")[0].collect()} == ids
    assert {r.id for r in sampling.split(df, [80, 20], "id", salt="x")[0].collect()} != ids


def test_sample_per_label_takes_the_same_rows_from_a_hot_label(spark):
    df = spark.range(0, 3000, 1, 8).withColumn("label", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7))
    got = sampling.sample_per_label(df, "label", "id", 20, 10)
    assert {r["count"] for r in got.groupBy("label").count().collect()} == {10}
    assert sorted(got.collect()) == sorted(sampling.sample_per_label(df.repartition(3), "label", "id").collect())
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_random_split_keeps_all_rows(spark):
    parts = sampling.random_split(spark.range(100), [0.8, 0.2], 42)
    assert sum(p.count() for p in parts) == 100


def test_salted_top_equals_plain_top(spark):
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"))
    order = [F.col("v").desc()]
    plain = topk.top_per_group(df, ["g"], order, 9)
    salted = topk.top_per_group(df, ["g"], order, 9, salts=8, salt_by=["v"])
    assert sorted(plain.collect()) == sorted(salted.collect())


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "i int, s string")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "s string, i int")
    assert sets.union_all(a, b).count() == 4
    assert sorted(sets.union_distinct(a, b).collect()) == [(1, "x"), (2, "y")]


def test_attach_label_casts_text_ids_and_keeps_unknown_ones(spark):
    nbrs = spark.createDataFrame([(1, "7"), (1, "8"), (2, "?")], "seed_id int, neighbor_id string")
    labels = spark.createDataFrame([(7, "yes")], "id long, y string")
    got = sets.attach_label(nbrs, labels, "id", "y").collect()
    assert sorted((r.neighbor_id, r.label or "") for r in got) == [("7", "yes"), ("8", ""), ("?", "")]


def test_mode_label_and_top_m(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 9.1), ("b", 10.2), ("a", -5.0)], "l string, s double")
    assert topk.mode_label(df, "l").collect() == [("a", 2)]
    assert [r.s for r in topk.top_m(df, F.col("s").desc(), 3).collect()] == [10.2, 9.1, 1.0]
