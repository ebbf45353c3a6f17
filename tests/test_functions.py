import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kith import functions as K
from kith.functions.vectors import hash_vector
from kith.operators import shape


def one(df, col):
    return df.select(col.alias("x")).first()[0]


def text_df(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")


def test_row_text_leaves_out_null_pairs(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "b", 4)], "id int, x string, y int")
    got = [r.row_as_text for r in shape.row_as_text(df, ["x", "y"]).orderBy("id").collect()]
    assert got == ["x: a", "", "x: b; y: 4"]


def test_canonical_numbers_read_the_same_on_both_sides(spark):
    a = spark.createDataFrame([(0.0,), (0.077,), (1438.30,), (1e-3,), (float("nan"),), (-0.0,)], "v double")
    b = spark.createDataFrame([("0",), ("0.077",), ("1438.3",), ("0.001",), (None,), ("0",)], "v string")
    text = [r[0] for r in shape.row_as_text(a, ["v"], canonical=True).select("row_as_text").collect()]
    assert text == [r[0] for r in shape.row_as_text(b, ["v"], canonical=True).select("row_as_text").collect()]
    big = spark.createDataFrame([(12345678.5,), (100.0,)], "v double")
    assert [r[0] for r in shape.row_as_text(big, ["v"], canonical=True).select("row_as_text").collect()] == [
        "v: 12345678.5", "v: 100"]


@pytest.mark.parametrize("text,want", [
    ("a: 1; b: 2", {"a": "1", "b": "2"}),
    ("a: x: y", {"a": "x: y"}),
    ("a: 1; bare; b: ", {"a": "1", "bare": None, "b": ""}),
    ("a: 1; b: 2; a: 3", {"b": "2", "a": "3"}),
    ("", {}),
])
def test_text_map(spark, text, want):
    assert one(text_df(spark, text), K.text_map(F.col("t"))) == want


def test_text_round_trip(spark):
    df = spark.createDataFrame([("u", "v: w", None), (None, "z", "q")], "a string, b string, c string")
    back = shape.text_to_columns(shape.row_as_text(df, ["a", "b", "c"]).select("row_as_text"), ["a", "b", "c"])
    assert back.select("a", "b", "c").collect() == df.collect()


def test_text_field(spark):
    df = text_df(spark, "a: 1; b: 2")
    assert one(df, K.text_field(F.col("t"), "b")) == "2"


def test_tenure_months_cuts_towards_zero_and_skips_bad_dates(spark):
    df = text_df(spark, "1/15/2020", "1/16/2020", "31/31/2020", None)
    got = [r[0] for r in df.orderBy("id").select(K.tenure_months(F.col("t"), as_of="2021-03-15")).collect()]
    assert got == [14, 13, None, None]


def test_bucket_label_edges(spark):
    df = spark.createDataFrame([(4999.99,), (5000.0,), (10000.0,), (-3.0,), (None,)], "v double")
    assert [r[0] for r in df.select(K.bucket_label(F.col("v"), 5000)).collect()] == [
        "Under 5k", "5k - 10k", "10k - 15k", "Under 5k", None]


def test_metadata_map_is_text_and_meta_get_has_a_default(spark):
    df = spark.createDataFrame([(1, 2.5)], "Id int, v double").withColumn("m", K.metadata_map(["Id", "v"]))
    assert df.first().m == {"Id": "1", "v": "2.5"}
    assert one(df, K.meta_get(F.col("m"), "Id")) == "1"
    assert one(df, K.meta_get(F.col("m"), "target")) == "Unknown"
    encoded = text_df(spark, '{"target": "yes"}', '{}', "broken")
    got = [r[0] for r in encoded.orderBy("id").select(K.meta_get(F.col("t"), "target", encoded=True)).collect()]
    assert got == ["yes", "Unknown", "Unknown"]


def test_compare_counts_null_as_different(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "a int, b int")
    assert [r[0] for r in df.select(K.compare(F.col("a"), F.col("b"))).collect()] == ["same", "different", "different"]


def test_keywords_and_suffix(spark):
    df = text_df(spark, "Plot the CHART", "no such word", "graphs please")
    flag = K.flag_keywords(F.col("t"), ["chart", "charts", "graph", "graphs", "plot", "plt", "plots"])
    got = df.orderBy("id").select(flag, K.append_if(F.col("t"), flag, " . save")).collect()
    assert [r[0] for r in got] == [True, False, True]
    assert [r[1] for r in got] == ["Plot the CHART . save", "no such word", "graphs please . save"]


def test_step_extraction(spark):
    df = text_df(spark, "think Action: run Action Input: df.head()", "only a thought")
    rows = shape.extract_steps(df.withColumn("seen", F.lit("ok")), "t", "seen").orderBy("id").collect()
    assert (rows[0].thought, rows[0].action, rows[0].action_input) == ("think ", " run ", " df.head()")
    assert rows[0].step == "think Action: run Action Input: df.head() Observation: ok"
    assert (rows[1].thought, rows[1].action, rows[1].action_input) == ("only a thought", None, None)


def test_to_int_gives_null_for_text(spark):
    df = text_df(spark, "5", "7.9", "No Record", "-2.5", "99999999999")
    assert [r[0] for r in df.orderBy("id").select(K.to_int(F.col("t"))).collect()] == [5, 7, None, -2, None]


def test_hash_vector_counts_every_pair(spark):
    text, dim = "a: 1; b: 2; a: 1\nc: é", 16
    want = [0.0] * dim
    for token in ["a: 1", "b: 2", "a: 1", "c: é"]:
        want[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
    assert one(text_df(spark, text), hash_vector(F.col("t"), dim)) == want


def test_unit_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(K.unit_vector(F.col("v"))).collect()] == [[0.6, 0.8], None]


def test_canonical_text_leaves_nulls_out(spark):
    from kith.operators.shape import row_as_text

    df = spark.createDataFrame([(1, None, None), (2, 0.50, Decimal("1.20"))], "id int, x double, y decimal(9,2)")
    got = [r.row_as_text for r in row_as_text(df, ["id", "x", "y"], canonical=True).orderBy("id").collect()]
    assert got == ["id: 1", "id: 2; x: 0.5; y: 1.2"]
