import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kith.operators.embed import embed
from kith.operators.shape import row_as_text
from kith.sources import (
    append_index, append_log, in_domain, new_folder, read_index, read_seeds, read_table, seed_record, write_csv,
    write_result,
)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, 'a "q", b', 2.5), (2, None, 0.0)], "id long, name string, v double")


def test_csv_without_types_is_all_text(spark, people, tmp_path):
    write_csv(people, f"{tmp_path}/x")
    back = read_table(spark, f"{tmp_path}/x", "csv")
    assert {f.dataType for f in back.schema.fields} == {T.StringType()}
    assert sorted(back.collect())[0] == ("1", 'a "q", b', "2.5")


def test_csv_typed_by_schema_or_inference(spark, people, tmp_path):
    write_csv(people, f"{tmp_path}/x")
    assert sorted(read_table(spark, f"{tmp_path}/x", "csv", people.schema).collect()) == sorted(people.collect())
    kinds = dict(read_table(spark, f"{tmp_path}/x", "csv", infer=True).dtypes)
    assert kinds == {"id": "int", "name": "string", "v": "double"}


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/nowhere", "xml")


def test_seed_file_follows_its_extension(spark, people, tmp_path):
    write_csv(people, f"{tmp_path}/s.txt")
    people.write.json(f"{tmp_path}/s.json")
    for name in ("s.txt", "s.json"):
        got = read_seeds(spark, f"{tmp_path}/{name}", ["name", "id"], people.schema)
        assert got.columns == ["name", "id"] and got.count() == 2
    with pytest.raises(ValueError, match="not supported"):
        read_seeds(spark, f"{tmp_path}/s.pdf", ["id"])
    with pytest.raises(ValueError, match="not supported"):
        read_seeds(spark, f"{tmp_path}/s.json", ["id"], allowed=("txt", "csv"))
    with pytest.raises(ValueError, match="lacks columns: age"):
        read_seeds(spark, f"{tmp_path}/s.txt", ["id", "age"])


DOMAIN = {"age": (18, 70), "sex": ["male", "female"]}
FORM = T.StructType([T.StructField("age", T.IntegerType()), T.StructField("sex", T.StringType())])


def test_seed_record_domain(spark):
    assert seed_record(spark, {"age": 18, "sex": "male"}, FORM, DOMAIN).collect() == [(18, "male")]
    for bad in ({"age": 17, "sex": "male"}, {"age": 30, "sex": "?"}):
        with pytest.raises(ValueError):
            seed_record(spark, bad, FORM, DOMAIN)


def test_in_domain(spark):
    df = spark.createDataFrame([(18, "male"), (71, "male"), (40, "x"), (None, "male")], FORM)
    assert in_domain(df, DOMAIN).collect() == [(18, "male")]


def test_single_file_only_where_the_caller_says_so(spark, tmp_path):
    df = spark.range(0, 100, 1, 4)
    parts = lambda p: len([f for f in p.iterdir() if f.name.startswith("part-")])
    write_csv(df, f"{tmp_path}/one", single=True)
    write_csv(df, f"{tmp_path}/many")
    assert parts(tmp_path / "one") == 1 and parts(tmp_path / "many") > 1
    assert read_table(spark, f"{tmp_path}/many", "csv").count() == 100


def test_result_name(spark, people, tmp_path):
    assert write_result(people, str(tmp_path), "in/seeds.v1.csv") == f"{tmp_path}/seeds_output.csv"
    assert write_result(people, str(tmp_path)) == f"{tmp_path}/output.csv"


def test_index_appends_and_reads_unique(spark, people, tmp_path):
    rows = embed(row_as_text(people, ["name"]))
    for _ in range(2):
        append_index(rows, f"{tmp_path}/i", meta_cols=["id", "v"])
    assert read_index(spark, f"{tmp_path}/i").count() == 4
    index = read_index(spark, f"{tmp_path}/i", unique=True)
    assert index.count() == 2
    assert index.filter("id = 1").first().metadata == {"id": "1", "v": "2.5"}
    assert dict(index.dtypes)["embedding"] == "array<float>"


def test_log_appends_by_day(spark, tmp_path):
    for day in (1, 2):
        append_log(spark.createDataFrame(
            [(datetime.datetime(2024, 1, day), "q\n", "ä", f"s{day}")],
            "ts timestamp, question string, answer string, steps string"), f"{tmp_path}/log")
    back = read_table(spark, f"{tmp_path}/log", "json")
    assert sorted((r.question, r.answer, r.steps, str(r.day)) for r in back.collect()) == [
        ("q\n", "ä", "s1", "2024-01-01"), ("q\n", "ä", "s2", "2024-01-02")]


class NamedSession:
    class conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.checkpoint.dir": "/shared/place/"}.get(key, default)


def test_workspace_follows_the_session(spark):
    assert new_folder(spark, "a") != new_folder(spark, "a")
    assert new_folder(NamedSession, "a").startswith("/shared/place/a-")


def test_a_repeated_load_replaces_itself(spark, tmp_path):
    from kith.operators.index import build_index

    path = f"{tmp_path}/index"
    make = lambda ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")
    build_index(make([1, 2]), path, "id", load="a")
    build_index(make([3]), path, "id", load="b")
    index = build_index(make([1, 2, 4]), path, "id", load="a")
    assert sorted(r.id for r in index.collect()) == [1, 2, 3, 4]
    assert index.schema["embedding"].metadata["metric"] == "cosine"
