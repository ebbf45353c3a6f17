"""The registered queries on the small tables, against their SQL where they have it; the stages of the pipeline."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kith.llm import mixing, pii, quality
from kith.llm.queries import ORACLES, QUERIES
from tests.check_oracles import compare, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, views(FOLDER), FOLDER, name, QUERIES[name], ORACLES.get(name)) is None


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    from tests.llm.test_table_operators import plain_components

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before, docs
        if name != "tokens":
            assert docs.columns == before.columns
    before, after = kept["quality_rules"]
    verdict = {r.doc_id for r in quality.quality_rules(before).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == verdict
    before, after = kept["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    groups = plain_components([t for _, t in rows], 5, 80)
    assert {r.doc_id for r in after.collect()} == {rows[i][0] for i, (n, c) in groups.items() if c == i or not n}
    before, after = kept["personal_data"]
    assert sorted(r.doc_id for r in before.collect()) == sorted(r.doc_id for r in after.collect())
    assert not any(pii.base_spans(r.text) for r in after.collect() if r.text)
    before, after = kept["mix_sources"]
    ids = {r.doc_id for r in before.collect()}
    drawn = [r.doc_id for r in after.collect()]
    assert set(drawn) <= ids and max(map(drawn.count, set(drawn))) <= 3
    before, after = kept["tokens"]
    assert after.count() == before.count() and "ids" in after.columns


def test_mix_is_dealt_to_shards_and_shuffled(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {}
    for x in mixing.mix(docs).collect():
        for d in x.draws:
            want.setdefault(d.shard, []).append((d.place, x.doc_id))
    assert len(want) == 16
    parts = {}
    for x in corpus_pipeline.mix_sources(spark, docs, FOLDER).withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(x.part, []).append(x.doc_id)
    found = [",".join(map(str, ["", *ids, ""])) for ids in parts.values()]
    for drawn in want.values():
        run = ",".join(map(str, ["", *(i for _, i in sorted(drawn)), ""]))
        assert any(run in f for f in found)
    assert sum(map(len, parts.values())) == sum(map(len, want.values()))
    more = mixing.sized_options(30 << 30)
    assert mixing.sized_options(0) == mixing.MixOptions() and (1 << more.levels) * mixing.SHARD_BYTES >= 30 << 30


def test_near_duplicates_tell_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (1, a), (5, a + " more"), (5, b), (None, b), (None, c), (None, c), (9, None), (9, None), (None, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, df, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b), (None, c), (9, None), (9, None), (None, " ")], key=str)
