import datetime

from pyspark.sql import functions as F

from kith.sources import read_index, read_table
from kith.streaming import read_stream, stream_index, stream_log


def test_index_load_goes_on_where_it_stopped(spark, tmp_path):
    source, index, progress = (f"{tmp_path}/{x}" for x in ("in", "index", "progress"))
    rows = spark.range(0, 40, 1, 4).withColumn("nation", F.col("id") % 5)

    def load():
        arriving = read_stream(spark, source, rows.schema, files_per_chunk=1)
        stream_index(arriving, index, progress, "id", ["nation"], ["nation"]).awaitTermination()
        return read_index(spark, index)

    rows.write.parquet(source)
    assert load().count() == 40
    assert load().count() == 40  # nothing new, nothing doubled
    rows.withColumn("id", F.col("id") + 100).write.mode("append").parquet(source)
    got = load()
    assert got.count() == 80 and got.select("id").distinct().count() == 80
    assert got.filter("id = 107").first().row_as_text == "nation: 2"


def test_log_stream(spark, tmp_path):
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"
    records = spark.createDataFrame([(datetime.datetime(2024, 5, 1), "q", "a", "s")],
                                    "ts timestamp, question string, answer string, steps string")
    records.write.parquet(source)
    stream_log(read_stream(spark, source, records.schema), log, f"{tmp_path}/progress").awaitTermination()
    assert [(r.question, str(r.day)) for r in read_table(spark, log, "json").collect()] == [("q", "2024-05-01")]
