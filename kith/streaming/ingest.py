from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kith.operators.embed import HashEmbedder, embed
from kith.operators.shape import row_as_text
from kith.sources.writers import index_rows


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_chunk: int | None = None) -> DataFrame:
    """New files of a folder; ``files_per_chunk`` sets how many make one chunk."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_chunk:
        reader = reader.option("maxFilesPerTrigger", files_per_chunk)
    return reader.load(path)


def _start(df: DataFrame, path: str, checkpoint: str, fmt: str, by: Sequence[str] = ()) -> StreamingQuery:
    writer = (df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
              .outputMode("append").trigger(availableNow=True))
    return (writer.partitionBy(*by) if by else writer).start()


def stream_index(rows: DataFrame, path: str, checkpoint: str, id_col: str, features: Sequence[str],
                 meta_cols: Sequence[str] = (), embedder=HashEmbedder(), metric: str = "cosine") -> StreamingQuery:
    """Append all new rows to a Parquet index, chunk by chunk, and stop.

    A restarted load goes on after the last finished chunk, so entries are never doubled.
    """
    texts = row_as_text(rows, features, canonical=True)
    ready = index_rows(embed(texts, embedder), id_col, "row_as_text", "embedding", meta_cols, features, metric)
    return _start(ready, path, checkpoint, "parquet")


def stream_log(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append interaction records ``(ts, question, answer, steps)`` as JSON, one folder per day."""
    ready = records.select("ts", "question", "answer", "steps", F.to_date("ts").alias("day"))
    return _start(ready, path, checkpoint, "json", ["day"])
