from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kith.functions.scalars import metadata_map


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """CSV with header and no index column, written by all tasks in parallel parts, each with its header.

    With ``single`` one task writes one file, however large the result is: the caller knows its size.
    """
    if single:
        df = df.repartition(1)
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def result_path(folder: str, stem: str | None = None) -> str:
    name = f"{stem.rsplit('/', 1)[-1].split('.')[0]}_output.csv" if stem else "output.csv"
    return f"{folder.rstrip('/')}/{name}"


def write_result(df: DataFrame, folder: str, stem: str | None = None, mode: str = "errorifexists",
                 single: bool = False) -> str:
    """Write a result as ``<input stem>_output.csv`` (``output.csv`` without a stem), in parallel parts unless ``single``."""
    path = result_path(folder, stem)
    write_csv(df, path, single=single, mode=mode)
    return path


def index_rows(df: DataFrame, id_col: str, text_col: str, vector_col: str, meta_cols: Sequence[str],
               features: Sequence[str] = (), metric: str = "cosine") -> DataFrame:
    """The index layout: id, text, vector, and metadata and features as text.

    The metric is kept with the vector column, in the schema that the files carry.
    """
    return df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("row_as_text"),
        F.col(vector_col).cast("array<float>").alias("embedding", metadata={"metric": metric}),
        metadata_map(meta_cols).alias("metadata"),
        metadata_map(features).alias("fields"),
    )


def append_index(df: DataFrame, path: str, id_col: str = "id", text_col: str = "row_as_text",
                 vector_col: str = "embedding", meta_cols: Sequence[str] = (), features: Sequence[str] = (),
                 metric: str = "cosine", load: str | None = None) -> None:
    """Append entries to a Parquet index; ``features`` are the columns that flows give back.

    With a name, a load is a partition of its own (column ``load``) and replaces what an earlier run of the same load left, so it can be
    repeated; loads of one index are named all or none.
    """
    rows = index_rows(df, id_col, text_col, vector_col, meta_cols, features, metric)
    if load is None:
        rows.write.mode("append").parquet(path)
    else:
        (rows.withColumn("load", F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("load").parquet(path))


def append_log(df: DataFrame, path: str) -> None:
    """Append interaction records ``(ts, question, answer, steps)`` as JSON, one folder per day."""
    (df.select("ts", "question", "answer", "steps")
       .withColumn("day", F.to_date("ts"))
       .write.mode("append").partitionBy("day").json(path))
