"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none (local tests) a folder of this machine is made.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local($|\[)", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="kith-")
    return _local_root


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a DataFrame once and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
