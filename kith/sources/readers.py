from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED_FORMATS = ("txt", "json", "csv")


def read_table(spark: SparkSession, path, fmt: str = "parquet", schema: T.StructType | str | None = None,
               infer: bool = False) -> DataFrame:
    """Scan a corpus table.

    CSV has a header; without ``schema`` or ``infer`` every column is a string. Inference reads
    the whole input once more, so a declared schema is the better choice at scale.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.options(header=True, inferSchema=infer and schema is None, quote='"', escape='"').csv(path)
    if fmt == "json":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported format: {fmt}")


def _extension(path: str) -> str:
    name = urlparse(path).path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_seeds(spark: SparkSession, path: str, required: Sequence[str], schema: T.StructType | str | None = None,
               fmt: str | None = None, allowed: Sequence[str] = SEED_FORMATS, infer: bool = False) -> DataFrame:
    """Read a seed file and keep its required columns.

    The format follows the extension (``txt`` and ``csv`` are CSV with a header, ``json`` is JSON
    lines); other extensions and missing columns are errors. Give the corpus ``schema`` so both
    sides carry the same types.
    """
    kind = (fmt or _extension(path)).lower()
    if kind not in allowed:
        raise ValueError(f"file format {kind!r} not supported; use one of {', '.join(allowed)}")
    df = read_table(spark, path, "json" if kind == "json" else "csv", schema, infer)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"seed file lacks columns: {', '.join(missing)}")
    return df.select(*[f"`{c}`" for c in required])


def _limit(name: str, rule) -> F.Column:
    col = F.col(f"`{name}`")
    if isinstance(rule, tuple):
        return col.between(*rule)
    return col.isin(list(rule))


def in_domain(df: DataFrame, domain: Mapping[str, tuple | Sequence]) -> DataFrame:
    """Rows inside the domain: a tuple is an inclusive range, a list the allowed values."""
    for name, rule in domain.items():
        df = df.filter(_limit(name, rule))
    return df


def seed_record(spark: SparkSession, record: Mapping[str, object], schema: T.StructType,
                domain: Mapping[str, tuple | Sequence] | None = None) -> DataFrame:
    """One seed row from a filled-in form, checked against its domain."""
    for name, rule in (domain or {}).items():
        value = record[name]
        ok = rule[0] <= value <= rule[1] if isinstance(rule, tuple) else value in rule
        if not ok:
            raise ValueError(f"{name}={value!r} is outside {rule!r}")
    return spark.createDataFrame([tuple(record[f.name] for f in schema.fields)], schema)


def read_index(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """Open a stored vector index.

    ``unique`` keeps one entry per id where a load was repeated; it shuffles the whole index, so
    a load that appends each row once (see ``kith.streaming``) is the better cure.
    """
    df = spark.read.parquet(path)
    return df.dropDuplicates(["id"]) if unique else df
