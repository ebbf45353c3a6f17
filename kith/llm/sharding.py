"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit.

A row's bucket is the shortest prefix of its hash for which the rows with that prefix have at most ``limit`` bytes. Bytes are
first summed over prefixes of a depth that the total implies, a few for each shard; all shorter prefixes are sums of these.
Prefixes that are still too large there are summed again, deeper, from their own rows alone. The directory stays a table: rows
find their bucket by an equality join on the prefix.

The hash covers id and text, so only rows equal in both can't be split by its bits; their bucket overflows into a
chain of shards, filled row by row.

Defined cases: null texts have 0 bytes; rows without id hash by their text alone; a row larger than the limit
stays whole, in a shard of its own prefix or chain; repeated rows are rows of their own; an empty table gives an empty result; other
columns are left out by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kith.llm.common import hash60
from kith.sources.workspace import materialize

BITS = 60


@dataclass(frozen=True)
class ShardOptions:
    limit: int = 4 << 20   # bytes of text in one shard
    step: int = 8          # bits by which the directory goes deeper where prefixes are still too large


def hashed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n_bytes`` and ``h``."""
    given = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"n_bytes": F.octet_length(given).cast("long"), "h": hash60(F.col(key), F.md5(given.cast("binary")))})


def directory(rows: DataFrame, opts: ShardOptions) -> list[tuple[int, DataFrame]]:
    """Tables ``(prefix, depth, bits, bytes)`` for prefixes of growing length; ``depth`` is null where the next table decides."""
    total, start, top, out = rows.agg(F.sum("n_bytes")).first()[0] or 0, 0, 0, []
    while total >> start > opts.limit:
        start += 1
    start = min(BITS, start + 2)
    while True:
        fine = rows.groupBy(F.shiftright("h", BITS - start).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"))
        fine = materialize(fine, "prefixes").withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(start)))) \
            .withColumn("bits", F.expr(f"shiftright(prefix, {start} - depth)"))
        sums = fine.groupBy("depth", "bits").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") <= opts.limit)
        # The shortest prefix that fits; the longest one has it where none does.
        found = fine.drop("bytes").join(sums, ["depth", "bits"], "left").groupBy("prefix").agg(
            F.min(F.when(F.col("bytes").isNotNull(), F.struct("depth", "bits", "bytes"))).alias("b"))
        if start == BITS:
            found = found.withColumn("b", F.coalesce("b", F.struct(F.lit(BITS).alias("depth"), F.col("prefix").alias("bits"), F.lit(opts.limit + 1).cast("long").alias("bytes"))))
        table = materialize(found.select("prefix", "b.depth", "b.bits", "b.bytes"), "directory")
        out.append((start, table))
        large = table.filter("depth is null").select("prefix")
        if not large.limit(1).count():
            return out
        rows = rows.withColumn("prefix", F.shiftright("h", BITS - start)).join(large, "prefix", "left_semi").drop("prefix")
        top, start = start + 1, min(BITS, start + opts.step)


def place(rows: DataFrame, tables: list[tuple[int, DataFrame]], opts: ShardOptions) -> DataFrame:
    """Add ``depth``, ``bits`` and ``chain``, which name a row's shard."""
    done, left = None, rows
    for k, (start, table) in enumerate(tables):
        met = left.withColumn("prefix", F.shiftright("h", BITS - start)).join(table, "prefix").drop("prefix")
        here = met.filter("depth is not null") if k + 1 < len(tables) else met
        done = here if done is None else done.unionByName(here)
        left = met.filter("depth is null").drop("depth", "bits", "bytes")
    fits = done.filter(F.col("bytes") <= opts.limit).withColumn("chain", F.lit(0).cast("long"))
    order = W.partitionBy("depth", "bits").orderBy("n_bytes").rowsBetween(W.unboundedPreceding, -1)
    # Rows of one hash are equal: a shard of the chain takes as many as fit, one at least.
    over = done.filter(F.col("bytes") > opts.limit).withColumn("chain", F.floor(
        F.count("*").over(order) / F.greatest(F.lit(1), F.floor(F.lit(opts.limit) / F.greatest("n_bytes", F.lit(1))))))
    return fits.unionByName(over).drop("bytes")


def assign(df: DataFrame, opts: ShardOptions = ShardOptions(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, depth, bits, chain)`` of each row."""
    rows = materialize(hashed(df.select(key, text), key, text).select(key, "n_bytes", "h"), "hashed")
    return place(rows, directory(rows, opts), opts).drop("h")


def write_shards(df: DataFrame, folder: str, opts: ShardOptions = ShardOptions(), key: str = "doc_id", text: str = "text") -> None:
    """Write all columns, each shard in a folder of its own named by depth, bits and chain."""
    light = materialize(hashed(df.select(key, text), key, text).select("n_bytes", "h"), "hashed")
    placed = place(hashed(df, key, text), directory(light, opts), opts).drop("h", "n_bytes")
    placed.repartition("depth", "bits", "chain").write.partitionBy("depth", "bits", "chain").parquet(folder)
