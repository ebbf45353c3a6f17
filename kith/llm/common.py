"""What the operators of this package share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_list(text: Column) -> Column:
    """The words of a text; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it none of the columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def hash60(*parts) -> Column:
    """A hash of 60 bits that other engines can also compute: the head of an MD5."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def once(key: tuple, make):
    """``make()``, kept for the life of a worker process.

    Task functions travel by value and bring new module globals with each task, so the object hangs on the interpreter.
    """
    kept = sys.modules.setdefault("kith_worker", types.ModuleType("kith_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Recent:
    """A memo in two generations: when the young one is full it becomes the old one, and what is asked for again comes back from there.

    So a full memo loses what hasn't been asked for lately, not all it holds. ``turn`` is called between uses, so that entries stay within one.
    ``sift`` drops new entries that come for the first time: most words that are met at all are met once.
    """

    SEEN = 1 << 22

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.seen, self.marks = limit, {}, {}, bytearray(self.SEEN), 0

    def turn(self) -> dict:
        """The young generation."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        return self.young

    def back(self, keys) -> list:
        """The keys that neither generation holds; those of the old one are young again."""
        young, old, missing = self.young, self.old, []
        for k in keys:
            if (v := old.get(k)) is None:
                missing.append(k)
            else:
                young[k] = v
        return missing

    def sift(self, keys) -> None:
        """Of new entries only those stay whose key (or one of its hash) came before."""
        young, seen, mask, before = self.young, self.seen, self.SEEN - 1, len(self.young)
        for k in keys:
            h = hash(k) & mask
            if not seen[h]:
                seen[h] = 1
                del young[k]
        self.marks += before - len(young)
        if self.marks > self.SEEN // 2:
            self.seen, self.marks = bytearray(self.SEEN), 0


SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about SLICE_BYTES bytes of text, a row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
