"""Token ids in length-delimited binary files with an offset index.

A file is a sequence of records in ascending order of doc_id (null first); files follow each other in the order of their
part numbers. A record is

    length of the payload   unsigned 64 bits, little endian
    checksum of the length  masked crc32, 32 bits
    payload                 flags (32 bits: 1 has a doc_id, 2 ids take 32 bits), doc_id (64 bits, signed), ids (16 or 32 bits each)
    checksum of the payload masked crc32, 32 bits
    end mark                one byte, 0x0A

where masked is ``rotate_right(crc, 15) + 0xa282ead8``. Spark's own writer puts the files in place, one for each task and
with its commit protocol, so lost executors and repeated tasks leave no half files. The index (Parquet: file, doc_id, offset, length, n_tokens,
before) lets records be read in any order.

Texts are cut at single spaces, line breaks and between letters and marks: byte-level pre-tokens end there, so what lies between can be
encoded once and kept in a bounded memo. Texts with two white-space characters in a row or with a special token are encoded whole.

Defined cases: null texts are empty, so their record has the end id alone; equal doc_ids are ordered by their text's hash;
rows without doc_id come first; other columns are left out; an empty table gives no records.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kith.llm.common import Recent, once, slices
from kith.sources.workspace import new_folder

MEMO = 300_000
_MARKS = ".,!?;:#*$%&|"


@dataclass(frozen=True)
class RecordOptions:
    tokenizer: str               # a tokenizers JSON file every executor can read
    end_id: int | None = 2       # appended to each document
    file_bytes: int = 16 << 20   # bytes of text in one file, about


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class WordEncoder:
    """A byte-level tokenizer with a memo of words; ids are packed in 16 bits where they fit, else in 32."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code, self.words = "I" if self.wide else "H", Recent(memo)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(texts), 4096):  # the library's results are large
            found = self.tokenizer.encode_batch_fast(texts[start:start + 4096], add_special_tokens=False)
            out += [array(self.code, e.ids).tobytes() for e in found]
        return out

    @staticmethod
    def _cut(word: str) -> list[str]:
        """The parts of a word that pre-tokens don't cross, each with the space before it, if any; a first word is marked by a line break."""
        lead, out = " ", []
        if word[:1] == "\n":
            lead, word = "", word[1:]
        for k, line in enumerate(word.split("\n")):
            if k:
                out.append("\n")
                lead = ""
            letters = line.rstrip(_MARKS)
            if letters.isalpha():
                out.append(lead + letters)
                if len(letters) < len(line):
                    out.append(line[len(letters):])
            elif lead or line:
                out.append(lead + line)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        split, whole, wanted = {}, [], set()
        for k, text in enumerate(texts):
            if not text:
                out[k] = b""
            elif re.search(r"\s\s", text) or any(s in text for s in self.specials):
                whole.append(k)
            else:
                words = split[k] = text.split(" ")
                words[0] = "\n" + words[0]  # marks the one without a space before it
                wanted.update(words)
        for k, found in zip(whole, self._encode([texts[k] for k in whole])):
            out[k] = found
        # Words of letters, which follow a space, are kept under their letters, other parts under a space and their text, and
        # what is put together from parts under its own text.
        memo, cut, new = self.words.turn(), {}, set()
        for w in self.words.back(wanted.difference(memo)):
            if w.isalpha():
                new.add(w)
                continue
            letters = w.rstrip(_MARKS)
            if letters.isalpha():
                parts = (letters, " " + w[len(letters):])
            else:
                parts = [p[1:] if p[:1] == " " and p[1:].isalpha() else " " + p for p in self._cut(w)]
            cut[w] = parts
            new.update(parts)
        new = self.words.back(new.difference(memo))
        memo.update(zip(new, self._encode([" " + p if p.isalpha() else p[1:] for p in new])))
        memo.update([(w, b"".join([memo[p] for p in parts])) for w, parts in cut.items()])
        for k, words in split.items():
            out[k] = b"".join(map(memo.__getitem__, words))
        self.words.sift(new)
        self.words.sift(cut)
        return out


def encoder(path: str) -> WordEncoder:
    return once(("word encoder", path), lambda: WordEncoder(path))


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = struct.pack("<Iq", (doc_id is not None) + 2 * wide, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


def parse(content, offset: int):
    """``(doc_id, ids, length of the record)`` at an offset; raises where a checksum or the end mark is wrong."""
    head = bytes(content[offset:offset + 12])
    n, crc = struct.unpack("<QI", head)
    if crc != masked(head[:8]):
        raise ValueError(f"wrong length checksum at {offset}")
    payload = content[offset + 12:offset + 12 + n]
    tail = bytes(content[offset + 12 + n:offset + 17 + n])
    if len(tail) != 5 or struct.unpack("<I", tail[:4])[0] != masked(payload) or tail[4] != 10:
        raise ValueError(f"wrong payload checksum at {offset}")
    flags, doc_id = struct.unpack("<Iq", payload[:12])
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=12), n + 17


def write(df: DataFrame, folder: str, opts: RecordOptions) -> None:
    """Encode ``(doc_id, text)`` and write the files."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-total // opts.file_bytes))
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(int(files), F.col("doc_id").asc_nulls_first(), "h") \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    path, end = opts.tokenizer, opts.end_id

    def run(batches):
        e = encoder(path)
        last = b"" if end is None else np.array([end], e.kind).tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = e.encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([frame(d, i + last, e.wide) for d, i in zip(batch.column(0).to_pylist(), ids)], pa.binary())], ["frame"])

    # The text writer puts the bytes of a string as they are and ends each with the mark.
    frames = rows.mapInArrow(run, "frame binary").select(F.expr("cast(substr(frame, 1, length(frame) - 1) as string)").alias("value"))
    frames.write.option("lineSep", "\n").option("compression", "none").text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder) \
        .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, doc_id, offset, length, n_tokens, before, ids_crc32)`` of every record, checksums verified.

    ``before`` counts the ids in front of it in its file. A task holds the files of one partition.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, offset, before, rows = memoryview(content.as_buffer()), 0, 0, []
                while offset < len(data):
                    doc_id, ids, length = parse(data, offset)
                    rows.append((doc_id, offset, length, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    offset, before = offset + length, before + len(ids)
                    if len(rows) == 10_000 or offset >= len(data):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(rows)), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                            ["file", "doc_id", "offset", "length", "n_tokens", "before", "ids_crc32"])
                        rows = []

    return files(spark, folder).mapInArrow(
        run, "file string, doc_id long, offset long, length long, n_tokens long, before long, ids_crc32 long")


def write_index(spark: SparkSession, folder: str, index: str) -> None:
    scan(spark, folder).write.parquet(index)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index with ``start``, the ids in front of a record in all files. Only totals of files meet in one window."""
    rows = spark.read.parquet(index)
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("file", (F.sum("n").over(W.orderBy(number)) - F.col("n")).alias("base"))
    return rows.join(bases, "file").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_shuffled(spark: SparkSession, folder: str, index: str, seed: int) -> DataFrame:
    """``(doc_id, ids, place)``: records fetched by the index; sorting by ``place`` gives a shuffled order."""

    def run(batches):
        for batch in batches:
            found = [parse(memoryview(r.as_buffer()), 0) for r in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].astype("<i4") for f in found], pa.list_(pa.int32())), batch.column(1)],
                ["doc_id", "ids", "place"])

    wanted = spark.read.parquet(index).select("file", "offset", "length", F.xxhash64(F.lit(seed), "file", "offset").alias("place"))
    cut = wanted.join(files(spark, folder), "file").select(
        F.expr("substr(content, cast(offset + 1 as int), cast(length as int))").alias("record"), "place")
    return cut.mapInArrow(run, "doc_id long, ids array<int>, place long")


def store(df: DataFrame, opts: RecordOptions) -> tuple[str, str]:
    """Write files and index below the shared folder and return both paths."""
    spark = df.sparkSession
    folder, index = new_folder(spark, "records"), new_folder(spark, "records-index")
    write(df, folder, opts)
    write_index(spark, folder, index)
    return folder, index
