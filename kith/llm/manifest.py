"""A Merkle manifest of a dataset: every row a leaf, a tree for each ``lang``, and one over the trees' roots.

Positions come from one range partitioning by (lang, doc_id, leaf), so no language, however large, is sorted in one task. Level by level a window
over blocks of ``BLOCK`` consecutive nodes gives each node its siblings: lag and lead columns of offsets 1 to 7, masked by the node's slot in its
run of 8 and by the run's length. As blocks hold whole runs, a block needs no other one. Rows of slot 0 then hash their run to the parent. Every
level is written, an eighth of the one below. Downwards, a node's path is its siblings followed by its parent's path, so a leaf's path leads
through its subroot to the root. Texts are hashed in the scan and are never shuffled; only digests move.

Defined cases: a null in any field is ``-`` in the leaf; a null lang is a language of its own, the first; rows without doc_id come first in their
language; rows of equal doc_id are ordered by their leaf, and equal leaves are interchangeable; an empty table has no rows and no root;
a table of one row has an empty path, and its root is its leaf; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kith.operators.shape import with_row_id
from kith.sources.workspace import materialize

FAN = 8
BLOCK = FAN ** 4  # nodes of one window; a multiple of every run
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(framed, fields))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: doc_id, leaf, found (the leaf of the copy to be checked, null where it is the same row), subroot and path;
    ``levels``: the written nodes of the languages' trees from below; ``root``: None of an empty table.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    root: str | None


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes (g, n, pos, h)`` of one level, ``n`` nodes in group ``g``, beside what stands left and right in the run."""
    order = Window.partitionBy("g", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = (F.col("pos") % FAN).cast("int")
    length = F.least(F.lit(FAN).cast("long"), F.col("n") - F.col("pos") + slot)
    left = [F.when(slot >= i, F.lag("h", i).over(order)) for i in range(FAN - 1, 0, -1)]
    right = [F.when(slot + i < length, F.lead("h", i).over(order)) for i in range(1, FAN)]
    return nodes.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels with siblings; the largest group has ``most`` nodes. A group that has come to one node goes no further."""
    levels = []
    while True:
        levels.append(materialize(_with_siblings(nodes), "merkle"))
        if most <= 1:
            return levels
        most = -(-most // FAN)
        nodes = levels[-1].filter((F.col("n") > 1) & (F.col("pos") % FAN == 0)).select(
            "g", F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.floor(F.col("pos") / FAN).cast("long").alias("pos"), digest(F.col("h"), F.col("right")).alias("h"))


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with the path of each node; ``tops (g, subroot, path)`` has that of each group's last node."""
    above = None
    for i, nodes in reversed(list(enumerate(levels))):
        single = nodes.filter("n = 1").join(tops, "g")
        if above is None:
            above = single
            continue
        parents = above.select("g", F.col("pos").alias("run"), "subroot", F.col("path").alias("up"))
        lower = nodes.filter("n > 1").withColumn("run", F.floor(F.col("pos") / FAN).cast("long")).join(parents, ["g", "run"])
        path = F.concat(F.array(F.struct("left", "right")), "up")
        above = lower.withColumn("path", path).drop("run", "up").unionByName(single)
        above = materialize(above, "paths") if i else above
    return above


def manifest(df: DataFrame, copy: Column | None = None) -> Manifest:
    """The manifest of ``df (doc_id, source, lang, n_chars, text)``.

    ``copy`` is the text to be checked against it, null where a row's own text is to be checked.
    """
    spark = df.sparkSession
    found = F.lit(None).cast("string") if copy is None else F.when(copy.isNotNull(), leaf([*[F.col(c) for c in FIELDS[:-1]], copy]))
    rows = df.select("lang", "doc_id", leaf([F.col(c) for c in FIELDS]).alias("leaf"), found.alias("found"), F.monotonically_increasing_id().alias("any"))
    rows = materialize(with_row_id(rows, ["lang", "doc_id", "leaf", "any"], "at"), "leaves")
    # A group is named by the place of its first row, so groups ascend as their languages do and null needs no care.
    groups = materialize(rows.groupBy("lang").agg(F.min("at").alias("g"), F.count("*").alias("n")), "groups")
    most = groups.agg(F.max("n")).first()[0]
    if most is None:
        empty = spark.createDataFrame([], f"doc_id long, leaf string, found string, subroot string, path {PATH}")
        return Manifest(empty, [], None)
    placed = rows.join(groups.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).select(
        "g", "n", (F.col("at") - F.col("g")).alias("pos"), F.col("leaf").alias("h"), "doc_id", "found")
    levels = _climb(placed, most)
    roots = [nodes.filter("n = 1").select("g", "h") for nodes in levels]
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    count = groups.count()
    top = with_row_id(subroots.withColumnRenamed("g", "lang_g"), ["lang_g"], "pos").select(F.lit(0).alias("g"), F.lit(count).cast("long").alias("n"), "pos", "h", "lang_g")
    over = _climb(top, count)
    root = over[-1].filter("n = 1").first()["h"]
    whole = spark.range(1).select(F.lit(0).alias("g"), F.lit(root).alias("subroot"), F.array().cast(PATH).alias("path"))
    tops = materialize(_descend(over, whole).select(F.col("lang_g").alias("g"), F.col("h").alias("subroot"), "path"), "tops")
    return Manifest(_descend(levels, tops).select("doc_id", F.col("h").alias("leaf"), "found", "subroot", "path"), levels, root)


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, from below, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to beside the siblings of its path."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def verify(m: Manifest) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``: what each row's copy folds to, and whether that is the root."""
    root = F.lit(m.root).cast("string")
    folded = m.leaves.select("doc_id", "leaf", "subroot", root.alias("root"), proof(F.col("path")).alias("proof_sha256"),
                             fold(F.coalesce("found", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
