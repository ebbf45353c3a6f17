"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Vectors are cut into two halves, and each half is quantised by its own centroids. A cell is a pair of centroids. A query
walks the pairs in the order of their summed distance with a heap, until the cells it has met hold ``reach`` distinct vectors
or a share ``share`` of all, whichever is more; the entries of these cells are reranked by exact inner products in double precision. The share
is for data without clusters, where nothing short of it reaches a recall of 0.9; on clustered data ``share=0`` keeps the work of a query constant.

Centroids are trained on a bounded sample (``sample`` vectors of the smallest hashes); every vector is indexed. Cells with the same
first centroid are stored together in blocks of about ``block`` vectors, so a cell with a third of all rows is many blocks. Equal vectors are one entry with their k + 1 smallest ids: ties rank
by id, so no further copy can be among the nearest, and nothing is lost. Queries meet blocks in chunks; what a task holds is one block and one chunk.
The driver and each task hold the centroids and the cell counts, ``cells`` squared numbers at most.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id; vectors of another length
than the most frequent one take no part either; repeated rows of one id and vector count once; an id with several vectors is one neighbour, as near
as the nearest of them, and asks with all of them; fewer candidates than k give all; other columns are left out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kith.sources.workspace import materialize


@dataclass(frozen=True)
class MultiIndexOptions:
    k: int = 20
    cells: int = 64         # centroids of a half
    sample: int = 16_384    # vectors the centroids are trained on, at most
    rounds: int = 8         # of k-means
    reach: int = 2_048      # distinct vectors a query's cells must hold
    share: float = 0.5     # or this share of all, if that is more
    block: int = 1_024      # vectors in a stored block
    chunk: int = 512        # queries that meet a block at once


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``(v, ids)``: each distinct vector with its k + 1 smallest ids; the cut by rank works before the shuffle too."""
    key = F.xxhash64("v")
    ranked = rows.withColumn("h", key).withColumn("r", F.dense_rank().over(W.partitionBy("h", "v").orderBy("id")))
    return ranked.filter(F.col("r") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("h", "v", "ids")


def kmeans(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    cells = min(cells, len(x))
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        at = ((c ** 2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=cells)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(at, x[:, j], cells) / np.maximum(n, 1), c[:, j])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c ** 2).sum(1)[None] - 2 * x @ c.T).argmin(1)


def train(found: DataFrame, opts: MultiIndexOptions) -> list[np.ndarray]:
    rows = found.orderBy(F.xxhash64("h"), "h", "v").limit(opts.sample).select("v").collect()
    x = np.array([r[0] for r in rows], float)
    half = x.shape[1] // 2 if len(x) else 0
    return [kmeans(x[:, :half] if half else x, opts.cells, opts.rounds), kmeans(x[:, half:], opts.cells, opts.rounds)]


def assign(found: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """Add ``cell``."""
    half, width = centroids[0].shape[1], len(centroids[1])

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            second = x[:, half:] if x.shape[1] > half else x
            cell = nearest(x[:, :half], centroids[0]) * width + nearest(second, centroids[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["h", "v", "ids", "cell"])

    return found.mapInArrow(run, "h long, v array<double>, ids array<long>, cell int")


def walk(a: np.ndarray, b: np.ndarray, counts: dict, want: int) -> list[int]:
    """Cells in the order of the summed distances until they hold ``want`` entries."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, i, j = a[i].tolist(), b[j].tolist(), i.tolist(), j.tolist()
    heap, reached, out, width, row = [(a[0] + b[0], 0, 0)], 0, [], len(b), [0] * len(a)
    while heap and reached < want:
        _, p, q = heapq.heappop(heap)
        n = counts.get(i[p] * width + j[q], 0)
        if n:
            out.append(i[p] * width + j[q])
            reached += n
        if q + 1 < width:
            heapq.heappush(heap, (a[p] + b[q + 1], p, q + 1))
        if q == 0 and p + 1 < len(a):
            heapq.heappush(heap, (a[p + 1] + b[0], p + 1, 0))
    return out


def _asked(lists, cell: np.ndarray) -> np.ndarray:
    """Which query (row) visits the cell of which entry (column)."""
    names, column = np.unique(cell, return_inverse=True)
    flags = np.zeros((len(lists), len(names)), bool)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    wanted = lists.flatten().to_numpy()
    place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    hit = names[place] == wanted
    flags[row[hit], place[hit]] = True
    return flags[:, column]


def _nearest(scores: np.ndarray, ids: list[list[int]], who: int, k: int) -> list[tuple[int, float]]:
    """The k best other ids of a block with their best score; entries are taken in until they hold that many."""
    keep, n = min(k + 1, len(scores)), len(scores)
    while True:
        floor = np.partition(scores, n - keep)[n - keep]
        best: dict = {}
        for x, i in sorted((-scores[e], i) for e in np.flatnonzero((scores >= floor) & (scores > -np.inf)) for i in ids[e] if i != who):
            best.setdefault(i, -x)
        if len(best) >= k or keep == n:
            return list(best.items())[:k]
        keep = min(2 * keep, n)


def search(df: DataFrame, queries: DataFrame, id_col: str, vector: str, opts: MultiIndexOptions = MultiIndexOptions()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best of what each query of ``queries`` (rows of the same form) meets in ``df``."""
    k = opts.k
    rows = usable(df, id_col, vector)
    found = materialize(entries(rows, k), "entries")
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    if not found.limit(1).count():
        return asked.filter("false").selectExpr("query_id", "0 as rank", "query_id as vec_id", "0d as score")
    centroids = train(found, opts)
    half, width = centroids[0].shape[1], len(centroids[1])
    cells = materialize(assign(found, centroids), "cells")
    counts = {r[0]: r[1] for r in cells.groupBy("cell").count().collect()}  # at most cells ** 2 rows
    total = sum(counts.values())
    want = max(opts.reach, int(opts.share * total))
    dim = len(cells.first()["v"])
    valid = usable(queries, id_col, vector).filter(F.size("v") == dim).select(F.col("id").alias("query_id"), F.col("v").alias("q"))

    def visit(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = np.array(part.column(1).to_pylist(), float)
                first = -(x[:, :half] @ centroids[0].T)
                second = -((x[:, half:] if x.shape[1] > half else x) @ centroids[1].T)
                ids, vectors = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = []
                for who, v, a, b in zip(ids, vectors, first, second):
                    met: dict = {}
                    for cell in walk(a, b, counts, want):
                        met.setdefault(cell // width, []).append(cell)
                    rows += [(who, v, g, cells_) for g, cells_ in met.items()]
                kinds = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["query_id", "q", "part", "cells"])

    valid = valid.distinct()
    n_chunks = max(1, -(-valid.count() // opts.chunk))
    chunk = F.pmod(F.xxhash64(F.lit(5), "query_id"), F.lit(n_chunks)).cast("int")
    visits = valid.mapInArrow(visit, "query_id long, q array<double>, part int, cells array<int>")
    asked = visits.groupBy("part", chunk.alias("chunk")).agg(F.collect_list(F.struct("query_id", "q", "cells")).alias("asked"))
    placed = cells.withColumn("part", F.floor(F.col("cell") / width).cast("int"))
    blocks = F.broadcast(placed.groupBy("part").agg(F.ceil(F.count("*") / opts.block).cast("int").alias("blocks")))  # at most ``cells`` rows
    stored = (placed.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "h"), F.col("blocks")))
              .groupBy("part", "block").agg(F.collect_list(F.struct("v", "ids", "cell")).alias("held")))
    met = stored.join(asked, "part").select("held", "asked")

    def rank(batches):
        for batch in batches:
            for held, questions in zip(batch.column(0), batch.column(1)):
                flat, question = held.values, questions.values
                v = flat.field("v").flatten().to_numpy().reshape(len(flat), -1)
                ids, cell = flat.field("ids").to_pylist(), flat.field("cell").to_numpy()
                who = question.field("query_id").to_numpy()
                q = question.field("q").flatten().to_numpy().reshape(len(who), -1)
                s = np.where(_asked(question.field("cells"), cell), np.einsum("qd,vd->qv", q, v), -np.inf)
                out = [(w, i, x) for w, row in zip(who.tolist(), s) for i, x in _nearest(row, ids, w, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())],
                    ["query_id", "vec_id", "score"])

    scored = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Rows that share an id are one neighbour, as near as the nearest of them.
    scored = scored.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
