"""A vector index stored by cell, so that a query reads only the cells it can need.

The rows lie in one folder per load and cell (the rows nearest to one pivot), beside a log. Each entry of the log is
one write that makes a load visible: the pivots it adds, the cells it retires and, per cell and distance ring, its row
count and farthest distance. From these the triangle inequality tells, before anything is read, which cells may hold one
of the k nearest rows of a seed; the scan of the others is pruned. Results are exact.

The index grows by loads. A load goes to the cells there are; a load that is repeated changes nothing, and rows of one
that broke off before its log entry are never read and are replaced when it is run again. Cells that
have grown too large are split: their rows are written to new cells and the old ones retire. Pivots keep their numbers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kith.operators import kernels
from kith.operators import knn as N
from kith.options import KnnOptions

LOG = ("load string, kind string, cell int, n long, far double, point array<double>, metric string, vector_col string, id_col string")


@dataclass(frozen=True)
class CellIndex:
    rows: DataFrame
    pivots: np.ndarray   # of all cells, also retired ones, whose rows are in no summary
    cell: np.ndarray
    count: np.ndarray
    far: np.ndarray
    metric: str
    live: np.ndarray     # numbers of the cells that take rows
    loads: frozenset = frozenset()
    vector_col: str = "embedding"
    id_col: str = "id"

    def only(self, cells: np.ndarray) -> DataFrame:
        """The rows of some cells; the scan is pruned to their folders."""
        return self.rows.filter(F.col("cell").isin([int(i) for i in cells]))

    def sizes(self) -> np.ndarray:
        """Rows of every cell."""
        return np.bincount(self.cell, weights=self.count, minlength=len(self.pivots)).astype(np.int64)


def _store(rows: DataFrame, path: str, load: str, points: np.ndarray, taking: np.ndarray, added: int, retired: np.ndarray,
           metric: str, vector_col: str, id_col: str) -> None:
    """Write rows to their nearest cell of ``taking`` and then the log entry; the last ``added`` of all ``points`` are new.

    The rows are range-partitioned by (cell, hashed id): a hot cell spreads over several tasks and
    small cells share one.
    """
    spark = rows.sparkSession
    pivots = spark.sparkContext.broadcast(points)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    at = rows.columns.index(vector_col)

    def place(batches):
        for batch in kernels.in_tiles(batches, metric, len(taking), at):
            cell = taking[kernels.distances(kernels.points(batch.column(at), metric), pivots.value[taking]).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=schema.names)

    folder = f"{path}/rows/cell_load={load}"
    (rows.mapInArrow(place, schema).repartitionByRange("cell", F.xxhash64(id_col))
         .write.mode("overwrite").partitionBy("cell").parquet(folder))
    try:
        stored = spark.read.parquet(folder).select(F.col(vector_col).alias("vec"), F.col("cell").cast("int").alias("cell"))
    except AnalysisException:  # a load without any row that can be found leaves no file
        stored = spark.createDataFrame([], "vec array<double>, cell int")
    width = N._ring_width(kernels.distances(points, points))
    about = {"metric": metric, "vector_col": vector_col, "id_col": id_col}
    entry = [{"kind": "load", **about}]
    entry += [{"kind": "rows", "cell": r["cell"], "n": r["n"], "far": r["far"]} for r in N._summary(stored, pivots, metric, width, N.RINGS)]
    entry += [{"kind": "pivot", "cell": i, "point": points[i].tolist()} for i in range(len(points) - added, len(points))]
    entry += [{"kind": "retired", "cell": int(i)} for i in retired]
    spark.createDataFrame([{"load": load, **e} for e in entry], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def write_cells(index: DataFrame, path: str, cells: int = 256, metric: str = "cosine",
                vector_col: str = "embedding", id_col: str = "id", load: str = "first") -> None:
    """Store an index by cell. Rows that cannot be found (null, or zero for cosine) are not stored."""
    narrow = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    points = N._pivots(narrow, cells, metric)
    if points is None:
        raise ValueError("no row to build cells from")
    _store(index, path, load, points, np.arange(len(points)), len(points), np.empty(0, int), metric, vector_col, id_col)


def append_cells(more: DataFrame, path: str, load: str, max_rows: int | None = None) -> bool:
    """Add the rows of a load, named by the caller, and split cells beyond ``max_rows``; False where the load is in the index already."""
    spark = more.sparkSession
    index = read_cells(spark, path)
    fresh = load not in index.loads
    if fresh:
        _store(more, path, load, index.pivots, index.live, 0, np.empty(0, int), index.metric, index.vector_col, index.id_col)
    if max_rows is not None:
        split_cells(spark, path, max_rows)
    return fresh


def split_cells(spark: SparkSession, path: str, max_rows: int) -> int:
    """Split every cell of more than ``max_rows`` rows; returns how many were split. A cell of equal vectors stays whole."""
    index = read_cells(spark, path)
    sizes = index.sizes()
    points, done = [], []
    for cell in np.flatnonzero(sizes > max_rows):
        narrow = index.only([cell]).select(F.col(index.id_col).alias("id"), F.col(index.vector_col).alias("vec"))
        new = N._pivots(narrow, int(-(-2 * sizes[cell] // max_rows)), index.metric)
        if len(new) > 1:
            points.append(new)
            done.append(cell)
    if done:
        every = np.concatenate([index.pivots, *points])
        rows = index.only(done).drop("cell_load", "cell")
        _store(rows, path, f"split-{uuid.uuid4().hex}", every, np.arange(len(index.pivots), len(every)), len(every) - len(index.pivots),
               np.array(done), index.metric, index.vector_col, index.id_col)
    return len(done)


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    """Open a stored index; only its log is read."""
    log = spark.read.schema(LOG).parquet(f"{path}/log").toArrow().to_pylist()
    of = lambda kind: [r for r in log if r["kind"] == kind]
    about, loads = of("load")[0], [r["load"] for r in of("load")]
    retired = {r["cell"] for r in of("retired")}
    rings = [r for r in of("rows") if r["cell"] not in retired]
    pivots = [p["point"] for p in sorted(of("pivot"), key=lambda p: p["cell"])]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/cell_load={x}" for x in loads if any(r["load"] == x for r in of("rows"))))
    rows = rows.withColumn("cell", F.col("cell").cast("int"))
    if retired:
        rows = rows.filter(~F.col("cell").isin(sorted(retired)))
    return CellIndex(
        rows, np.array(pivots), np.array([r["cell"] for r in rings], dtype=int), np.array([r["n"] for r in rings], dtype=np.int64),
        np.array([r["far"] for r in rings]), about["metric"], np.array([i for i in range(len(pivots)) if i not in retired]),
        frozenset(loads), about["vector_col"], about["id_col"])


def needed_cells(index: CellIndex, seeds: np.ndarray, need: int) -> np.ndarray:
    """Cells that may hold one of the ``need`` nearest rows of any of the seed points."""
    wanted = np.zeros(len(index.pivots), dtype=bool)
    scale = N._scale(index.pivots, index.far) + N._scale(seeds, np.zeros(1))
    for start in range(0, len(seeds), 256):
        for d in kernels.distances(seeds[start:start + 256], index.pivots):
            near = d[index.cell]
            bound = N._widened(N._reach(near + index.far, index.count, need), scale)
            wanted[index.cell[near - index.far <= bound]] = True
    return np.nonzero(wanted)[0]


def knn_join_cells(seeds: DataFrame, index: CellIndex, k: int, options: KnnOptions = KnnOptions(), *,
                   seed_id: str = "id", neighbor_id: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of a stored index for every seed.

    Only cells that the seeds need are read. Few seeds (checked) are broadcast to them; more take the partitioned plan with the
    stored pivots and summary.
    """
    if options.metric != index.metric:
        raise ValueError(f"the index is stored for {index.metric}")
    s, c = N._vector_sides(seeds, index.rows, seed_id, neighbor_id, vector_col)
    table = None
    if options.plan != "partitioned":
        table = N._broadcast_seeds(s, k, options.metric, options, must=options.plan == "broadcast")
    if table is None:
        def read(cells):
            return N._vector_sides(seeds, index.only(cells), seed_id, neighbor_id, vector_col)[1]

        return N._finish(N._partitioned(s, c, k, options, index, read), options.metric)
    if table.num_rows:
        cells = needed_cells(index, kernels.points(table.column("vec"), options.metric), k + int(options.exclude_self))
        c = N._vector_sides(seeds, index.only(cells), seed_id, neighbor_id, vector_col)[1]
    return N._finish(N._past_broadcast(table, s, c, k, options.metric, options), options.metric)
