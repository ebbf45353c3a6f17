"""Scoring of one seed block against a stream of corpus rows, inside a task.

A kernel turns Arrow columns into arrays and gives a seeds x rows score matrix (higher is
closer). ``Best`` keeps the k best corpus rows of every seed of the block, so what a task holds is
bounded by seeds x k plus one tile, however many corpus rows stream past.

Vectors are compared in single precision first: a product of a tile says, with an error bound, which pairs
may be among the best, and only these are scored in double precision. A tile of which many pairs pass is scored whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 9            # scores are rounded before ranking, so equal pairs tie on every machine
TILE_CELLS = 4_000_000
SHARED_CELLS = 1_000_000  # of a tile of token overlap, which needs several arrays of its size
ROUGH_SEEDS, ROUGH_ROWS = 512, 2048  # one tile of the comparison in single precision
DENSE = 0.05          # share of a tile's pairs from which on the whole tile is scored
SEEDS_AT_ONCE = 8192  # seeds of a broadcast that share one running best


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as an n x d float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different length in one column")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, int(sizes[0]))


def usable(batch, metric: str, at: int = 1):
    """A batch without the rows whose vector is null or has a null, NaN or infinite element (or, for cosine, is zero: it has no direction)."""
    column = batch.column(at)
    if column.null_count:
        batch = batch.filter(pc.is_valid(column))
        column = batch.column(at)
    if metric != "overlap" and batch.num_rows:
        m = matrix(column)
        some = np.isfinite(m).all(axis=1)
        if metric == "cosine":
            some &= np.any(m != 0, axis=1)
        if not some.all():
            batch = batch.filter(pa.array(some))
    return batch


def id_values(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    values = np.empty(len(column), object)  # decimals, dates, doubles: ordered by value, as Spark orders them
    values[:] = column.to_pylist()
    return values


def id_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values if values.dtype.kind in "iu" else values.tolist(), type=kind)


class Cosine:
    def load(self, column):
        m = matrix(column)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    seeds = load

    def scores(self, seeds, rows, keep):
        return np.round(seeds @ rows.T, DIGITS) + 0.0

    def rough_seeds(self, seeds):
        return seeds.astype(np.float32)

    rough_rows = staticmethod(lambda seeds, rows: rows.astype(np.float32))

    def rough_error(self, seeds, rows):
        """No single-precision score of unit vectors is farther than this from the rounded one."""
        return (rows.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -DIGITS

    def rough_floor(self, seeds, floor):
        return floor

    def pair_scores(self, seeds, rows, i, j):
        return np.round(np.einsum("ij,ij->i", seeds[i], rows[j]), DIGITS) + 0.0

    def some(self, seeds, start, stop):
        return seeds[start:stop]


class SquaredL2:
    """Squared distances. The matrix product only says which rows may be among the best; these are computed from the differences."""

    def load(self, column):
        return matrix(column)

    def seeds(self, column):
        m = matrix(column)
        shift = m.mean(axis=0)  # distances do not change, cancellation shrinks
        given, m = m, m - shift
        return given, m, shift, np.einsum("ij,ij->i", m, m)

    def scores(self, seeds, rows, keep):
        given, m, shift, m2 = seeds
        r = rows - shift
        size = m2[:, None] + np.einsum("ij,ij->i", r, r)[None, :]
        d2 = size - 2.0 * (m @ r.T)
        error = size * (4e-16 * (m.shape[1] + 4)) + 10.0 ** -DIGITS
        if keep < len(rows):
            bound = np.partition(d2 + error, keep - 1, axis=1)[:, keep - 1]
            near = d2 - error <= bound[:, None]
        else:
            near = np.ones(d2.shape, bool)
        out = np.full(d2.shape, -np.inf)
        seed, row = np.nonzero(near)
        step = max(1, TILE_CELLS // max(1, m.shape[1]))
        for at in range(0, len(seed), step):
            i, j = seed[at:at + step], row[at:at + step]
            out[i, j] = self.pair_scores(seeds, rows, i, j)
        return out

    # A score is -|m - r|^2; the product of (2m, -1) and (r, |r|^2) is that score plus |m|^2, which is one number for each seed.

    def rough_seeds(self, seeds):
        with np.errstate(over="ignore"):
            return np.column_stack([2.0 * seeds[1], np.full(len(seeds[1]), -1.0)]).astype(np.float32)

    def rough_rows(self, seeds, rows):
        r = rows - seeds[2]
        with np.errstate(over="ignore"):
            return np.column_stack([r, np.einsum("ij,ij->i", r, r)]).astype(np.float32)

    def rough_error(self, seeds, rows):
        r = rows - seeds[2]
        most = np.einsum("ij,ij->i", r, r).max(initial=0.0)
        if max(most, seeds[3].max(initial=0.0)) > 1e30:
            return None  # beyond single precision
        return 2.0 * (seeds[3] + most) * ((rows.shape[1] + 8) * 2.0 ** -23) + 10.0 ** -DIGITS

    def rough_floor(self, seeds, floor):
        return floor + seeds[3]

    def pair_scores(self, seeds, rows, i, j):
        return -(np.round(((seeds[0][i] - rows[j]) ** 2).sum(axis=1), DIGITS) + 0.0)

    def some(self, seeds, start, stop):
        given, m, shift, m2 = seeds
        return given[start:stop], m[start:stop], shift, m2[start:stop]


class Overlap:
    """Shared tokens over the geometric mean of both token counts; no shared token, no score."""

    def load(self, column):
        return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())

    def seeds(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        tokens, sizes = self.load(column)
        codes, words = pd.factorize(tokens)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(words) + 1))
        return sizes, pd.Index(words), owner[order], starts

    def take(self, rows, start, stop):
        tokens, sizes = rows
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return tokens[edge[start]:edge[stop]], sizes[start:stop]

    def scores(self, seeds, rows, keep):
        seed_sizes, words, owners, starts = seeds
        tokens, sizes = rows
        n_seeds, n_rows = len(seed_sizes), len(sizes)
        code = words.get_indexer(tokens)
        row = np.repeat(np.arange(n_rows), sizes)
        row, code = row[code >= 0], code[code >= 0]
        count = starts[code + 1] - starts[code]
        shared = np.zeros((n_seeds, n_rows), dtype=np.int64)
        # Rows are taken in runs whose shared tokens fit in one tile.
        step = np.cumsum(np.bincount(row, weights=count, minlength=n_rows)) // SHARED_CELLS
        for lo, hi in zip(*_runs(step)):
            first, last = np.searchsorted(row, [lo, hi])
            times, width = count[first:last], hi - lo
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            seed = owners[np.repeat(starts[code[first:last]], times) + within]
            cell = seed * width + np.repeat(row[first:last] - lo, times)
            shared[:, lo:hi] = np.bincount(cell, minlength=n_seeds * width).reshape(n_seeds, width)
        size = np.sqrt(seed_sizes.astype(float)[:, None] * sizes.astype(float)[None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, np.round(shared / size, DIGITS), -np.inf)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    change = np.nonzero(np.diff(values))[0] + 1
    return np.concatenate([[0], change]), np.concatenate([change, [len(values)]])


KERNELS = {"cosine": Cosine, "l2": SquaredL2, "overlap": Overlap}


def points(column, metric: str) -> np.ndarray:
    """Vectors in the space where the metric is a distance (the unit sphere for cosine)."""
    return KERNELS[metric]().load(column)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs; those that are small beside the vectors, where the product cancels, come from the differences."""
    shift = b.mean(axis=0) if len(b) else 0.0
    x, y = a - shift, b - shift
    size = (x ** 2).sum(1)[:, None] + (y ** 2).sum(1)[None, :]
    d2 = size - 2.0 * x @ y.T
    i, j = np.nonzero(d2 < 1e-2 * size)
    step = max(1, TILE_CELLS // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        p, q = i[at:at + step], j[at:at + step]
        d2[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0.0))


def in_tiles(batches, metric: str, width: int, at: int = 1):
    """The usable rows of batches in slices of at most one tile of ``width`` columns."""
    step = max(1, TILE_CELLS // max(1, width))
    for batch in batches:
        batch = usable(batch, metric, at)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def bucket_keys(vectors: np.ndarray, planes: np.ndarray, tables: int) -> np.ndarray:
    """One key per row and table from its bucket numbers along the table's directions.

    Two bucket tuples that mix to one key only add candidates.
    """
    numbers = np.floor(vectors @ planes).astype(np.int64).reshape(len(vectors), tables, -1)
    mixed = np.zeros((len(vectors), tables), dtype=np.uint64)
    mixed += np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)  # far apart, so that no two tables share keys of small numbers
    for j in range(numbers.shape[2]):
        mixed = (mixed ^ numbers[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.astype(np.int64)


class Best:
    """The k best (score desc, id asc) corpus rows of each seed seen so far."""

    def __init__(self, n_seeds: int, k: int):
        self.k, self.n = k, n_seeds
        self.floor = np.full(n_seeds, -np.inf)  # score and id of each seed's k-th best
        self.full = np.zeros(n_seeds, bool)     # seeds whose floor has an id
        self.floor_id = self.last_id = None
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows, self.limit = 0, max(2 * n_seeds * k, 200_000)
        self.settled = False  # every seed has had k rows

    def offer(self, scores: np.ndarray, ids: np.ndarray, at: int = 0) -> None:
        """Take in a seeds x rows tile whose columns ascend by id; its seeds begin with number ``at``."""
        k, (m, n) = self.k, scores.shape
        floor, full = self.floor[at:at + m, None], self.full[at:at + m, None]
        mask = scores > floor
        if self.floor_id is None:
            mask |= scores == floor
        elif self.last_id is None or ids[0] < self.last_id:  # an equal score gets in by a smaller id only
            mask |= (scores == floor) & (~full | (ids[None, :] < self.floor_id[at:at + m, None]))
        if n > k and np.count_nonzero(mask) > 2 * m * k:
            kth = np.partition(scores, n - k, axis=1)[:, n - k]
            cut = np.maximum(kth, floor[:, 0])[:, None]
            above, ties = scores > cut, scores == cut
            room = k - above.sum(axis=1, keepdims=True)
            mask &= above | (ties & (np.cumsum(ties, axis=1) <= room))
        seed, row = np.nonzero(mask & (scores > -np.inf))
        self._hold(seed + at, scores[seed, row], ids[row])

    def add(self, seed: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in single pairs."""
        floor = self.floor[seed]
        keep = score > floor
        equal = np.flatnonzero((score == floor) & (score > -np.inf))
        if len(equal):
            if self.floor_id is not None:
                at = seed[equal]
                equal = equal[~self.full[at] | (ids[equal] < self.floor_id[at])]
            keep[equal] = True
        self._hold(seed[keep], score[keep], ids[keep])

    def resume(self, seed: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Begin with the k best pairs of earlier rows; they are the floors of what comes."""
        self.parts = [(seed, score, ids)]
        self.cut()

    def _hold(self, seed, score, ids) -> None:
        if len(seed):
            self.parts.append((seed, score, ids))
            self.rows += len(seed)
            if self.rows > self.limit or (not self.settled and self.rows >= self.n * self.k):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seed, score, ids = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, -score, seed))
        seed, score, ids = seed[order], score[order], ids[order]
        first = np.searchsorted(seed, np.arange(self.n))
        place = np.arange(len(seed)) - first[seed]
        keep = place < self.k
        last = place == self.k - 1
        self.settled = True
        if last.any():
            kind = ids.dtype if self.floor_id is None else np.promote_types(self.floor_id.dtype, ids.dtype)
            held = np.empty(self.n, kind)
            held[:] = ids[0] if self.floor_id is None else self.floor_id
            held[seed[last]] = ids[last]
            self.floor[seed[last]] = score[last]
            self.full[seed[last]] = True
            self.floor_id = held
            self.last_id = np.sort(held)[-1] if self.full.all() else None
        kept = (seed[keep], score[keep], ids[keep])
        self.parts, self.rows = [kept], int(keep.sum())
        return kept


def key_matrix(column: pa.Array) -> np.ndarray:
    """A column of key lists of one length as an n x tables matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Rows:
    """Corpus rows, loaded and in the order of their ids; with keys only pairs that share one of the same table count."""

    def __init__(self, metric: str, ids: pa.Array, vectors: pa.Array, keys: pa.Array | None = None):
        self.type = ids.type
        values = id_values(ids)
        order = np.argsort(values, kind="stable")
        self.ids = values[order]
        self.vectors = KERNELS[metric]().load(vectors.take(pa.array(order)))
        self.keys = None if keys is None else key_matrix(keys)[order]


class SeedBlock:
    """One block of seeds and its running best."""

    def __init__(self, metric: str, k: int, ids: pa.Array, vectors: pa.Array, exclude_self: bool, keys: pa.Array | None = None):
        self.metric, self.kernel = metric, KERNELS[metric]()
        self.keys = None if keys is None else key_matrix(keys)
        self.ids, self.id_type = id_values(ids), ids.type
        self.seeds = self.kernel.seeds(vectors) if len(self.ids) else None
        self.rough = self.kernel.rough_seeds(self.seeds) if len(self.ids) and metric != "overlap" else None
        self.best = Best(len(self.ids), k)
        self.exclude_self = exclude_self
        self.row_type = None
        if exclude_self:
            self.by_id = np.argsort(self.ids, kind="stable")
            self.sorted_ids = self.ids[self.by_id]
            self.place = np.argsort(self.by_id)

    def stream(self, ids: pa.Array, vectors: pa.Array) -> None:
        if len(ids) and len(self.ids):
            self.take(Rows(self.metric, ids, vectors))

    def take(self, rows: Rows) -> None:
        if not len(rows.ids) or not len(self.ids):
            return
        self.row_type = rows.type
        step = max(1, SHARED_CELLS // len(self.ids)) if self.rough is None else min(ROUGH_ROWS, TILE_CELLS)
        for start in range(0, len(rows.ids), step):
            stop = min(start + step, len(rows.ids))
            ids = rows.ids[start:stop]
            if self.rough is None:
                self._whole(self.kernel.take(rows.vectors, start, stop), ids, 0, len(self.ids))
            else:
                self._roughly(rows.vectors[start:stop], ids, None if rows.keys is None else rows.keys[start:stop])

    def _meet(self, seeds, keys: np.ndarray) -> np.ndarray:
        """Which of the chosen seeds share a key of one table with which rows."""
        out = np.zeros((len(self.keys[seeds]), len(keys)), bool)
        for mine, theirs in zip(self.keys[seeds].T, keys.T):
            out |= mine[:, None] == theirs[None, :]
        return out

    def _whole(self, tile, ids: np.ndarray, at: int, end: int, keys: np.ndarray | None = None) -> None:
        """Score all pairs of a tile with the seeds from ``at`` to ``end``."""
        # Rows with a seed's own id may be dropped after scoring, so as many more are kept.
        own = int(np.bincount(np.unique(ids, return_inverse=True)[1]).max()) if self.exclude_self else 0
        seeds = self.seeds if self.rough is None else self.kernel.some(self.seeds, at, end)
        scores = self.kernel.scores(seeds, tile, self.best.k + own if keys is None else len(ids))
        if keys is not None:
            scores[~self._meet(slice(at, end), keys)] = -np.inf
        if self.exclude_self:
            self._drop_self(scores, ids, at)
        self.best.offer(scores, ids, at)

    def _roughly(self, tile: np.ndarray, ids: np.ndarray, keys: np.ndarray | None = None) -> None:
        """Score those pairs of a tile that single precision can't rule out."""
        own = int(np.bincount(np.unique(ids, return_inverse=True)[1]).max()) if self.exclude_self else 0
        lo, hi = self._own(ids) if self.exclude_self else (None, None)
        keep, n = self.best.k + own, len(ids)
        error = self.kernel.rough_error(self.seeds, tile)
        rough_rows = self.kernel.rough_rows(self.seeds, tile).T
        for at in range(0, len(self.ids), ROUGH_SEEDS):
            end = min(at + ROUGH_SEEDS, len(self.ids))
            if error is None or n <= keep:
                self._whole(tile, ids, at, end, keys)
                continue
            mine = error if np.isscalar(error) else error[at:end]
            rough = self.rough[at:end] @ rough_rows
            bound = self.kernel.rough_floor(self.kernel.some(self.seeds, at, end), self.best.floor[at:end])
            open_ = np.isneginf(bound)
            if open_.any():  # seeds without a floor yet: the tile's own k-th best is one
                known = rough[open_] if keys is None else np.where(self._meet(at + np.flatnonzero(open_), keys), rough[open_], -np.inf)
                kth = np.partition(known, n - keep, axis=1)[:, n - keep]
                bound[open_] = kth - (mine if np.isscalar(mine) else mine[open_])
            # rounded down, so that the comparison in single precision is safe
            bound = np.nextafter((bound - mine).astype(np.float32), np.float32(-np.inf))
            pair = _true_places(rough >= bound[:, None])
            if len(pair) > max(DENSE * rough.size, 1.5 * open_.sum() * keep):
                self._whole(tile, ids, at, end, keys)
                continue
            seed, row = pair // n, pair % n
            seed += at
            if keys is not None:
                shared = (self.keys[seed] == keys[row]).any(axis=1)
                seed, row = seed[shared], row[shared]
            if self.exclude_self:
                place = self.place[seed]
                other = (place < lo[row]) | (place >= hi[row])
                seed, row = seed[other], row[other]
            step = max(1, TILE_CELLS // max(1, tile.shape[1]))
            for a in range(0, len(seed), step):
                i, j = seed[a:a + step], row[a:a + step]
                self.best.add(i, self.kernel.pair_scores(self.seeds, tile, i, j), ids[j])

    def _own(self, ids):
        """Where a row's id lies among the seeds in the order of their ids."""
        return np.searchsorted(self.sorted_ids, ids, "left"), np.searchsorted(self.sorted_ids, ids, "right")

    def _drop_self(self, scores, ids, at):
        lo, hi = self._own(ids)
        for j in np.nonzero(hi > lo)[0]:
            own = self.by_id[lo[j]:hi[j]] - at
            scores[own[(own >= 0) & (own < len(scores))], j] = -np.inf

    def resume(self, near: pa.Array, scores: pa.Array) -> None:
        """Take in what the seeds found before, a list of rows and of their scores for each."""
        ids = near.flatten()
        if len(ids):
            self.row_type = ids.type
            self.best.resume(np.repeat(np.arange(len(near)), np.diff(near.offsets.to_numpy())), scores.flatten().to_numpy(), id_values(ids))

    def found(self, row_type: pa.DataType) -> list[pa.Array]:
        """The k best rows so far and their scores, a list for each seed."""
        seed, score, ids = self.best.cut() if self.best.parts else (np.empty(0, int), np.empty(0), np.empty(0, object))
        edge = pa.array(np.searchsorted(seed, np.arange(len(self.ids) + 1)), pa.int32())
        return [pa.ListArray.from_arrays(edge, values) for values in (id_column(ids, row_type), pa.array(score))]

    def result(self) -> pa.RecordBatch | None:
        if not self.best.parts:
            return None
        seed, score, ids = self.best.cut()
        return pa.RecordBatch.from_arrays(
            [id_column(self.ids[seed], self.id_type), id_column(ids, self.row_type), pa.array(score)],
            names=["seed_id", "neighbor_id", "score"])


def _true_places(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero``, by words of eight cells where few are true."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    cell, byte = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[cell] * 8 + byte, whole + np.flatnonzero(flat[whole:])])


def stream_past(metric, k, seed_ids, seed_vectors, exclude_self, floors=None):
    """mapInArrow function: all corpus batches of a partition past the broadcast seeds; rows below a seed's floor are left out."""

    def run(batches):
        ids, vectors, blocks = seed_ids.value, seed_vectors.value, []
        for at in range(0, len(ids), SEEDS_AT_ONCE):
            blocks.append(SeedBlock(metric, k, ids.slice(at, SEEDS_AT_ONCE), vectors.slice(at, SEEDS_AT_ONCE), exclude_self))
            if floors is not None:
                blocks[-1].best.floor = floors.value[at:at + SEEDS_AT_ONCE].copy()
        for batch in batches:
            batch = usable(batch, metric)
            if batch.num_rows and blocks:
                rows = Rows(metric, batch.column(0), batch.column(1))
                for block in blocks:
                    block.take(rows)
        while blocks:
            if (out := blocks.pop(0).result()) is not None:
                yield out

    return run


def stream_over(metric, k, row_ids, row_vectors, exclude_self, row_keys, last, at_once):
    """mapInArrow function: batches of seeds, each ``at_once`` of them past the broadcast corpus rows. With ``row_keys`` they carry theirs as a third column.

    Seeds may bring in ``near`` and ``scores`` what they found in earlier blocks of the corpus. Unless this block is the ``last`` one,
    they go on with the k best so far in these columns.
    """
    own = 2 if row_keys is None else 3

    def run(batches):
        rows = Rows(metric, row_ids.value, row_vectors.value, row_keys and row_keys.value) if len(row_ids.value) else None
        for batch in batches:
            batch = usable(batch, metric)
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                block = SeedBlock(metric, k, part.column(0), part.column(1), exclude_self, None if row_keys is None else part.column(2))
                if part.num_columns > own:
                    block.resume(part.column(own), part.column(own + 1))
                if rows is not None:
                    block.take(rows)
                if not last:
                    yield pa.RecordBatch.from_arrays([*part.columns[:own], *block.found(row_ids.value.type)], names=[*part.schema.names[:own], "near", "scores"])
                elif (out := block.result()) is not None:
                    yield out

    return run


def stream_blocks(metric, k, exclude_self):
    """mapInArrow function over rows sorted by (block, side): seeds (0) first, then corpus (1).

    Input columns: block, side, seed_id, neighbor_id, vector.
    """

    def run(batches):
        current, waiting, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            side = batch.column(1).to_numpy()
            change = np.nonzero((np.diff(key) != 0) | (np.diff(side) != 0))[0] + 1
            for start, stop in zip([0, *change], [*change, len(key)]):
                part = batch.slice(int(start), int(stop - start))
                if key[start] != current:
                    if block is not None and (out := block.result()) is not None:
                        yield out
                    current, waiting, block = key[start], [], None
                if side[start] == 0:
                    waiting.append(part)
                    continue
                if block is None and waiting:
                    seeds = pa.Table.from_batches(waiting)
                    block = SeedBlock(metric, k, seeds.column(2).combine_chunks(),
                                      seeds.column(4).combine_chunks(), exclude_self)
                    waiting = []
                if block is not None:
                    block.stream(part.column(3), part.column(4))
        if block is not None and (out := block.result()) is not None:
            yield out

    return run
