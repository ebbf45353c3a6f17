"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

1. A text becomes its set of 64-bit shingle hashes. Equal sets form one class, named by 64 bits of their digest.
2. Two sets of at most ``m`` shingles that link differ in at most D shingles. The hash range is cut into parts, and each set sends a
   signature for its first D + 1 parts that aren't empty; at least one of them is untouched by the differences, so linked
   sets share a signature. Sizes fall into intervals that grow by half; a set takes part in its own and, near the end,
   in the next. In the small intervals each shingle is a part, which loses nothing even where hashes lie close. No link is lost and no frequent shingle by itself brings documents together, since a part must agree as a whole.
3. Classes with a common signature meet, first within a batch and then over all, as pairs of the smallest class and the others.
   Without counts, bitmaps of the sets alone then say who can't link with anyone it has met (``sift``), so few texts move.
4. The members of every shared signature are joined by signature trees: nodes hold OR-combined token bitmaps and size ranges; a dual
   traversal drops node pairs whose largest possible overlap is too small, and verifies what is left. Signatures with common members
   are joined as one family, else (more than ``family`` members) in groups of signatures with the same smallest member; memberships are
   cut into blocks and pairs of blocks.
5. Every pair of different sets counts once: a family's pair lies in one unit, and a pair of a larger family counts in its
   smallest common group. Tasks emit counts by class and as many edges as join the components, not the links themselves.

``n_links`` is the number of other rows that a row links with, rows of its own class included. With ``count=False`` it is left out
and trees skip pairs that are joined already, which gives components alone.

Defined cases: null and empty texts have no shingles and link with nothing; texts with fewer words than a shingle are one
shingle; rows without doc_id link with nothing and have no component; rows that share a doc_id share their component, and each
counts the links of its own text; other columns are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kith.llm.common import once, slices
from kith.llm.components import components
from kith.sources.workspace import materialize


@dataclass(frozen=True)
class JaccardOptions:
    words: int = 3          # words in a shingle
    percent: int = 90       # documents link when 100 * intersection >= percent * union
    flush: int = 1 << 20    # signatures gathered before they are sent
    task_bytes: int = 24 << 20  # signatures of one task
    family: int = 4_096     # classes of signatures with common members joined as one family
    block: int = 512        # classes of one tree
    count: bool = True      # verify and count every link; else only as many as join the components


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z count as a-z."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    memo = once(("words",), dict)
    if len(memo) > 1_000_000:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh3_64_intdigest(w)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = mix(h + w[j:len(w) - n + 1 + j])
    return np.unique(h)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def intervals(n: int) -> tuple[int, int]:
    """The number and the largest size of the interval that holds ``n``."""
    i, low = 0, 1
    while (up := max(low + 1, low * 3 // 2)) <= n:
        i, low = i + 1, up
    return i, up - 1


SINGLE = 32  # sets of intervals up to this size send shingles themselves


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    n, out = len(s), []
    if not n:
        return np.empty(0, np.uint64)
    i, last = intervals(n)
    mixed, largest = mix(s ^ np.uint64(0x9E3779B97F4A7C15)), 100 * n // percent
    while True:
        differ = (100 - percent) * (n + min(last, largest)) // (100 + percent)
        if differ and last <= SINGLE:
            # Of small sets the shingles are the parts: the smallest common one has at most D others before it in both sets together.
            out.append(mix(mixed[:differ + 1] + np.uint64((i + 1) * int(_M1) % (1 << 64))))
        elif differ:
            parts = max(64, -(-27 * (100 - percent) * last // (10 * (100 + percent))))
            # Sets are sorted and parts are ranges of hashes, so each part is one run.
            part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            ends = starts[:differ + 2]
            cut = ends[-1] if len(ends) == differ + 2 else n
            starts = starts[:differ + 1]
            total = np.add.reduceat(mixed[:cut], starts)
            out.append(mix(total + part[starts] * _M2 + np.uint64((i + 1) * int(_M1) % (1 << 64))))
        if (last + 1) * percent > 100 * n:
            break
        i, last = i + 1, max(last + 2, (last + 1) * 3 // 2) - 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def named(s: np.ndarray) -> int:
    """The id of a set's class."""
    return int.from_bytes(digest(s)[:8], "little", signed=True)


def describe(df: DataFrame, opts: JaccardOptions) -> DataFrame:
    """``(doc_id, n_shingles, cid)``; the class of an empty set is null."""
    k = opts.words

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([named(s) if len(s) else None for s in sets], pa.int64())],
                    ["doc_id", "n_shingles", "cid"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, cid long")


def _stars(sig: np.ndarray, ids: np.ndarray):
    """Sort by signature and id; returns what is first of each signature, and of the others their place and that of their first."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0)) if len(sig) else np.empty(0, int)
    other = np.flatnonzero(~first & (ids != ids[head])) if len(sig) else np.empty(0, int)
    return sig, ids, first, head, other


def stars(df: DataFrame, total: int, opts: JaccardOptions) -> DataFrame:
    """``(sig, pivot, member)``: each class with a signature that is not alone in it, beside the smallest class met so far."""
    k, percent, flush = opts.words, opts.percent, opts.flush
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(total * (100 - percent) * 16 * 3 // (200 * opts.task_bytes)) + 1)

    def send(sigs, owners, turn):
        sig = np.concatenate(sigs)
        ids = np.repeat(np.array([o for o, _ in owners], np.int64), [n for _, n in owners])
        sig, ids, first, head, other = _stars(sig, ids)
        rows = [(turn % tasks, 1, np.stack([sig[other].view(np.int64), ids[head[other]], ids[other]]).tobytes())] if len(other) else []
        sig, ids = sig[first], ids[first]
        where = (mix(sig) % np.uint64(tasks)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        where, sig, ids = where[order], sig[order], ids[order]
        cuts = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]])
        rows += [(int(where[a]), 0, np.stack([sig[a:b].view(np.int64), ids[a:b]]).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int8(), pa.binary()))], ["p", "kind", "data"])

    def cut(batches):
        sigs, owners, held, seen, turn = [], [], 0, set(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = shingles(text, k) if doc_id is not None else ()
                    if not len(s) or (cid := named(s)) in seen:
                        continue
                    seen.add(cid)
                    found = signatures(s, percent)
                    if len(found):
                        sigs.append(found)
                        owners.append((cid, len(found)))
                        held += len(found)
                    if held >= flush:
                        turn += 1 + cid % 7
                        yield send(sigs, owners, turn)
                        sigs, owners, held, seen = [], [], 0, set()
        if sigs:
            yield send(sigs, owners, owners[0][0] % tasks)

    def triples(sig, pivot, member):
        for a in range(0, len(sig), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a:a + 100_000], pa.int64()) for x in (sig, pivot, member)], ["sig", "pivot", "member"])

    def meet(batches):
        held = []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = np.frombuffer(data, np.int64)
                if kind:
                    yield from triples(*rows.reshape(3, -1))
                else:
                    held.append(rows.reshape(2, -1))
        if held:
            both = np.concatenate(held, axis=1)
            held.clear()
            sig, ids, _, head, other = _stars(both[0], both[1])
            yield from triples(sig[other], ids[head[other]], ids[other])

    blobs = df.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "p int, kind byte, data binary")
    return blobs.repartition(tasks, "p").mapInArrow(meet, "sig long, pivot long, member long")


MARKS = 24  # bits of the place that an id marks in a bitmap of bounded size


def flagged(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``df`` with a flag ``marked`` on the rows whose ``column`` is among ``ids``, and few others; which they are is not told apart by a shuffle of ``df``.

    The ids mark a bitmap of 2^24 bits, 262,144 words at most, which is broadcast.
    """
    place = F.pmod(F.xxhash64(column), F.lit(1 << MARKS))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({column}), {1 << MARKS}) & 63 AS INT))")
    words = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    near = df.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words), "word", "left")
    return near.select(*df.columns, F.coalesce(bit.bitwiseAND(F.col("bits")) != 0, F.lit(False)).alias("marked"))


def marked(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose doc_id is among ``ids (doc_id)``, and few others."""
    return flagged(df, ids).filter("marked").select(df.columns)


def without(df: DataFrame, lost: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``lost``; only the rows that it marks are shuffled."""
    both = flagged(df, lost, column)
    near = both.filter("marked").select(df.columns).join(lost.select(column), column, "left_anti").select(df.columns)
    return both.filter("not marked").select(df.columns).unionByName(near)


def class_texts(wanted: DataFrame, df: DataFrame, opts: JaccardOptions) -> DataFrame:
    """``(cid, text)``: one text of each class of ``wanted (cid, rep)``. Only texts of marked ids are shuffled, once, by their class."""
    k = opts.words

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t, k) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([named(s) if len(s) else None for s in sets], pa.int64()), batch.column(0)], ["cid", "text"])

    near = marked(df.select(F.col("doc_id").cast("long"), "text"), wanted.select(F.col("rep").alias("doc_id")))
    found = near.select("text").mapInArrow(run, "cid long, text string").groupBy("cid").agg(F.min("text").alias("text"))
    return found.join(wanted.select("cid"), "cid", "left_semi")


def width(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` shingles."""
    bits = 64
    while bits < 4 * n and bits < 1 << 16:
        bits *= 2
    return bits


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out, bit = np.zeros(bits // 64, np.uint64), s % np.uint64(bits)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(int), np.uint64(1) << (bit & np.uint64(63)))
    return out


class Tree:
    """A signature tree over sets sorted by size: leaves hold one set, nodes the OR of their bitmaps and the range of their sizes.

    ``sizes`` and ``maps`` may stand for the sets where pairs are only sought, not verified.
    """

    FAN = 8

    def __init__(self, sets: list[np.ndarray] | None, labels: list[int], bits: int, sizes=None, maps=None):
        self.sets, self.labels = sets, labels
        sizes = np.array([len(s) for s in sets] if sizes is None else sizes)
        self.order = np.argsort(sizes, kind="stable")
        maps = np.stack([bitmap(s, bits) for s in sets] if maps is None else maps)[self.order]
        size = sizes[self.order]
        label = np.array([labels[at] for at in self.order])
        level = (maps, size, size, size - np.bitwise_count(maps).sum(axis=1).astype(int), label, label)
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), self.FAN)
            level = (np.bitwise_or.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts),
                     np.maximum.reduceat(level[3], cuts), np.minimum.reduceat(level[4], cuts), np.maximum.reduceat(level[5], cuts))
            self.levels.append(level)


def candidates(a: Tree, b: Tree, percent: int, every: bool):
    """Pairs of places that may link, in a dual traversal that goes down both trees at once; ``every``: those of one label too."""
    top = max(len(a.levels), len(b.levels)) - 1
    pairs = np.array([[0, 0]])
    for depth in range(top, -1, -1):
        x, y = a.levels[min(depth, len(a.levels) - 1)], b.levels[min(depth, len(b.levels) - 1)]
        i, j = pairs[:, 0], pairs[:, 1]
        keep = (100 * x[2][i] >= percent * y[1][j]) & (100 * y[2][j] >= percent * x[1][i])
        if not every:
            keep &= ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
        if a is b:
            keep &= i <= j if depth else i < j
        i, j = i[keep], j[keep]
        overlap = np.concatenate([np.bitwise_count(x[0][i[s:s + 4096]] & y[0][j[s:s + 4096]]).sum(axis=1) for s in range(0, len(i), 4096)] or [[]])
        keep = (overlap + np.minimum(x[3][i], y[3][j])) * (100 + percent) >= percent * (x[1][i] + y[1][j])
        i, j = i[keep], j[keep]
        if depth == 0:
            break
        below = [len(t.levels[depth - 1][0]) if depth - 1 < len(t.levels) else 1 for t in (a, b)]
        fan = [Tree.FAN if depth < len(t.levels) else 1 for t in (a, b)]
        grid = np.stack(np.meshgrid(np.arange(fan[0]), np.arange(fan[1]), indexing="ij"), -1).reshape(-1, 2)
        pairs = (np.stack([i * fan[0], j * fan[1]], 1)[:, None, :] + grid[None]).reshape(-1, 2)
        pairs = pairs[(pairs[:, 0] < below[0]) & (pairs[:, 1] < below[1])]
    return a.order[i], b.order[j]


def traverse(a: Tree, b: Tree, percent: int):
    """Links between two trees as (place, place).

    Labels that links have joined count as one from then on, so as many links are found as are needed to join them, not all pairs.
    """
    top: dict = {}

    def find(v):
        while (up := top.get(v, v)) != v:
            top[v] = v = top.get(up, up)
        return v

    i, j = candidates(a, b, percent, False)
    for p, q in zip(i.tolist(), j.tolist()):
        u, v = find(a.labels[p]), find(b.labels[q])
        if u != v and links(a.sets[p], b.sets[q], percent):
            top[max(u, v)] = min(u, v)
            yield p, q


def overlaps(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements the sets ``a[i]`` and ``b[j]`` of each pair have in common."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    values, codes = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    codes = np.split(codes.astype(np.int32), np.cumsum([len(s) for s in [*a, *b]])[:-1])
    mark, step = np.zeros(len(values), bool), max(1, 1_000_000 // max(1, max(map(len, b))))
    order = np.argsort(i, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(i[order])) + 1, [len(i)]])
    for start, end in zip(cuts[:-1], cuts[1:]):
        here = codes[i[order[start]]]
        mark[here] = True
        for s in range(start, end, step):
            at = order[s:min(end, s + step)]
            held = [codes[len(a) + q] for q in j[at].tolist()]
            upto = np.concatenate([[0], np.cumsum(mark[np.concatenate(held)])])
            ends = np.cumsum([len(h) for h in held])
            out[at] = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
        mark[here] = False
    return out


def all_links(a: Tree, b: Tree, percent: int):
    """Every link between two trees as (places, places); of one tree with itself each pair once."""
    i, j = candidates(a, b, percent, True)
    common = overlaps(a.sets, b.sets, i, j)
    n, m = (np.array([len(s) for s in t.sets]) for t in (a, b))
    keep = 100 * common >= percent * (n[i] + m[j] - common)
    return i[keep], j[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is joined with."""
    top = np.arange(n)
    while True:
        low, before = np.minimum(top[i], top[j]), top.copy()
        np.minimum.at(top, i, low)
        np.minimum.at(top, j, low)
        top = top[top]
        if (top == before).all():
            return top


def in_units(members: DataFrame) -> DataFrame:
    """Members of groups of ``blocks`` blocks, once for each pair of blocks (``i``, ``j``) that their own block is in."""
    return (members.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "cid"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}))


def by_signature(met: DataFrame, name: str) -> DataFrame:
    """``(owner, cid)``: the classes of all signatures with the same smallest member, as one group."""
    placed = materialize(met.select("sig", F.explode(F.array("pivot", "member")).alias("cid")).distinct(), name)
    least = placed.groupBy("sig").agg(F.min("cid").alias("owner"))
    return materialize(placed.join(least, "sig").select("owner", "cid").distinct(), f"{name}-groups")


def class_maps(wanted: DataFrame, df: DataFrame, opts: JaccardOptions) -> DataFrame:
    """``(cid, n, map)``: size and bitmap of each class of ``wanted (cid, rep)``."""
    k = opts.words

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [s for t in batch.column(0).to_pylist() if len(s := shingles(t, k))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([named(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([bitmap(s, width(len(s))).tobytes() for s in sets], pa.binary())], ["cid", "n", "map"])

    near = marked(df.select(F.col("doc_id").cast("long"), "text"), wanted.select(F.col("rep").alias("doc_id")))
    found = near.select("text").mapInArrow(run, "cid long, n long, map binary").groupBy("cid").agg(F.min("n").alias("n"), F.min("map").alias("map"))
    return found.join(wanted.select("cid"), "cid", "left_semi")


def near_maps(a: list, b: list, percent: int):
    """Pairs of places in ``a`` and ``b``, lists of (size, bitmap), that may link; ``a`` is ``b``: each pair once.

    A pair is compared in the shorter of its bitmaps, to which the longer one folds.
    """
    def widths(side):
        out: dict = {}
        for at, (_, m) in enumerate(side):
            out.setdefault(len(m), []).append(at)
        return out

    def tree(side, at, words):
        return Tree(None, [0] * len(at), 0, [side[x][0] for x in at], [np.bitwise_or.reduce(side[x][1].reshape(-1, words)) for x in at])

    pairs = [np.empty((0, 2), np.int64)]
    for v, x in widths(a).items():
        for w, y in widths(b).items():
            far = 100 * max(a[p][0] for p in x) < percent * min(b[q][0] for q in y) or 100 * max(b[q][0] for q in y) < percent * min(a[p][0] for p in x)
            if far or (a is b and v > w):
                continue
            left = tree(a, x, min(v, w))
            i, j = candidates(left, left if a is b and v == w else tree(b, y, min(v, w)), percent, True)
            pairs.append(np.stack([np.array(x)[i], np.array(y)[j]], 1))
    return np.concatenate(pairs).T


def sift(met: DataFrame, classes: DataFrame, df: DataFrame, opts: JaccardOptions) -> DataFrame:
    """``(sig, pivot, member)`` again, without classes whose bitmap rules out a link with all others of their signatures.

    Signatures with the same smallest member are one (``sig``); in it a class stands beside one that candidates join it with. What is
    shuffled for a class are 4 to 8 bits for each shingle, for each of its groups, so texts go only where a link is likely.
    """
    percent, block = opts.percent, opts.block
    grouped = by_signature(met, "met")
    counted = grouped.groupBy("owner").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    maps = class_maps(grouped.select("cid").distinct().join(classes.select("cid", "rep"), "cid"), df, opts)
    rows = in_units(grouped.join(counted, "owner")).join(maps, "cid").select("owner", "i", "j", "own", "cid", "n", "map") \
        .repartition("owner", "i", "j").sortWithinPartitions("owner", "i", "j")

    def unit(owner, i, j, held):
        sides = [[r for r in held if r[0] == own] for own in ((i,) if i == j else (i, j))]
        if not all(sides):
            return None
        ids = np.array([r[1] for side in sides for r in side], np.int64)
        lists = [[(r[2], np.frombuffer(r[3], np.uint64)) for r in side] for side in sides]
        p, q = near_maps(lists[0], lists[-1], percent)
        top = roots(len(ids), p, q + (0 if i == j else len(sides[0])))
        moved = np.flatnonzero(top != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (np.full(len(moved), owner), ids[top[moved]], ids[moved])], ["sig", "pivot", "member"]) if len(moved) else None

    def run(batches):
        key, held = None, []
        for batch in batches:
            for owner, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (owner, i, j) != key:
                    if held and (out := unit(*key, held)) is not None:
                        yield out
                    key, held = (owner, i, j), []
                held.append(row)
        if held and (out := unit(*key, held)) is not None:
            yield out

    return rows.mapInArrow(run, "sig long, pivot long, member long")


def tree_links(met: DataFrame, classes: DataFrame, df: DataFrame, opts: JaccardOptions) -> DataFrame:
    """``(a, b, n)``: edges that join the components of classes and, without ``b``, parts of the number of rows that class ``a`` links with."""
    k, percent, block, family, count = opts.words, opts.percent, opts.block, opts.family, opts.count
    kin = materialize(components(met.select(F.col("pivot").alias("a"), F.col("member").alias("b"))).withColumnRenamed("id", "cid"), "kin")
    sizes = materialize(kin.groupBy("component").agg(F.count("*").alias("m")), "families")
    small = kin.join(sizes.filter(F.col("m") <= family), "component").select(
        F.col("component").alias("sig"), "cid", F.lit(None).cast("long").alias("owner"), F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    # In larger families the signatures with the same smallest member, whose members are much the same, are joined as one group.
    wide = kin.join(sizes.filter(F.col("m") > family), "component").select(F.col("cid").alias("pivot"))
    grouped = by_signature(met.join(wide, "pivot", "left_semi"), "members")
    counted = grouped.groupBy("owner").agg(F.count("*").alias("n"))
    large = grouped.join(counted, "owner").select(F.col("owner").alias("sig"), "cid", "owner", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = materialize(small.unionByName(large).join(classes, "cid"), "placed")
    units = in_units(members).select("sig", "blocks", "i", "j", "own", "cid", "size", "owner")
    # The groups of a class: a pair of one large family counts in the first of those that it has in common.
    groups = grouped.groupBy("cid").agg(F.collect_list("owner").alias("groups"))
    described = class_texts(members.select("cid", "rep").distinct(), df, opts).join(groups, "cid", "left")
    rows = units.join(described, "cid").select(
        F.xxhash64("sig", "blocks", F.col("owner").isNull()).alias("unit"), "i", "j", "own", "cid", "size", "owner", "groups", "text") \
        .repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")

    def unit(held):
        """Parts of columns a, b, n."""
        bits = width(max(len(r[3]) for r in held))
        i, j, owner = held[0][4:7]
        sides = [[r for r in held if r[0] == own] for own in ((i,) if i == j else (i, j))]
        if not all(sides):
            return []
        trees = [Tree([r[3] for r in side], [r[1] for r in side], bits) for side in sides]
        ids = [np.array([r[1] for r in side], np.int64) for side in sides]
        if not count:
            found = np.array(list(traverse(trees[0], trees[-1], percent)), np.int64).reshape(-1, 2)
            return [(ids[0][found[:, 0]], ids[-1][found[:, 1]], np.zeros(len(found), np.int64))]
        p, q = all_links(trees[0], trees[-1], percent)
        shift = 0 if i == j else len(sides[0])
        both = ids[0] if i == j else np.concatenate(ids)
        top = roots(len(both), p, q + shift)
        moved = np.flatnonzero(top != np.arange(len(both)))
        if owner is not None:
            # A pair with a smaller common group counts there.
            less = [[np.array([g for g in r[7] if g < owner], np.int64) for r in side] for side in sides]
            once_ = overlaps(less[0], less[-1], p, q) == 0
            p, q = p[once_], q[once_]
        rows_of = np.array([r[2] for side in sides for r in side], np.int64)
        n = np.zeros(len(both), np.int64)
        np.add.at(n, p, rows_of[q + shift])
        np.add.at(n, q + shift, rows_of[p])
        some = np.flatnonzero(n)
        return [(both[moved], both[top[moved]], np.zeros(len(moved), np.int64)), (both[some], None, n[some])]

    def run(batches):
        key, held = None, []

        def batches_of(parts):
            for a, b, n in parts:
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for batch in batches:
            for at, i, j, own, cid, size, owner, groups, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (at, i, j) != key:
                    if held:
                        yield from batches_of(unit(held))
                    key, held = (at, i, j), []
                held.append((own, cid, size, shingles(text, k), i, j, owner, groups))
        if held:
            yield from batches_of(unit(held))

    return rows.mapInArrow(run, "a long, b long, n long")


def join(df: DataFrame, opts: JaccardOptions = JaccardOptions()) -> DataFrame:
    """``(doc_id, n_shingles, n_links, component_id)`` of every row of ``df (doc_id, text)``."""
    rows = materialize(describe(df, opts), "shingles")
    known = rows.filter("cid is not null and doc_id is not null")
    classes = materialize(known.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    met = materialize(stars(df, total, opts), "stars")
    if not opts.count:
        met = materialize(sift(met, classes, df, opts), "sifted")
    found = materialize(tree_links(met, classes, df, opts), "tree-links")
    reps = classes.select("cid", "rep")
    edges = (found.filter("b is not null").select("a", "b").distinct()
             .join(reps.withColumnsRenamed({"cid": "a", "rep": "ra"}), "a").join(reps.withColumnsRenamed({"cid": "b", "rep": "rb"}), "b")
             .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    shared = known.groupBy("doc_id").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).filter("x <> y")
    shared = known.join(shared, "doc_id", "left_semi").join(reps, "cid").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(edges.unionByName(shared).filter("a <> b").distinct())
    counts = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    final = (classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").join(counts, "cid", "left")
             .select("cid", F.coalesce("component", "rep").alias("linked"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    mine = F.col("doc_id").isNotNull()
    out = rows.join(final, "cid", "left").select(
        "doc_id", "n_shingles", F.when(mine, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(mine, F.coalesce("linked", "doc_id")).alias("component_id"))
    return out if opts.count else out.drop("n_links")
