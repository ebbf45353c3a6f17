"""Ranked lexical search over an inverted index in blocks of documents, by a hybrid of term-at-a-time and document-at-a-time.

1. ``build``: a task cuts its rows into blocks of about ``block_bytes`` of text and writes, for each block, one row with the ids and
   lengths of its documents and one row for each term with the documents that hold it. Nothing is shuffled and the index serves any queries.
2. ``search`` sums the statistics of the terms asked for (one aggregate over the index), brings each block's postings of these terms to one
   task, and walks the block once for each item: lists of at most ``short`` of the block are summed term by term into accumulators, whose sums
   are lower bounds of scores already; the accumulators then are one more bounded iterator beside the long lists, in a walk over documents in
   ascending order that skips every window whose bounds don't reach the item's floor, and within a window looks into lists only for
   documents that can still reach it. The floor is the item's worst kept score and goes on from block to block of a task.
3. A task emits the best ``top`` of each item; a top-k over the tasks' rows ends the search.

Items are taken in sets of at most ``pairs`` (item, term) pairs, which bounds what is broadcast; one pass over the index serves a set.

Defined cases: a null or empty text has no terms, is not counted as a document and is never found; rows that share a doc_id are separate
documents; a document without doc_id is found, after others of equal score; rows of one item_id (or without) are one item, which has the terms
of all of them; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kith.llm.words import raw, words
from kith.operators.topk import top_per_group
from kith.sources.workspace import materialize

INDEX = "block long, term string, df int, docs array<int>, tfs array<int>, ids array<long>"


@dataclass(frozen=True)
class SearchOptions:
    top: int = 10                 # documents kept for each item
    block_bytes: int = 16 << 20   # text of one block of the index
    window: int = 256             # documents of one window of the walk
    short: float = 1 / 32         # a list of at most this share of a block's documents is summed term by term
    pairs: int = 200_000          # (item, term) pairs searched in one pass
    b: int = 75                   # weight of a document's length, in hundredths


def _lists(values: np.ndarray, edges: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


class Block:
    """The documents of one block while they are read."""

    def __init__(self):
        self.ids, self.codes, self.vocabulary, self.bytes = [], [], {}, 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found, seen = words(text), self.vocabulary
        for w in found:
            if w not in seen:
                seen[w] = len(seen)
        self.ids.append(doc_id)
        self.codes.append(np.fromiter(map(seen.__getitem__, found), np.int64, len(found)))
        self.bytes += len(text or b"")

    def rows(self, number: int, step: int = 20_000):
        """The index rows; documents are numbered in the order of their ids, those without last."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sizes = np.array([len(c) for c in self.codes], np.int64)
        names = ["block", "term", "df", "docs", "tfs", "ids"]
        ids = pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))
        head = [pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.int32()),
                pa.array([sizes[order].tolist()], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())), ids]
        yield pa.RecordBatch.from_arrays(head, names)
        if not self.vocabulary:
            return
        key = np.concatenate(self.codes) * n + np.repeat(place, sizes)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key)))
        term, doc = np.divmod(key[first], n)
        edges = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        terms = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())
        for a in range(0, len(terms), step):
            cut = edges[a:min(len(terms), a + step) + 1]
            inside = slice(cut[0], cut[-1])
            size = len(cut) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, number), pa.int64()), terms.slice(a, size), pa.array(np.diff(cut), pa.int32()),
                 _lists(doc[inside], cut - cut[0], pa.int32()), _lists(tf[inside], cut - cut[0], pa.int32()),
                 pa.nulls(size, pa.list_(pa.int64()))], names)


def build(df: DataFrame, opts: SearchOptions = SearchOptions(), name: str = "lexical") -> DataFrame:
    """The stored index of ``df (doc_id, text)``."""

    def run(batches):
        block, number = Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                block.add(doc_id, text)
                if block.bytes >= opts.block_bytes:
                    yield from block.rows(number)
                    block, number = Block(), number + 1
        if block.ids:
            yield from block.rows(number)

    return materialize(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), name)


def statistics(index: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""
    sizes = index.filter("term is null").select(F.explode("docs").alias("n"))
    row = sizes.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum(F.col("n").cast("long"))).first()
    return row[0] or 0, row[1] or 0


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, times)`` of ``items (item_id, text)``."""

    def run(batches):
        for batch in batches:
            ids, terms = [], []
            for item, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                found = words(text)
                ids += [item] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string())], ["item_id", "term"])

    split = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term string")
    return split.groupBy("item_id", "term").agg(F.count("*").alias("times"))


class Postings:
    """The long or short list of one term in one block: documents, what each earns, and the most in each window."""

    def __init__(self, docs: np.ndarray, gain: np.ndarray, window: int, windows: int):
        self.docs, self.gain = docs, gain
        self.cuts = np.searchsorted(docs, np.arange(windows + 1) * window)
        self.most = np.zeros(windows, np.int64)
        np.maximum.at(self.most, docs // window, gain)


class Kept:
    """The best documents of one item so far: by score, then by id."""

    def __init__(self, top: int):
        self.top, self.score, self.id, self.none = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def offer(self, score, ids, none) -> None:
        score, ids, none = (np.concatenate(c) for c in ((self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score))[:self.top]
        self.score, self.id, self.none = score[order], ids[order], none[order]


def _summed(lists: list[tuple[Postings, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators of short lists: documents in ascending order and their sums."""
    docs = np.concatenate([p.docs for p, _ in lists])
    order = np.argsort(docs, kind="stable")
    docs, gain = docs[order], np.concatenate([p.gain * times for p, times in lists])[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[first], np.add.reduceat(gain, first)


def walk(lists: list[tuple[Postings, int]], ids: np.ndarray, none: np.ndarray, kept: Kept, opts: SearchOptions) -> None:
    """Offer ``kept`` every document of a block that can be among the item's best."""
    short = [x for x in lists if len(x[0].docs) <= opts.short * len(ids)]
    through = [x for x in lists if len(x[0].docs) > opts.short * len(ids)]
    floor, windows = kept.floor(), len(lists[0][0].most)
    if short:
        docs, sums = _summed(short)
        if len(sums) >= opts.top:  # a sum is a lower bound of its document's score
            floor = max(floor, int(np.partition(sums, len(sums) - opts.top)[len(sums) - opts.top]))
        through.append((Postings(docs, sums, opts.window, windows), 1))
    bounds = np.stack([p.most * times for p, times in through])
    total, at = bounds.sum(axis=0), 0
    while len(ahead := np.flatnonzero(total[at:] >= floor)):
        at += int(ahead[0])
        start = at * opts.window
        order = np.argsort(-bounds[:, at], kind="stable").tolist()
        rest, score, candidates = int(total[at]), np.zeros(opts.window, np.int64), None
        for j in order:
            (p, times), bound = through[j], int(bounds[j, at])
            if not bound:
                break
            a, b = p.cuts[at], p.cuts[at + 1]
            if candidates is None and rest >= floor:  # a document met first in this list can still reach the floor
                score[p.docs[a:b] - start] += p.gain[a:b] * times
            else:
                if candidates is None:
                    candidates = np.flatnonzero(score)
                candidates = candidates[score[candidates] + rest >= floor]
                if not len(candidates):
                    break
                spots = a + np.searchsorted(p.docs[a:b], candidates + start)
                hit = (spots < b) & (p.docs[np.minimum(spots, len(p.docs) - 1)] == candidates + start)
                score[candidates[hit]] += p.gain[spots[hit]] * times
            rest -= bound
        final = np.flatnonzero(score) if candidates is None else candidates
        final = final[score[final] >= floor]
        if len(final):
            kept.offer(score[final], ids[final + start], none[final + start])
            floor = max(floor, kept.floor())
        at += 1


def _search_set(index: DataFrame, pairs: DataFrame, n: int, length: int, opts: SearchOptions) -> DataFrame:
    spark = index.sparkSession
    terms = pairs.select("term").distinct()
    df = index.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = df.select("term", weight.alias("w")).toArrow()
    numbers = {t: i for i, t in enumerate(weights.column("term").to_pylist())}
    w = weights.column("w").to_numpy()
    asked: dict = {}
    for item, term, times in zip(*(c.to_pylist() for c in pairs.toArrow().columns)):
        if term in numbers and w[numbers[term]] > 0:
            asked.setdefault(item, []).append((numbers[term], times))
    given = spark.sparkContext.broadcast((w, asked))
    numbered = spark.createDataFrame(pa.table({"term": pa.array(list(numbers), pa.string()), "t": pa.array(range(len(numbers)), pa.int32())}))
    chosen = index.join(F.broadcast(numbered), "term").select("block", "t", "docs", "tfs", "ids")
    heads = index.filter("term is null").select("block", F.lit(-1).alias("t"), "docs", "tfs", "ids")

    def run(batches):
        w, asked = given.value
        best = {item: Kept(opts.top) for item in asked}
        state = {}

        def finish():
            lists, ids, none = state.pop("lists"), state["ids"], state["none"]
            for item, wanted in asked.items():
                here = [(lists[t], times) for t, times in wanted if t in lists]
                if here:
                    walk(here, ids, none, best[item], opts)

        for batch in batches:
            blocks, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            docs, tfs = batch.column(2), batch.column(3)
            for row, (block, t) in enumerate(zip(blocks, numbers)):
                if t < 0:
                    if "lists" in state:
                        finish()
                    ids = batch.column(4)[row].values
                    state = {"ids": ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), "none": ids.is_null().to_numpy(zero_copy_only=False), "lists": {}}
                    size = docs[row].values.to_numpy().astype(np.int64)
                    state["norm"] = 8 * (100 - opts.b + opts.b * size * n // length)
                    state["windows"] = -(-len(size) // opts.window)
                else:
                    doc, tf = docs[row].values.to_numpy(), tfs[row].values.to_numpy().astype(np.int64)
                    gain = w[t] * (1_000_000_000 * tf // (1000 * tf + state["norm"][doc]))
                    state["lists"][t] = Postings(doc, gain, opts.window, state["windows"])
        if "lists" in state:
            finish()
        rows = [(item, k.score, k.id, k.none) for item, k in best.items() if len(k.score)]
        if rows:
            counts = [len(r[1]) for r in rows]
            ids, none = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r, c in zip(rows, counts) for _ in range(c)], pa.int64()), pa.array(ids, pa.int64(), mask=none),
                 pa.array(np.concatenate([r[1] for r in rows]))], ["item_id", "doc_id", "score"])

    spread = heads.unionByName(chosen).repartition("block").sortWithinPartitions("block", "t")
    return spread.mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, opts: SearchOptions = SearchOptions()) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best documents of every item of ``items (item_id, text)``."""
    pairs = materialize(item_terms(items), "item-terms")
    n, length = statistics(index)
    count = pairs.count()
    sets = -(-count // opts.pairs)
    found = index.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for s in range(sets if length else 0):
        part = pairs if sets == 1 else pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == s)
        found = found.unionByName(_search_set(index, part, n, length, opts))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return top_per_group(found, ["item_id"], order, opts.top).select("item_id", "rank", "doc_id", "score")
