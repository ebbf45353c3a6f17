"""An FM-index for each training shard, over words: which phrases a shard holds, and where, without its texts.

1. ``build``: a task numbers the words of its rows and cuts each document into segments of ``segment`` words that overlap by one phrase less
   a word, so that every phrase lies in one segment. Segments fill shards of at most ``SYMBOLS`` symbols; a document that doesn't fit goes on
   in the next shard. A shard's suffixes are sorted by doubling on packed integers; as a segment's end sorts by its place, comparisons
   end there and copies cost no more than other texts. Stored are the Burrows-Wheeler transform as a wavelet matrix, the suffix positions at
   every ``rate``-th place of a segment, and the words. Nothing is shuffled, and an index serves any phrases of up to ``phrase`` words.
2. ``search`` runs all phrases at once through a shard: backward search, a word a step, by ranks in the wavelet matrix; then every row of the
   ranges found steps back to a sampled position. Occurrences of a document are merged to spans of words. The parts of documents that go over
   several shards are brought together at the end.

Phrases are taken in sets of at most ``pairs`` (item, phrase) pairs, which bounds what is broadcast; one pass over the index serves a set.

Defined cases: a null or empty text has no words and no spans; an item without words has no phrase; rows of one item_id are one item; phrases
of an item without id mark words but name no item; rows that share a doc_id are separate documents; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kith.llm.words import raw, words
from kith.sources.workspace import materialize

BITS = 21                 # a suffix's key is two ranks and its place, 63 bits
SYMBOLS = 1 << BITS
SPAN = "array<struct<start:long,end:long>>"
INDEX = {"shard": "long", "doc": "array<long>", "id": "array<long>", "start": "array<long>", "n": "array<long>", "part": "array<boolean>",
         "segment_doc": "array<int>", "segment_at": "array<long>", "segment_place": "array<int>", "words": "array<string>",
         "counts": "binary", "zeros": "binary", "bits": "binary", "marks": "binary", "samples": "binary"}


def _schema(columns: dict) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


@dataclass(frozen=True)
class IndexOptions:
    phrase: int = 10          # words of a phrase; an item of fewer words is one phrase
    segment: int = 64         # words of a segment
    rate: int = 16            # a segment's places whose suffix position is kept
    symbols: int = 1 << 20    # symbols of one shard, below SYMBOLS
    pairs: int = 200_000      # (item, phrase) pairs searched in one pass
    rows: int = 1 << 20       # occurrences located at once


def suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes in order. ``text`` has 0 at the places ``ends``, where a suffix sorts by its place and comparisons end."""
    n, place = len(text), np.arange(len(text), dtype=np.uint64)
    rank = text.astype(np.uint64) + np.uint64(len(ends))
    rank[ends] = np.arange(len(ends), dtype=np.uint64)
    width, shift = 1, np.uint64(BITS)
    while True:
        after = np.zeros(n, np.uint64)
        after[:n - width] = rank[width:]
        key = (((rank << shift) | after) << shift) | place
        key.sort()
        order = (key & np.uint64(SYMBOLS - 1)).astype(np.int64)
        key >>= shift
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order] = np.cumsum(new, dtype=np.uint64) - np.uint64(1)
        if new.all():
            return order
        width *= 2


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, a row of bits, zeros of one level before ones of the next."""

    def __init__(self, n: int, zeros: np.ndarray, bits: np.ndarray):
        self.n, self.zeros, self.bits = n, zeros, bits
        counts = np.bitwise_count(bits).astype(np.int32)
        self.before = np.concatenate([np.zeros((len(zeros), 1), np.int32), np.cumsum(counts, axis=1, dtype=np.int32)], axis=1)

    @classmethod
    def of(cls, symbols: np.ndarray, levels: int) -> Wavelet:
        n, rows, zeros = len(symbols), [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            packed = np.zeros(n // 64 + 1, np.uint64)
            packed.view(np.uint8)[:(n + 7) // 8] = np.packbits(bit, bitorder="little")
            rows.append(packed)
            zeros.append(n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        return cls(n, np.array(zeros, np.int64), np.array(rows))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before the places ``at``."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level, word] + np.bitwise_count(self.bits[level, word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (symbol >> (len(self.zeros) - 1 - level)) & 1 == 1
            a, b = self._ones(level, start), self._ones(level, at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol, start, at = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at
        for level, zeros in enumerate(self.zeros):
            one = (self.bits[level, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, b = self._ones(level, start), self._ones(level, at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
            symbol = symbol * 2 + one
        return symbol, at - start


class Shard:
    """The documents of one shard while they are read. Symbol 0 ends a segment; word w has the symbol w + 1."""

    def __init__(self, opts: IndexOptions):
        self.opts, self.vocabulary, self.pieces, self.size = opts, {}, [], 0
        self.docs, self.segment_doc, self.segment_at, self.segment_place = [], [], [], []

    def room(self) -> int:
        """Words that fit, whatever their segments."""
        o = self.opts
        step = o.segment - o.phrase + 1
        return max(0, (o.symbols - self.size) // (o.segment + 1) - 1) * step

    def add(self, doc: int, doc_id, found: list[bytes], start: int, end: int, last: bool) -> None:
        """Segments that begin at the words ``start`` to ``end`` of a document; counts these words as this shard's."""
        o, seen = self.opts, self.vocabulary
        part = found[start:end + o.segment]
        for w in part:
            if w not in seen:
                seen[w] = len(seen) + 1
        codes = np.fromiter(map(seen.__getitem__, part), np.int64, len(part))
        step = o.segment - o.phrase + 1
        for at in range(start, end, step):
            piece = codes[at - start:at - start + o.segment]
            self.segment_doc.append(len(self.docs))
            self.segment_at.append(at)
            self.segment_place.append(self.size)
            self.pieces += [piece, _END]
            self.size += len(piece) + 1
        self.docs.append((doc, doc_id, start, end - start, not (start == 0 and last)))

    def row(self, number: int) -> pa.RecordBatch:
        text = np.concatenate(self.pieces) if self.pieces else np.zeros(0, np.int64)
        ends = np.flatnonzero(text == 0)
        counts = np.bincount(text, minlength=len(self.vocabulary) + 1)
        marks, samples, zeros, bits = b"", b"", b"", b""
        if len(text):
            order = suffixes(text, ends)
            wavelet = Wavelet.of(text[order - 1], max(1, len(self.vocabulary).bit_length()))
            starts = np.array(self.segment_place)
            offset = np.arange(len(text)) - np.repeat(starts, ends + 1 - starts)
            mark = (offset % self.opts.rate == 0)[order]
            packed = np.zeros(len(text) // 64 + 1, np.uint64)
            packed.view(np.uint8)[:(len(text) + 7) // 8] = np.packbits(mark, bitorder="little")
            marks, samples = packed.tobytes(), order[mark].astype(np.int32).tobytes()
            zeros, bits = wavelet.zeros.tobytes(), wavelet.bits.tobytes()
        doc, ids, start, n, part = zip(*self.docs)
        vocabulary = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())
        lists = [(doc, pa.int64()), (ids, pa.int64()), (start, pa.int64()), (n, pa.int64()), (part, pa.bool_()),
                 (self.segment_doc, pa.int32()), (self.segment_at, pa.int64()), (self.segment_place, pa.int32())]
        columns = [pa.array([number], pa.int64()), *(pa.array([list(x)], pa.list_(kind)) for x, kind in lists),
                   pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary),
                   *(pa.array([x], pa.binary()) for x in (counts.astype(np.int64).tobytes(), zeros, bits, marks, samples))]
        return pa.RecordBatch.from_arrays(columns, list(INDEX))


_END = np.zeros(1, np.int64)


def build(df: DataFrame, opts: IndexOptions = IndexOptions(), name: str = "fm-index") -> DataFrame:
    """The stored index of ``df (doc_id, text)``, a row for each shard."""
    if not opts.phrase <= opts.segment < opts.symbols < SYMBOLS - 2 * opts.segment:
        raise ValueError("a segment must hold a phrase, and a shard some segments within SYMBOLS")
    step = opts.segment - opts.phrase + 1

    def run(batches):
        shard, number, doc = Shard(opts), TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                found, at = words(text), 0
                while True:
                    if len(found) - at > shard.room() and shard.docs:
                        yield shard.row(number)
                        shard, number = Shard(opts), number + 1
                    end = min(len(found), at + max(step, shard.room()))
                    shard.add(doc, doc_id, found, at, end, end == len(found))
                    at = end
                    if at == len(found):
                        break
                doc += 1
        if shard.docs:
            yield shard.row(number)

    return materialize(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _schema(INDEX)), name)


class Stored:
    """One shard as it is searched; ``row`` has its columns as Arrow values."""

    def __init__(self, row: dict, opts: IndexOptions):
        self.opts = opts
        array = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        listed = lambda name: row[name].values.to_numpy(zero_copy_only=False)
        self.first = np.concatenate([[0], np.cumsum(array("counts", np.int64))])
        n, self.words = int(self.first[-1]), row["words"].values
        self.doc, self.id, self.start, self.n, self.part = listed("doc"), row["id"].values, listed("start"), listed("n"), listed("part")
        self.segment_doc, self.segment_at, self.segment_place = listed("segment_doc"), listed("segment_at"), listed("segment_place")
        if n:
            zeros = array("zeros", np.int64)
            self.wavelet = Wavelet(n, zeros, array("bits", np.uint64).reshape(len(zeros), -1))
            self.marks = Wavelet(n, np.zeros(1, np.int64), array("marks", np.uint64).reshape(1, -1))
            self.samples = array("samples", np.int32)

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each phrase; ``phrases`` has the symbols, right-aligned, 0 for none."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.wavelet.n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            at = np.flatnonzero((j >= phrases.shape[1] - lengths) & (low < high))
            if len(at):
                symbol = phrases[at, j]
                both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[at], high[at]]))
                low[at], high[at] = self.first[symbol] + both[:len(at)], self.first[symbol] + both[len(at):]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each suffix: steps back to the nearest sampled one, which lies in the same segment."""
        out, back, left = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            marked = (self.marks.bits[0, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[marked]] = self.samples[self.marks._ones(0, rows[marked])] + back
            rows, left, back = rows[~marked], left[~marked], back + 1
            if len(left):
                symbol, before = self.wavelet.access(rows)
                rows = self.first[symbol] + before
        return out

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, document, first word) of every occurrence, in bounded parts."""
        low, high = self.ranges(phrases, lengths)
        some = np.flatnonzero(low < high)
        ends = np.cumsum(high[some] - low[some])
        for a in range(0, int(ends[-1]) if len(ends) else 0, self.opts.rows):
            turn = np.arange(a, min(a + self.opts.rows, int(ends[-1])))
            which = np.searchsorted(ends, turn, "right")
            place = self.locate(high[some[which]] - (ends[which] - turn))
            segment = np.searchsorted(self.segment_place, place, "right") - 1
            yield some[which], self.segment_doc[segment], self.segment_at[segment] + place - self.segment_place[segment]


def phrases(items: DataFrame, opts: IndexOptions) -> DataFrame:
    """``(item_id, phrase)``: the distinct phrases of each item, words joined by spaces."""
    k = opts.phrase

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                found = words(text)
                cut = {b" ".join(found[i:i + k]) for i in range(max(1, len(found) - k + 1))} if found else ()
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.int64()), pa.array(list(cut), pa.binary()).cast(pa.string())], ["item_id", "phrase"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, phrase string").distinct()


class Asked:
    """A set of phrases: their words, and the items that have them."""

    def __init__(self, pairs: pa.Table):
        given = pairs.column("phrase").combine_chunks().dictionary_encode()
        split = pc.split_pattern(given.dictionary, " ")
        self.lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        self.words = coded.dictionary
        self.symbols = np.full((len(split), int(self.lengths.max(initial=1))), -1)
        row = np.repeat(np.arange(len(split)), self.lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.symbols[row, self.symbols.shape[1] - self.lengths[row] + place] = coded.indices.to_numpy()
        items = pairs.column("item_id").combine_chunks()
        owned = items.is_valid().to_numpy(zero_copy_only=False)
        phrase = given.indices.to_numpy()[owned]
        order = np.argsort(phrase, kind="stable")
        self.items = items.filter(pa.array(owned)).to_numpy(zero_copy_only=False)[order]
        self.edges = np.searchsorted(phrase[order], np.arange(len(split) + 1))

    def present(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The phrases that have no word beyond a shard's ``words``, and their symbols in it."""
        code = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        symbols = np.where(self.symbols >= 0, code[self.symbols], 0)
        whole = np.flatnonzero((symbols > 0).sum(axis=1) == self.lengths)
        return whole, symbols[whole]

    def items_of(self, doc: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (document, item) of (document, phrase), sorted."""
        count = self.edges[phrase + 1] - self.edges[phrase]
        at = np.repeat(self.edges[phrase], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        doc, item = np.repeat(doc, count), self.items[at]
        order = np.lexsort((item, doc))
        doc, item = doc[order], item[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else np.empty(0, bool)
        return doc[new], item[new]


FOUND = {"doc": "long", "doc_id": "long", "part": "boolean", "n_words": "long", "spans": SPAN, "items": "array<long>"}


def _hits(shard: Stored, asked: Asked, first: bool) -> pa.RecordBatch:
    """The rows of FOUND of one shard; ``first``: all its documents with their words, else only those with spans."""
    docs = len(shard.doc)
    room = shard.n + shard.opts.segment + shard.opts.phrase  # so that spans of different documents don't touch
    base = np.cumsum(room) - room
    cover, pairs = np.zeros(int(room.sum()) + 1, np.int64), [np.empty(0, np.int64)]
    if shard.first[-1] and len(asked.lengths):
        chosen, symbols = asked.present(shard.words)
        lengths = asked.lengths[chosen]
        for which, doc, at in shard.occurrences(symbols, lengths):
            start = base[doc] + at - shard.start[doc]
            cover += np.bincount(start, minlength=len(cover)) - np.bincount(start + lengths[which], minlength=len(cover))
            pairs.append(np.unique(doc * len(asked.lengths) + chosen[which]))
    inside = np.concatenate([[0], np.cumsum(cover) > 0]).astype(np.int8)
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    owner = np.searchsorted(base, start, "right") - 1
    shift = (shard.start - base)[owner]
    doc, phrase = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(asked.lengths)))
    doc, item = asked.items_of(doc, phrase)
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(docs + 1)), pa.int32()), pa.StructArray.from_arrays(
        [pa.array(start + shift, pa.int64()), pa.array(end + shift, pa.int64())], ["start", "end"]))
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()), pa.array(item, pa.int64()))
    out = pa.RecordBatch.from_arrays([pa.array(shard.doc), shard.id, pa.array(shard.part), pa.array(shard.n if first else 0 * shard.n), spans, items], list(FOUND))
    return out if first else out.filter(pc.greater(pc.list_value_length(spans), 0))


def _search_set(index: DataFrame, pairs: DataFrame, first: bool, opts: IndexOptions) -> DataFrame:
    asked = index.sparkSession.sparkContext.broadcast(Asked(pairs.toArrow()))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Stored({name: batch.column(j)[row] for j, name in enumerate(INDEX)}, opts)
                yield _hits(shard, asked.value, first)

    return index.select(*INDEX).mapInArrow(run, _schema(FOUND))


def _merged(spans):
    """Spans in order, those that touch or overlap as one."""
    done = F.array().cast(SPAN)

    def add(out, s):
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), done, add)


def search(index: DataFrame, items: DataFrame, opts: IndexOptions = IndexOptions()) -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)`` of every document: merged spans of words that phrases of ``items (item_id, text)`` cover, and the items."""
    pairs = materialize(phrases(items, opts), "phrases")
    sets = max(1, -(-pairs.count() // opts.pairs))
    found = None
    for s in range(sets):
        part = pairs if sets == 1 else pairs.filter(F.pmod(F.xxhash64("item_id", "phrase"), F.lit(sets)) == s)
        more = _search_set(index, part, s == 0, opts)
        found = more if found is None else found.unionByName(more)
    found = materialize(found, "hits")
    columns = ["doc_id", "n_words", "spans", "items"]
    scattered = F.col("part") | F.lit(sets > 1)
    joined = found.filter(scattered).groupBy("doc", "doc_id").agg(
        F.sum("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = found.filter(~scattered).select(columns).unionByName(joined.select(columns))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumn("n_hit", hit).select("doc_id", "n_words", "n_hit", "spans", "items")


def remove(df: DataFrame, items: DataFrame, opts: IndexOptions = IndexOptions(), text_col: str = "text") -> DataFrame:
    """``df`` without the passages of its texts that phrases of ``items`` cover, each from its first word to its last; all columns and rows stay."""
    key = "row"
    while key in df.columns:
        key += "_"
    rows = materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
    index = build(rows.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")), opts)
    found = search(index, items, opts).filter("n_hit > 0").select(F.col("doc_id").alias(key), F.struct("spans").alias("cut"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        word, out = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), []
        for text, spans in zip(texts, cuts):
            data, parts, at = text.encode(), [], 0
            places = [m.span() for m in word.finditer(data)]
            for s in spans:
                parts.append(data[at:places[s["start"]][0]])
                at = places[s["end"] - 1][1]
            out.append(b"".join([*parts, data[at:]]).decode())
        return pd.Series(out, index=texts.index)

    hit = rows.join(found, key).withColumn(text_col, without(F.col(text_col), F.col("cut.spans"))).select(df.columns)
    return rows.join(found, key, "left_anti").select(df.columns).unionByName(hit)
