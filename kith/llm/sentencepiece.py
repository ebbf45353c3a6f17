"""SentencePiece encoding and decoding by streaming Viterbi.

The pieces of a byte-pair model are chosen by merges. A prefix of a text has one encoding, and a piece may follow
another exactly if the two, joined, encode to these two again. So the best path to every place is found from the places at
most one longest piece before it: each place keeps one backpointer, and ids are committed whenever all paths alive in that window go
through one boundary. Memory is bounded by the window, however long a text without spaces is.

No piece goes on past a space mark, so all paths converge at each word; committed words are kept in a bounded memo. Runs
of space marks merge among themselves after all else and are encoded as runs.

The ids equal those of the sentencepiece library for byte-pair models with identity normalisation.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become byte pieces; any other columns are
carried along, a column with the name of a result is replaced; equal rows give equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kith.llm.common import Recent, once, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MEMO = 200_000        # words of one generation of a worker's memo


class Pieces:
    """A byte-pair vocabulary with its encoder and decoder."""

    def __init__(self, path: str, memo: int = MEMO):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or not proto.normalizer_spec.add_dummy_prefix \
                or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model with identity normalisation and a leading space mark is needed")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on past a space mark are not supported")
        self.longest = max(map(len, self.ids), default=1)
        #: Neighbours within some piece; between others all paths converge.
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Lengths of the pieces with a given end of two characters, longest first.
        self.lengths: dict = {}
        for p in self.ids:
            if len(p) > 1:
                self.lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: (*sorted(v, reverse=True), 1) for k, v in self.lengths.items()}
        self.text = [b"" if p.type == CONTROL else b" \xe2\x81\x87 " if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
                     else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.pairs: dict = {}
        self.runs: dict = {}
        self.words, self.parts = Recent(memo), Recent(memo)
        self.memo = memo

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by its merges: highest score first, then leftmost."""
        left, right, piece = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1)), list(text)
        heap = []

        def offer(i):
            if i >= 0 and (j := right[i]) < len(piece) and (s := self.score.get(piece[i] + piece[j])) is not None:
                heapq.heappush(heap, (-s, i, piece[i], piece[j], j))

        for i in range(len(piece) - 1):
            offer(i)
        while heap:
            _, i, a, b, j = heapq.heappop(heap)
            if piece[i] != a or right[i] != j or piece[j] != b or not a or not b:
                continue
            piece[i], piece[j], right[i] = a + b, "", right[j]
            if right[j] < len(piece):
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [p for p in piece if p]

    def follows(self, before: str, piece: str) -> bool:
        """Whether the two stay as they are when encoded together; ``before`` is empty at the start."""
        key = (before, piece)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 4 * self.memo:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return found

    def word(self, text: str) -> list[str]:
        """The pieces of a space mark with what follows up to the next one."""
        if text in self.ids and self.follows("", text):
            return [text]
        out: list[str] = []
        base, ends = 0, [""]  # the piece that ends at each place from the last committed boundary on
        ids, longest, lengths, pairs, single = self.ids, self.longest, self.lengths, self.pairs, (1,)
        for i in range(1, len(text) + 1):
            here = i - base
            for n in lengths.get(text[i - 2:i], single) if i > 1 else single:
                if n > here:
                    continue
                piece = text[i - n:i]
                if n == 1 or piece in ids:
                    key = (ends[here - n], piece)
                    if (ok := pairs.get(key)) is None:
                        ok = self.follows(*key)
                    if ok:
                        ends.append(piece)
                        break
            else:
                raise AssertionError(f"no piece ends at {i}")
            if len(ends) > 4 * longest:
                alive = set(range(i - longest + 1, i + 1))
                while len(alive) > 1 and (last := max(alive)) > base:
                    alive.remove(last)
                    alive.add(last - len(ends[last - base]))
                boundary = min(alive)
                if boundary > base:
                    out += self._path(ends, boundary - base)
                    ends, base = ends[boundary - base:], boundary
        return out + self._path(ends, len(text) - base)

    @staticmethod
    def _path(ends: list[str], place: int) -> list[str]:
        path = []
        while place > 0:
            path.append(ends[place])
            place -= len(ends[place])
        return path[::-1]

    def run(self, n: int) -> list[str]:
        """The pieces of ``n`` space marks. Long runs repeat a period, which is found from short ones."""
        if n > 256:
            if 0 not in self.runs:
                self.runs[0] = next((p for p in range(1, 65) if all(
                    self.run(k) == self.run(k - p)[:1] + self.run(k - p) for k in range(129, 257))), -1)
            if self.runs[0] > 0:
                times = (n - 192) // self.runs[0]
                rest = self.run(n - times * self.runs[0])
                return rest[:1] * times + rest
            return self.merge(SPACE * n)
        if n not in self.runs or n == 0:
            if n == 0:
                return []
            self.runs[n] = self.merge(SPACE * n)
        return self.runs[n]

    def short(self, text: str) -> bytes:
        """The packed ids of a word, part by part: it is cut where no piece goes on."""
        joined, memo, old, start, out = self.joined, self.parts.young, self.parts.old, 0, []
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1:i + 1] not in joined:
                part = text[start:i]
                if (packed := memo.get(part)) is None:
                    if (packed := old.get(part)) is None:
                        packed = self.packed(self.word(part))
                    memo[part] = packed
                out.append(packed)
                start = i
        return b"".join(out)

    def packed(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode()]
            else:
                ids.append(self.unknown)
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        words = text.replace(SPACE, " ").split(" ")
        memo = self.words.turn()
        self.parts.turn()
        new = [w for w in self.words.back(set(words).difference(memo)) if len(w) <= 256]
        for w in new:
            memo[w] = self.short(SPACE + w) if w else b""
        try:
            if "" not in words:
                return b"".join(map(memo.__getitem__, words))
        except KeyError:  # a word that is too long to keep
            pass
        finally:
            self.words.sift(new)
        out, marks = [], 0
        for w in words:
            marks += 1
            if w:
                pieces = self.word(SPACE + w)
                spare = pieces[0] == SPACE and marks > 1
                out.append(self.packed(self.run(marks if spare else marks - 1) + pieces[spare:]))
                marks = 0
        out.append(self.packed(self.run(marks)))
        return b"".join(out)

    def decode(self, ids) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str) -> Pieces:
    return once(("pieces", path), lambda: Pieces(path))


def id_lists(blobs: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(blobs) + 1, "<i4")
    np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", keep_text: bool = False) -> DataFrame:
    """Add ``ids``; the text goes unless ``keep_text``. ``model`` is a path every executor can read."""
    df = df.drop(ids) if ids != text else df
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        m = pieces(model)
        for whole in batches:
            for batch in slices(whole, text):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                found = id_lists([m.encode(t) if t else b"" for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), found], [*(f.name for f in kept), ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Add ``text``, what the ids stand for; null ids give an empty text."""
    df = df.drop(text) if ids != text else df
    kept = [f for f in df.schema.fields if keep_ids or f.name != ids]
    schema = T.StructType([*kept, T.StructField(text, T.StringType(), False)])

    def run(batches):
        m = pieces(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [m.decode(lists[i].values.to_numpy().tolist()) if lists[i].is_valid else "" for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), text])

    return df.mapInArrow(run, schema)
