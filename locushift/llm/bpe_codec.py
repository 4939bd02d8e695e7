"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes before each run of white space picks cut points, so equal passages are cut alike
wherever they stand; a chunk is encoded and decoded once per worker while it stays in a bounded cache. A new chunk is
itself put together from pieces (white space and the word behind it) that the worker has seen, so only new words
reach the tokenizer. Joins, of pieces and of chunks, hold where the tokenizer's own split must fall: before white
space that follows another character. Each kind of such a join (the characters' classes beside it) is re-encoded
once to see that it agrees; any other join, or one of a kind that did not agree, is repaired by encoding both sides
as one, and again with the next, until a join holds. So ids are those of the whole text.

Defined results: a null text is an empty text (no ids); a text without white space is one chunk; equal rows give
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

ROLL = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def cut_points(data: bytes, every: int) -> list[int]:
    """Starts of white-space runs whose ROLL preceding bytes hash to 0 modulo ``every``."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= ROLL:
        return []
    space = (b == 32) | ((b >= 9) & (b <= 13))
    at = np.flatnonzero(space[ROLL:] & ~space[ROLL - 1 : -1]) + ROLL
    h = np.zeros(len(at), np.uint64)
    for j in range(ROLL):
        h = h * _BASE + b[at - ROLL + j]
    return at[(h >> np.uint64(40)) % np.uint64(every) == 0].tolist()


def kind(c: str) -> str:
    """A character's class, as far as a byte-level tokenizer's split tells characters apart."""
    return "s" if c.isspace() else unicodedata.category(c)[0]


class Chunk(NamedTuple):
    first: str  # classes of the first and last piece
    last: str
    decimal: str  # ids in decimal, joined by commas
    decoded: bytes


class Pieces(dict):
    """A cache of two generations: what is used moves to the young one, and the old one goes when that is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def missing(self, wanted: set) -> list:
        new = []
        for x in wanted.difference(self):
            if x in self.old:
                self[x] = self.old.pop(x)
            else:
                new.append(x)
        return new


class ChunkCodec:
    """Encodes and decodes whole texts through bounded caches of chunks and pieces."""

    def __init__(self, tokenizer, every: int = 48, most_chunks: int = 20_000, most_pieces: int = 300_000):
        self.tokenizer, self.every = tokenizer, every
        self.chunks: dict[str, Chunk] = {}
        self.pieces = Pieces(most_pieces)  # to (decimal ids, class)
        self.most_chunks = most_chunks
        self.joins: dict[tuple[str, str], bool] = {}
        self.fine: set[frozenset] = set()  # sets of classes whose pieces may follow each other in any order
        self.classes: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}  # pieces that do not decode to themselves

    def _encode(self, texts: list[str]) -> list[tuple[str, str]]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = [e.ids for e in run(texts, add_special_tokens=False)]
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        if decoded != texts:
            if len(self.odd) > 100_000:
                self.chunks.clear()
                self.pieces = Pieces(self.pieces.most)
                self.odd.clear()
            self.odd |= {t: d.encode() for t, d in zip(texts, decoded, strict=True) if t != d}
        known = self.classes
        return [(",".join(map(str, i)), known.setdefault(c := self.class_of(t), c)) for t, i in zip(texts, ids, strict=True)]

    @staticmethod
    def class_of(text: str) -> str:
        """Classes of the characters that joins look at: the last one, and white space at the front with what follows."""
        word = text.lstrip(" \t\n\r\x0b\x0c")
        space = text[: len(text) - len(word)]
        return kind(text[-1]) + (space and space[:3] + (kind(word[0]) if word else ""))

    def holds(self, a: str, a_class: str, b: str, b_class: str) -> bool:
        """Whether the ids of a text ending in piece a and of one starting with piece b may stand side by side."""
        if len(b_class) == 1 or a_class[0] == "s":
            return False
        key = a_class[0], b_class[1:]
        if key not in self.joins:
            (x, _), (y, _), (both, _) = self._encode([a, b, a + b])
            self.joins[key] = both == x + "," + y
        return self.joins[key]

    def _joined(self, own: list[str]) -> list[tuple[str, str, str]]:
        """(text, decimal, class) of pieces, those merged whose joins do not hold."""
        out = [(own[0], *self.pieces[own[0]])]
        for b in own[1:]:
            (a, _, a_class), (b_decimal, b_class) = out[-1], self.pieces[b]
            if self.holds(a, a_class, b, b_class):
                out.append((b, b_decimal, b_class))
            else:
                out[-1] = (a + b, *self._encode([a + b])[0])
        return out

    def _chunk(self, text: str, own: list[str]) -> Chunk:
        found = list(map(self.pieces.__getitem__, own))
        classes = frozenset([x[1] for x in found[1:]])
        ends = found[0][1]
        if (ends[0], classes) in self.fine and not self.odd:
            return Chunk(ends, found[-1][1], ",".join([x[0] for x in found]), text.encode())
        joined = self._joined(own)
        if len(joined) == len(own) and all(self.joins.get((a[0], b[1:])) and a[0] != "s" for a in {ends[0], *classes} for b in classes):
            self.fine.add((ends[0], classes))
        decoded = b"".join([self.odd.get(t) or t.encode() for t, _, _ in joined])
        return Chunk(joined[0][2], joined[-1][2], ",".join([d for _, d, _ in joined]), decoded)

    def _fill(self, wanted: Iterable[str]) -> None:
        new = {x: _PIECE.findall(x) for x in dict.fromkeys(wanted) if x not in self.chunks}
        unseen = self.pieces.missing(set(chain.from_iterable(new.values())))
        for s in range(0, len(unseen), 4_000):
            part = unseen[s : s + 4_000]
            self.pieces.update(zip(part, self._encode(part), strict=True))
        for x, own in new.items():
            self.chunks[x] = self._chunk(x, own)

    def split(self, data: bytes) -> list[str]:
        cuts = [0, *cut_points(data, self.every), len(data)]
        return [data[a:b].decode("utf-8", "replace") for a, b in pairwise(cuts)] if data else []

    def run(self, texts: list[bytes]) -> Iterator[list[Chunk]]:
        """Per text: its chunks, whose ids and bytes are to be joined."""
        if len(self.chunks) > self.most_chunks:
            self.chunks.clear()
        self.pieces.turn()
        cut = [self.split(x) for x in texts]
        self._fill(c for own in cut for c in own)
        for own in cut:
            joined: list[str] = []
            for c in own:
                if joined and not self._follows(joined[-1], c):
                    joined[-1] += c
                    self._fill([joined[-1]])
                else:
                    joined.append(c)
            yield [self.chunks[c] for c in joined]

    def _follows(self, left: str, right: str) -> bool:
        a, b = self.chunks[left].last, self.chunks[right].first
        if len(b) == 1 or a[0] == "s":
            return False
        found = self.joins.get((a[0], b[1:]))
        return self.holds(_PIECE.findall(left)[-1], a, _PIECE.match(right)[0], b) if found is None else found


_CODECS: dict[tuple[str, int], ChunkCodec] = {}


def codec(path: str, most_pieces: int = 300_000) -> ChunkCodec:
    """This worker's codec; its cache outlives the task."""
    import os

    if (path, most_pieces) not in _CODECS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _CODECS[path, most_pieces] = ChunkCodec(tokenizer, most_pieces=most_pieces)
    return _CODECS[path, most_pieces]


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, most_bytes: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text each, at least one row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True, most_pieces: int = 300_000) -> DataFrame:
    """doc_id, ids (if asked for), n_tokens, ids_sha256, decoded_sha256. most_pieces: bounds a worker's cache (about 400
    bytes a piece); fewer take more time, not other results."""
    fields = [pa.field("doc_id", pa.int64()), *[pa.field("ids", pa.list_(pa.int32()))] * with_ids, pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def work(batches):
        own = codec(path, most_pieces)
        for whole in batches:
            for batch in slices(whole, 2_000_000):
                out: dict[str, list] = {f.name: [] for f in fields}
                for chunks in own.run(texts_of(batch.column("text"))):
                    decimal = ",".join([c.decimal for c in chunks])
                    if with_ids:
                        out["ids"].append(list(map(int, decimal.split(","))) if decimal else [])
                    out["n_tokens"].append(decimal.count(",") + bool(decimal))
                    out["ids_sha256"].append(hashlib.sha256(decimal.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(b"".join([c.decoded for c in chunks])).hexdigest())
                out["doc_id"] = batch.column("doc_id").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in fields], schema=pa.schema(fields))

    ids = "ids array<int>, " * with_ids
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(work), f"doc_id long, {ids}n_tokens long, ids_sha256 string, decoded_sha256 string")
