"""Byte-level BPE by ranks, in two tiers.

Tier 1: a minimal perfect hash over the vocabulary (as many slots as tokens, one probe) gives the id of a pre-token that
is a token; the token in its slot is compared, so that strangers are told apart. Tier 2: any other pre-token is merged
from its bytes, kept as a linked list of ids, with a heap of the pairs that stand side by side, the smallest rank first
and the leftmost of equal ranks. Decoding joins the bytes of the ids.

Texts are cut at white space that follows another character, where a pre-token must end; each different piece of a
slice of texts is pre-tokenised once, and a bounded cache keeps short pieces between slices. Which characters are
letters, numbers and white space is read off the library itself once per worker, as its Unicode tables may be of another
version than Python's.

Defined results: a null text is an empty text (no ids); a text without white space is one piece, however long, in time
n log n; special tokens' strings are ordinary text; equal rows give equal results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .bpe_codec import Pieces, slices, texts_of
from .common import small_batches

_ODD = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Numbers 0 to n - 1 for n different keys, by hash and displace: keys meet in buckets of about three, and each bucket,
    the largest first, takes the first displacement that puts its keys into free slots; buckets of one key take what is
    left."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        h = self._hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("keys are not all different")
        self.moves = np.zeros(max(1, n // 3), np.int64)
        bucket = self._buckets(h)
        by = np.argsort(bucket, kind="stable")
        own, begin, size = np.unique(bucket[by], return_index=True, return_counts=True)
        free, slot_of = np.ones(n, bool), np.empty(n, np.int64)
        for i in np.argsort(-size, kind="stable")[: int((size > 1).sum())]:
            members = by[begin[i] : begin[i] + size[i]]
            tried, step = 0, 64
            while True:
                slots = np.sort(self._slots(h[members][:, None], np.arange(tried, tried + step)[None, :], n), 0)
                good = free[slots].all(0) & (slots[1:] != slots[:-1]).all(0)
                if good.any():
                    break
                tried, step = tried + step, min(step * 2, 1 << 14)
            move = tried + int(np.argmax(good))
            slot_of[members] = self._slots(h[members], move, n)
            free[slot_of[members]] = False
            self.moves[own[i]] = move
        single = size == 1
        slot_of[by[begin[single]]] = np.flatnonzero(free)
        self.moves[own[single]] = -1 - np.flatnonzero(free)
        self.keys: list[bytes] = [b""] * n
        self.values = np.empty(n, np.int64)
        self.values[slot_of] = np.arange(n)
        for s, i in enumerate(self.values.tolist()):
            self.keys[s] = keys[i]

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _buckets(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(len(self.moves))).astype(np.int64)

    @staticmethod
    def _slots(h: np.ndarray, move, n: int) -> np.ndarray:
        return (mix(h + np.asarray(move, np.int64).astype(np.uint64) * _ODD) % np.uint64(n)).astype(np.int64)

    def find(self, wanted: list[bytes]) -> list[int]:
        """The place of each key in the list that the hash was made of; -1 for others."""
        if not self.keys or not wanted:
            return [-1] * len(wanted)
        h = self._hashes(wanted)
        move = self.moves[self._buckets(h)]
        slot = np.where(move < 0, -1 - move, self._slots(h, np.maximum(move, 0), len(self.keys)))
        keys = self.keys
        same = np.fromiter((keys[s] == w for s, w in zip(slot.tolist(), wanted, strict=True)), bool, len(wanted))
        return np.where(same, self.values[slot], -1).tolist()


class Merges:
    """Ids of a byte string by repeated merges of the pair with the smallest rank."""

    def __init__(self, tokens: dict[bytes, int]):
        self.first = [tokens[bytes([b])] for b in range(256)]
        self.bits = max(tokens.values()).bit_length()
        self.pairs: dict[int, int] = {}  # by left id << bits | right id
        for token, rank in tokens.items():
            for i in range(1, len(token)):
                if (left := tokens.get(token[:i])) is not None and (right := tokens.get(token[i:])) is not None:
                    self.pairs[left << self.bits | right] = rank

    def ids(self, data: bytes) -> list[int]:
        """A heap entry is the rank and, in its low bits, the place, so that equal ranks come out from the left. ``live``
        has the rank of the pair that starts at each place now; entries of another rank are of pairs that are gone."""
        rank_of, bits, push, pop = self.pairs.get, self.bits, heapq.heappush, heapq.heappop
        ids = list(map(self.first.__getitem__, data))
        n = len(ids)
        low = n.bit_length()
        mask = (1 << low) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [rank_of(a << bits | b, -1) for a, b in pairwise(ids)]
        live.append(-1)
        heap = [r << low | i for i, r in enumerate(live) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, rank = entry & mask, entry >> low
            if live[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            ids[i], ids[j], live[i], live[j] = rank, -1, -1, -1
            if k < n:
                before[k] = i
                live[i] = r = rank_of(rank << bits | ids[k], -1)
                if r >= 0:
                    push(heap, r << low | i)
            h = before[i]
            if h >= 0:
                live[h] = r = rank_of(ids[h] << bits | rank, -1)
                if r >= 0:
                    push(heap, r << low | h)
        return [x for x in ids if x >= 0]


def classes(pattern: str) -> dict[str, str]:
    """Character sets (as the inside of a bracket expression) of the classes in ``pattern``, as the library has them."""
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    out = {}
    for name in {r"\s", *re.findall(r"\\p\{\w+\}", pattern)}:
        found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        points = np.array([ord(c) for c in found.decode_bytes(found.encode_ordinary(every)).decode()])
        edge = np.flatnonzero(np.diff(points) > 1)
        out[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.append(0, edge + 1)], points[np.append(edge, -1)], strict=True))
    return out


def compiled(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """The split of ``pattern``, and that into pieces at white space after another character, for Python's ``re``."""
    sets = classes(pattern)
    space = sets[r"\s"]
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part in sets:
            out.append(sets[part] if inside else f"[{sets[part]}]")
        elif part == r"\S":
            out.append(f"[^{space}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out)), re.compile(f"[{space}]*[^{space}]+|[{space}]+")


class Codec:
    """Encodes and decodes whole texts; what it keeps between slices is bounded."""

    def __init__(self, tokens: dict[bytes, int], pattern: str, most_pieces: int = 300_000, longest: int = 64):
        self.split, self.cut = compiled(pattern)
        known = list(tokens)
        self.tier1, self.ranks = PerfectHash(known), [tokens[t] for t in known]
        self.tier2 = Merges(tokens)
        self.bytes_of = {rank: token for token, rank in tokens.items()}
        self.pieces, self.longest = Pieces(most_pieces), longest

    def encoded(self, wanted: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: of those in the vocabulary by one probe, of all others by merging."""
        return [[self.ranks[x]] if x >= 0 else self.tier2.ids(w) for w, x in zip(wanted, self.tier1.find(wanted), strict=True)]

    def decoded(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def run(self, texts: list[bytes]) -> Iterable[tuple[str, int, bytes]]:
        """Per text: its ids in decimal, joined by commas, their number, and the bytes they decode to."""
        self.pieces.turn()
        cut = [self.cut.findall(t.decode("utf-8", "replace")) for t in texts]
        new = self.pieces.missing(set(chain.from_iterable(cut)))
        tokens = [self.split.findall(p) for p in new]
        wanted = list(dict.fromkeys(chain.from_iterable(tokens)))
        ids = dict(zip(wanted, self.encoded([w.encode() for w in wanted]), strict=True))
        for piece, own in zip(new, tokens, strict=True):
            found = list(chain.from_iterable(ids[t] for t in own))
            self.pieces[piece] = ",".join(map(str, found)), self.decoded(found)
        for own in cut:
            found = list(map(self.pieces.__getitem__, own))
            decimal = ",".join([x[0] for x in found])
            yield decimal, decimal.count(",") + bool(decimal), b"".join([x[1] for x in found])
        for piece in new:
            if len(piece) > self.longest:
                del self.pieces[piece]


def ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec; its tables and cache outlive the task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (if asked for), n_tokens, ids_sha256, decoded_sha256. path: of a rank file that every worker can open."""
    fields = [pa.field("doc_id", pa.int64()), *[pa.field("ids", pa.list_(pa.int32()))] * with_ids, pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def work(batches):
        own = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, 2_000_000):
                out: dict[str, list] = {f.name: [] for f in fields}
                for decimal, n, decoded in own.run(texts_of(batch.column("text"))):
                    if with_ids:
                        out["ids"].append(list(map(int, decimal.split(","))) if decimal else [])
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(hashlib.sha256(decimal.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                out["doc_id"] = batch.column("doc_id").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in fields], schema=pa.schema(fields))

    ids = "ids array<int>, " * with_ids
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, f"doc_id long, {ids}n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data: the bytes of each row's ids (null: none). An id that the vocabulary does not have raises."""

    def work(batches):
        own = codec(path, pattern)
        for batch in batches:
            data = [own.decoded(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return small_batches(encoded).select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, data binary")
