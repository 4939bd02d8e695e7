"""Suffix-array dedup: difference-cover blockwise construction.

Suffixes are the windows of ``length`` bytes that may occur again; they are dealt into buckets by the anchor in
their first ``length`` bytes (equal suffixes share it, at the same place) and sorted one block of buckets at a time.
Within a block, the suffixes at a difference cover (places whose distance from the anchor is in COVER modulo PERIOD)
are ranked first, by doubling, to DEPTH bytes. A suffix is then ordered by bucket and distance from the anchor, by
the rank of the next cover sample and by the few bytes that the sample leaves over, so no comparison reads more than
three words however long the tie, and the memory of a block is bounded by its size. Neighbours with equal keys are
equal strings. Equal stretches of suffixes enter the sort once, with their count.

Defined results: a null text is an empty text; texts shorter than ``length`` bytes lose nothing; equal rows are two
documents, so they lose all bytes if long enough; removal may cut through a character, so kept bytes are bytes;
rows with equal ids keep their own results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .bpe_codec import slices, texts_of

LENGTH = 200
GRAM = 32
#: A perfect difference cover modulo 31; its gaps are at most 13.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
DEPTH = 6 * PERIOD


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as big-endian numbers (a view)."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def dense_ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows by their keys, the first key first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(text: np.ndarray, anchor: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """By place: the rank to DEPTH bytes of each cover sample that has so many; -1 elsewhere."""
    n = end - start
    own = np.repeat(np.arange(len(start)), n)
    at = np.arange(len(own))
    after = end[own] - at
    has = np.flatnonzero(IN_COVER[(at - anchor[own]) % PERIOD] & (after >= PERIOD))
    words = words_at(np.concatenate([text, np.zeros(8, np.uint8)]))

    def placed(at: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(own), -1)
        out[at] = dense_ranks(keys)
        return out

    def longer(short: np.ndarray, more: np.ndarray, step: int, depth: int) -> np.ndarray:
        at = has[after[has] >= depth]
        return placed(at, [short[at].astype(np.uint64) << np.uint64(32) | more[at + step].astype(np.uint64)])

    r1 = placed(has, [words[has + o].astype(np.uint64) for o in (0, 8, 16, PERIOD - 8)])
    r2 = longer(r1, r1, PERIOD, 2 * PERIOD)
    r4 = longer(r2, r2, 2 * PERIOD, 4 * PERIOD)
    return longer(r4, r2, 4 * PERIOD, DEPTH)


#: By distance from the anchor modulo PERIOD: whether the place is in the cover, and steps forward to the next one.
IN_COVER = np.isin(np.arange(PERIOD), COVER)
AHEAD = np.array([min((c - x) % PERIOD for c in COVER) for x in range(PERIOD)])


def solve_for(length: int):
    over = length - DEPTH  # bytes of a window that its sample leaves over, in front of it and behind
    if not max(AHEAD) <= over <= 16:
        raise ValueError(f"the cover's samples suit windows of {DEPTH + max(AHEAD)} to {DEPTH + 16} bytes")

    def solve(t: pa.Table):
        h, c, n, at = (t.column(x).to_numpy() for x in ("h", "c", "n", "at"))
        n, at = n.astype(np.int64), at.astype(np.int64)
        spans = t.column("span").to_pylist()
        text = np.frombuffer(b"".join(spans), np.uint8)
        end = np.cumsum([len(s) for s in spans])
        start = end - (n - 1 + length)
        anchor = start + at
        ranks = cover_ranks(text, anchor, start, end)
        row = np.repeat(np.arange(len(n)), n)
        window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = start[row] + window
        ahead = AHEAD[(place - anchor[row]) % PERIOD]
        # The bytes left over, 16 at most: those before the sample, then those behind it.
        rest = np.empty((len(row), 16), np.uint8)
        for o in range(16):
            rest[:, o] = text[place + np.where(o < ahead, o, np.minimum(DEPTH + o, length - 1))]
        rest = rest.view(">u8").astype(np.uint64)
        bucket = np.cumsum(np.append(0, h[1:] != h[:-1]))[row]
        where = (bucket * (2 * length) + (place - anchor[row]) + length).astype(np.uint64)
        suffix = dense_ranks([where << np.uint64(32) | ranks[place + ahead].astype(np.uint64), rest[:, 0], rest[:, 1]])
        hit = np.bincount(suffix, weights=c[row])[suffix] > 1
        first = hit.copy()
        first[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        last = hit.copy()
        last[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        return row[a], window[a], b - a + 1

    return solve


def removed_bytes(docs: DataFrame, length: int = LENGTH, most: int | None = None) -> DataFrame:
    """_d, _t, ranges: runs of repeated windows."""
    return anchors.repeated(docs, byte_symbols, bytes, bytes, solve_for(length), length, GRAM, "suffix", most)


def report(docs: DataFrame, length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    joined = anchors.keyed(docs).join(removed_bytes(docs, length), anchors.KEYS, "left").select("doc_id", "text", "ranges")

    def work(batches):
        for whole in batches:
            for batch in slices(whole):
                out: list[tuple] = []
                for text, ranges in zip(texts_of(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                    kept, runs = text, 0
                    if ranges:
                        gone = anchors.covered(ranges, len(text), length)
                        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    out.append((len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out, strict=True))
                arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), *[pa.array(cols[4], pa.binary())] * with_kept]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept])

    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
