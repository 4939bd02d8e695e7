"""Substring dedup by seed and extend.

Documents meet on winnowed anchors (the seeds). A seed's occurrences are extended together, word by word to the left
and to the right, as long as they agree with another occurrence; runs of windows of ``length`` words that still agree
are the maximal repeats over the threshold, and their words go. Occurrences with equal surroundings count as one
before they are extended, and no pairs of occurrences are made.

Defined results: a null text has no words; texts shorter than ``length`` words lose nothing; equal rows are two
documents, so they lose all words if long enough; rows with equal ids keep their own results; an empty table gives
an empty result; ``dedup`` keeps extra columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .bpe_codec import slices, texts_of
from .common import fresh, tidied

LENGTH = 35
GRAM = 8


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and each text's number of words."""
    from xxhash import xxh3_64_intdigest

    cut = [t.split() for t in texts]
    n = np.array([len(w) for w in cut], np.int64)
    return np.fromiter(map(xxh3_64_intdigest, (w for ws in cut for w in ws)), np.uint64, int(n.sum())), n


def following(cls: np.ndarray, words: np.ndarray, n_words: int, inside: np.ndarray) -> np.ndarray:
    """The classes of occurrences after one more word: those of one class that go on with the same word stay together.

    -1: the occurrence has no word there.
    """
    out = np.full(len(cls), -1)
    out[inside] = np.unique(cls[inside] * n_words + words[inside], return_inverse=True)[1]
    return out


def extend(length: int, k: int):
    """Extends all occurrences of a seed together, word by word to both sides.

    Occurrences that agree so far share a class. A window that reaches x words to the left of the seed is repeated if
    another occurrence shares both its class x words to the left and its class to the right, up to the window's end;
    neighbouring repeated windows are one maximal repeat.
    """
    rest = length - k

    def solve(t: pa.Table):
        c, n, at = (t.column(x).to_numpy().astype(np.int64) for x in ("c", "n", "at"))
        cut = [x.split(b" ") for x in t.column("span").to_pylist()]
        index: dict[bytes, int] = {}
        size = np.array([len(x) for x in cut])
        ids = np.array([index.setdefault(w, len(index)) for ws in cut for w in ws])
        start = np.cumsum(size) - size
        seed, end = start + at, start + size

        def step(cls: np.ndarray, place: np.ndarray) -> np.ndarray:
            inside = (cls >= 0) & (place >= start) & (place < end)
            return following(cls, ids[np.where(inside, place, 0)], len(index), inside)

        h = t.column("h").to_numpy()
        core = np.cumsum(np.append(0, h[1:] != h[:-1]))
        for i in range(k):
            core = step(core, seed + i)
        left, right = [core], [core]
        for i in range(rest):
            left.append(step(left[-1], seed - 1 - i))
            right.append(step(right[-1], seed + k + i))
        hit = np.zeros((len(h) + 1, rest + 2), bool)  # by window of the span; the last row and column stay empty
        for x in range(rest + 1):
            window = at - x
            own = np.flatnonzero((window >= 0) & (window < n))
            if len(own):
                both = np.unique(left[x][own] * (len(h) + 1) + right[rest - x][own], return_inverse=True)[1]
                hit[own, window[own]] = np.bincount(both, weights=c[own])[both] > 1
        flat = hit.ravel()
        turn = np.flatnonzero(flat[1:] != flat[:-1]) + 1
        if flat[0]:
            turn = np.append(0, turn)
        first, after = turn[::2], turn[1::2]
        return first // (rest + 2), first % (rest + 2), after - first

    return solve


def removed_words(docs: DataFrame, length: int = LENGTH, most: int | None = None) -> DataFrame:
    """_d, _t, ranges: runs of repeated windows."""
    return anchors.repeated(docs, word_symbols, bytes.split, b" ".join, extend(length, GRAM), length, GRAM, "substring", most)


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    joined = anchors.keyed(docs).join(removed_words(docs, length), anchors.KEYS, "left").select("doc_id", "text", "ranges")

    def work(batches):
        for whole in batches:
            for batch in slices(whole):
                n, gone, sha = [], [], []
                for text, ranges in zip(texts_of(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                    w = text.split()
                    n.append(len(w))
                    if ranges:
                        out = anchors.covered(ranges, len(w), length).tolist()
                        w = [x for x, o in zip(w, out, strict=True) if not o]
                    gone.append(n[-1] - len(w))
                    sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(tidied(work), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeats cut out of their texts (white space before a removed word goes with it)."""
    name, key, found_ranges = (fresh(docs, x) for x in ("_dedup_key", "_found_key", "_found_ranges"))
    marked = docs.withColumn(name, F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_d"), F.xxhash64(F.coalesce("text", F.lit("")), "doc_id").alias("_t")))
    found = removed_words(docs, length).select(F.struct("_d", "_t").alias(key), F.col("ranges").alias(found_ranges))
    joined = marked.join(found, F.col(name) == F.col(key), "left").drop(name, key)

    def work(batches):
        import re

        word = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")
        for whole in batches:
            for batch in slices(whole):
                texts = []
                for text, ranges in zip(texts_of(batch.column("text")), batch.column(found_ranges).to_pylist(), strict=True):
                    if ranges:
                        pieces = word.findall(text)
                        out = anchors.covered(ranges, len(pieces), length).tolist()
                        text = b"".join(x for x, o in zip(pieces, out, strict=True) if not o).strip()
                    texts.append(text)
                texts = [x if ok else None for x, ok in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True)]
                at = batch.schema.get_field_index("text")
                kept = batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string()))
                if (i := kept.schema.get_field_index("n_chars")) >= 0:
                    import pyarrow.compute as pc

                    kept = kept.set_column(i, "n_chars", pc.utf8_length(kept.column("text")).cast(kept.schema.field(i).type))
                yield kept.select(docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(tidied(work), docs.schema)
