"""Document fingerprints by consistent weighted sampling.

A document's terms are its shingles of five words, weighted by how often they occur (fewer words: one shingle of
all). For each of ``samples`` draws a term of weight S gets r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of the
term and the draw; t = floor(ln S / r + b), ln a = ln c - r (t - b) - r, and the term with the smallest a gives the
draw's element (term, t). Two documents agree in a draw with a chance equal to their generalised Jaccard
similarity, so the share of equal elements estimates it.

Defined results: a null text is an empty one; all texts without words share one fingerprint; equal texts have equal
fingerprints. Documents are taken by descending id (null last; rows with equal ids by a hash of their text), and the
document after the last is the first, so a single row follows itself. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import slices, texts_of
from .common import small_batches

SAMPLES = 64
SHINGLE = 5
_RNG = np.random.Generator(np.random.PCG64(20240501))
_KEYS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_END = np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LONG = 40_000  # texts of more shingles are sampled in pieces, without keeping their values


def shingles(text: bytes) -> np.ndarray:
    """A 64-bit hash per shingle, in text order."""
    from xxhash import xxh3_64_intdigest

    words = text.split()
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = np.full(n, np.uint64(size))
    for j in range(size):
        h = h * _ODD + w[j : j + n]
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


def values(terms: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln a of every term and draw, and t (None where all weights are 1, as t is 0 then)."""
    out = np.empty((len(terms), SAMPLES), np.float32)
    steps = None if weight is None else np.empty((len(terms), SAMPLES), np.int32)
    for s in range(0, len(terms), 512):
        z = terms[s : s + 512, None] * _KEYS
        z ^= z >> np.uint64(32)
        z *= _MUL
        z ^= z >> np.uint64(29)
        # The 64 bits hold the four uniforms of both gammas; a further product gives b.
        four = z.view(np.uint16).reshape(*z.shape, 4).astype(np.float32)
        four += np.float32(0.5)
        z *= _END
        b = (z >> np.uint64(40)).astype(np.float32)
        b *= np.float32(2.0**-24)
        r = np.log(four[..., 0] * four[..., 1] * np.float32(2.0**-32))
        np.negative(r, out=r)
        c = np.log(four[..., 2] * four[..., 3] * np.float32(2.0**-32))
        np.log(np.negative(c, out=c), out=c)
        if weight is None:
            b -= np.float32(1)
            b *= r
            b += c
            out[s : s + 512] = b
        else:
            t = np.floor(np.log(weight[s : s + 512, None]).astype(np.float32) / r + b)
            steps[s : s + 512] = t
            out[s : s + 512] = c - r * (t - b) - r
    return out, steps


def least(value: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = value.argmin(axis=0)
    return value[at, np.arange(SAMPLES)], element[at]


def lesser(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    value, element = parts[0]
    for v, e in parts[1:]:
        less = v < value
        value, element = np.where(less, v, value), np.where(less, e, element)
    return value, element


NOTHING = (np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64))


def weighted(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample of any bag of terms, repeats included."""
    found = [NOTHING]
    one, count = np.unique(terms, return_counts=True)
    for own, weight in ((one[count == 1], None), (one[count > 1], count[count > 1])):
        for s in range(0, len(own), _LONG):
            part = own[s : s + _LONG]
            value, t = values(part, None if weight is None else weight[s : s + _LONG])
            at = value.argmin(axis=0)
            step = 0 if t is None else t[at, np.arange(SAMPLES)].astype(np.uint64) * _ODD
            found.append((value[at, np.arange(SAMPLES)], part[at] + step))
    return lesser(*found)


class Document:
    """A text with its terms and, where no term repeats, their values."""

    def __init__(self, text: bytes):
        self.text = text
        self.terms = shingles(text)
        self.plain = len(self.terms) <= _LONG and len(np.unique(self.terms)) == len(self.terms)
        self.value = values(self.terms)[0] if self.plain and len(self.terms) else None
        self.sample = weighted(self.terms) if self.value is None else least(self.value, self.terms)


def edited(text: bytes, following: bytes) -> tuple[bytes, int]:
    """The text with its last half replaced by as much of the next one, and its number of characters."""
    own, other = text.decode("utf-8", "replace"), following.decode("utf-8", "replace")
    half = len(own) // 2
    return (own[: len(own) - half] + other[:half]).encode(), len(own)


def edited_sample(a: Document, b: Document, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The edited text's sample; terms that it shares with its two sources by place are not drawn again."""
    terms = shingles(text)
    if a.value is None or b.value is None or len(np.unique(terms)) != len(terms):
        return weighted(terms)
    n = min(len(terms), len(a.terms))
    differs = np.flatnonzero(terms[:n] != a.terms[:n])
    head = int(differs[0]) if len(differs) else n
    # Behind the seam the terms run along the next text's; the seam's shift is found where its first whole term is.
    rest = terms[head:]
    parts = [NOTHING]
    if head:
        parts.append(least(a.value[:head], a.terms[:head]))
    if len(rest):
        own = np.ones(len(rest), bool)
        for probe in range(min(len(rest), 2 * SHINGLE)):
            at = np.flatnonzero(b.terms[: 2 * SHINGLE] == rest[probe])
            if len(at):
                start, m = int(at[0]), min(len(rest) - probe, len(b.terms) - int(at[0]))
                unlike = np.flatnonzero(rest[probe : probe + m] != b.terms[start : start + m])
                m = int(unlike[0]) if len(unlike) else m
                parts.append(least(b.value[start : start + m], b.terms[start : start + m]))
                own[probe : probe + m] = False
                break
        if own.any():
            parts.append(least(values(rest[own])[0], rest[own]))
    return lesser(*parts)


def elements(sample: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of each element."""
    e = sample[1]
    e = (e ^ (e >> np.uint64(33))) * _END
    return (e >> np.uint64(48)).astype(">u2")


def report(docs: DataFrame, rows: int = 2048, most_ranges: int = 100_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt into ranges of about ``rows`` ids by one shuffle; the first document of each range also
    goes to the end of the range before it. Only range bounds come to the driver, at most ``most_ranges``.
    """
    ids = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    ranges = min(most_ranges, max(1, -(-n // rows)))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = np.array(ids.agg(F.percentile_approx("doc_id", cuts, 10 * ranges)).first()[0] or [] if cuts else [], np.int64)
    last = len(bounds)

    @F.pandas_udf("int")
    def range_of(x):
        import pandas as pd

        known = x.notna().to_numpy()
        own = np.searchsorted(bounds, x.fillna(0).to_numpy().astype(np.int64), "left")
        return pd.Series(np.where(known, last - own, last).astype(np.int32))

    heads = sorted((r["r"], r["head"]) for r in ids.groupBy(range_of("doc_id").alias("r")).agg(F.max("doc_id").alias("head")).collect())
    before = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    spark = docs.sparkSession
    also = F.broadcast(spark.createDataFrame(before, "_head long, _to int"))
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("r", range_of("doc_id"))
    both = own.join(also, F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    goes = F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("next")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("r"), F.lit(True).alias("next"))))
    dealt = both.select("doc_id", "text", F.explode(F.filter(goes, lambda g: g.isNotNull())).alias("g")).select("g.r", "g.next", "doc_id", "text")
    dealt = dealt.repartition("r").sortWithinPartitions("r", "next", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")

    def work(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: tuple | None = None
        for whole in batches:
            for batch in slices(whole):
                out: list[tuple] = []
                for r, following, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("r", "next", "doc_id")), texts_of(batch.column("text")), strict=True):
                    if following and (held is None or held[0] != r):
                        continue  # a further row with the same id as the next range's first
                    now = Document(text)
                    if held is not None and held[0] == r:
                        a = held[2]
                        changed, n_chars = edited(a.text, text)
                        one, two, three = elements(a.sample), elements(edited_sample(a, now, changed)), elements(now.sample)
                        out.append((held[1], n_chars, hashlib.sha256(changed).hexdigest(), one.tobytes().hex(), two.tobytes().hex(), float((one == two).mean()), float((one == three).mean())))
                    held = None if following else (r, doc_id, now)
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return dealt.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
