"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features: words, n-grams of 3 to 5 characters (code points) within
words, and pairs of neighbouring words (a word beside itself is one feature of its own), all hashed to buckets. A
softmax over two classes is trained on them by stochastic gradient descent in numpy. As the output is linear in the
average, each bucket is folded to one number for scoring, and a word's sum is kept while it stays in a cache.

Training reads at most ``most_labelled`` labelled documents, the first by a hash of their id, and of these the first
whose texts add up to ``most_bytes`` (bounds, stated here; all documents are scored). Labels come only from rows whose
crc32(doc_id as text) mod 3 is not 1; no column but the text is an input. A document that is labelled both ways
teaches nothing; of several texts with one id, the least one teaches.

Defined results: a null text is an empty text, scored by the feature that every document has; rows with equal ids
or texts are scored alike; a null id is not held out; without any label of both classes all scores are 0.5; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .bpe_codec import slices, texts_of
from .common import small_batches

BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4, 5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
EVERY, SAME = 0, 1  # buckets of the feature that every document has, and of a word beside itself


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: their hashes, all their buckets in a row, and how many each has."""
    framed = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    n = np.array([len(w) for w in framed], np.int64)
    text = np.frombuffer("".join(framed).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    end = np.cumsum(n)
    start = end - n
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text))
    powers = np.cumprod(np.full(int(n.max(initial=1)), _ODD))
    whole = mix(np.add.reduceat((text + np.uint64(1)) * powers[place - start[own]], start)) if len(n) else text
    h = np.zeros(len(text), np.uint64)
    found, owners = [bucket_of(whole)], [np.arange(len(n))]
    for j in range(max(GRAMS)):
        m = len(text) - j
        h = h[:m] * _ODD + text[j:] + np.uint64(1)
        if j + 1 in GRAMS:
            at = np.flatnonzero(place[:m] + j < end[own[:m]])
            found.append(bucket_of(mix(h[at] + np.uint64(j))))
            owners.append(own[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return whole, np.concatenate(found)[order], np.bincount(owner, minlength=len(n))


def pair_buckets(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket of each word with the one before it; -1 at the first word of a document."""
    out = np.empty(len(h), np.int64)
    out[1:] = np.where(h[1:] == h[:-1], SAME, bucket_of(mix(h[:-1] * _PAIR + h[1:])))
    out[first] = -1
    return out


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a document and how often each occurs."""
    words = text.split()
    found = [np.array([EVERY])]
    if words:
        index: dict[bytes, int] = {}
        at = np.array([index.setdefault(w, len(index)) for w in words])
        h, buckets, n = word_features(list(index))
        times = np.bincount(at)
        found += [np.repeat(buckets, np.repeat(times, n)), pair_buckets(h[at], np.array([0]))[1:]]
    return np.unique(np.concatenate(found), return_counts=True)


Row = tuple[np.ndarray, np.ndarray]


def averaged(text: bytes) -> Row:
    """The distinct buckets of a document and their shares of its features."""
    buckets, times = document_features(text)
    return buckets.astype(np.int32), (times / times.sum()).astype(np.float32)


def train(rows: list[Row], labels: list[int], epochs: int = 6, rate: float = 8.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The buckets' vectors and the output matrix, by stochastic gradient descent on the softmax of two classes."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = np.zeros((2, DIM), np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs if len(set(labels)) == 2 else 0):
        for i in rng.permutation(len(rows)):
            eta = rate * (1 - step / steps)
            step += 1
            b, share = rows[i]
            hidden = share @ vectors[b]
            z = output @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ output
            output -= np.float32(eta * 0.05) * np.outer(p, hidden)
            vectors[b] -= np.outer(np.float32(eta) * share, back)
    return vectors, output


def folded(vectors: np.ndarray, output: np.ndarray) -> np.ndarray:
    """One number per bucket: what it adds, on average over the features, to the log odds of label 1."""
    return vectors @ (output[1] - output[0])


class Scorer:
    """Scores texts with folded weights; remembers the words it has seen, up to ``most``."""

    def __init__(self, weights: np.ndarray, most: int = 400_000):
        self.weights, self.most = weights, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.hash, self.sum, self.count = np.empty(0, np.uint64), np.empty(0), np.empty(0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if len(self.index) > self.most:
            self.clear()
        cut = [t.split() for t in texts]
        index = self.index
        new = [w for w in dict.fromkeys(w for ws in cut for w in ws) if w not in index]
        if new:
            h, buckets, n = word_features(new)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.hash = np.append(self.hash, h)
            self.sum = np.append(self.sum, np.add.reduceat(self.weights[buckets].astype(np.float64), np.cumsum(n) - n))
            self.count = np.append(self.count, n)
        n = np.array([len(ws) for ws in cut], np.int64)
        at = np.fromiter(map(index.__getitem__, (w for ws in cut for w in ws)), np.int64, int(n.sum()))
        total, features = np.full(len(texts), float(self.weights[EVERY])), np.ones(len(texts))
        full = np.flatnonzero(n)
        if len(full):
            start = (np.cumsum(n) - n)[full]
            pairs = pair_buckets(self.hash[at], start)
            value = self.sum[at] + np.where(pairs < 0, 0.0, self.weights[pairs])
            total[full] += np.add.reduceat(value, start)
            features[full] += np.add.reduceat(self.count[at] + (pairs >= 0), start)
        return 1 / (1 + np.exp(-np.clip(total / features, -30, 30)))


def learned(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, most_bytes: int = 64_000_000) -> np.ndarray:
    """The folded weights, trained by one task on the bounded sample. Texts become features as they arrive; one that would
    take the sample over ``most_bytes`` is left out, and those after it are still taken."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other"))
    sample = known.where("label = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).select("doc_id", "label")
    # At most ``most_labelled`` ids and labels are broadcast, so the texts of other documents are not moved.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", "x.label")

    def work(batches):
        rows, labels, held = [], [], 0
        for whole in batches:
            for batch in slices(whole):
                for text, label in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                    if held + len(text) <= most_bytes:
                        held += len(text)
                        rows.append(averaged(text))
                        labels.append(label)
        yield pa.RecordBatch.from_arrays([pa.array([folded(*train(rows, labels)).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    row = one.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(work, "weights binary").first()
    return np.frombuffer(row[0], "<f4") if row else np.zeros(BUCKETS, "<f4")


def report(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    weights = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, most_labelled))

    def work(batches):
        scorer = Scorer(weights.value)
        for whole in batches:
            for batch in slices(whole, 2_000_000):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scorer.score(texts_of(batch.column("text"))))], names=["doc_id", "held_out", "score"])

    scored = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
