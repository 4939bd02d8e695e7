"""SimHash near-dedup with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits are linked, and linked groups form components. Each bit of 64
fingerprints of a bucket is stored as one word (a bit plane), so one XOR per plane updates 64 distances held in
carry-save counters; a block is abandoned once all its lanes exceed the radius. Candidates come from blocks of
bits: fingerprints within ``radius`` agree on all but ``radius`` of ``blocks`` blocks, so every link lies in a
bucket of at least one choice of agreeing blocks, and none is lost.

Defined results: a null or wordless text has fingerprint 0 and links like any other; a text with fewer words than
a shingle has its whole word sequence as its one shingle; equal fingerprints are one component; rows with equal
ids are kept apart; a null id never is a component's smallest id unless the component has no other; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import slices, texts_of
from .common import fresh, materialize, small_batches, tidied

BITS = 64


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> list[int]:
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return []
    grams = map(b" ".join, zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else [b" ".join(w)]
    return list(map(xxh64_intdigest, grams, repeat(seed)))


def fingerprints(texts: list[bytes], size: int = 3) -> np.ndarray:
    """One uint64 per text: a bit is set if it is in over half of the text's shingle hashes.

    Eight counters share a word: the lanes of (h >> j) & 0x01..01 add up to 255 hashes before they overflow.
    """
    lists = [shingle_hashes(t, size) for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    h = np.fromiter((x for one in lists for x in one), np.uint64, int(n.sum()))
    ends = np.cumsum(n[full])
    starts = ends - n[full]
    parts = (n[full] + 254) // 255
    first = np.cumsum(parts) - parts
    own = np.repeat(np.arange(len(full)), parts)
    cuts = starts[own] + 255 * (np.arange(len(own)) - first[own])
    counts = np.empty((len(own), BITS), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), cuts)
        counts[:, j::8] = lanes.view(np.uint8).reshape(-1, 8)
    bits = 2 * np.add.reduceat(counts, first, axis=0) > n[full][:, None]
    out[full] = (bits.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def document_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (long)."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole):
                fp = fingerprints(texts_of(batch.column("text")), size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


class Components:
    """Union-find over a fixed number of nodes, fed with arrays of pairs; the root is the least node."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def bucket_links(fp: np.ndarray, bucket: np.ndarray, radius: int, most_pairs: int = 2_000_000) -> np.ndarray:
    """Labels (least index) of the components of links within buckets; ``bucket`` is sorted.

    All queries advance together through the 64-lane blocks of their bucket.
    """
    n = len(fp)
    found = Components(n)
    lanes = np.arange(64, dtype=np.uint64)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = fp
    blocks = padded.reshape(-1, 64)
    planes = np.empty((BITS, len(blocks)), np.uint64)
    for j in range(BITS):
        planes[j] = (((blocks >> np.uint64(j)) & np.uint64(1)) << lanes).sum(axis=1, dtype=np.uint64)
    end = np.searchsorted(bucket, bucket, "right")  # one past the bucket's last row
    rows = np.arange(n)
    bits = max(1, (radius + 1 - 1).bit_length())  # counters that overflow at radius + 1 once started at their offset
    start = (1 << bits) - (radius + 1)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    q = rows[rows + 1 < end]
    block = (q + 1) // 64
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    while len(q):
        for s in range(0, len(q), 1 << 18):
            own, at = q[s : s + (1 << 18)], block[s : s + (1 << 18)]
            low = np.maximum(own + 1 - at * 64, 0).astype(np.uint64)
            high = np.minimum(end[own] - at * 64, 64)
            valid = (ones << low) & np.where(high >= 64, ones, (np.uint64(1) << (high % 64).astype(np.uint64)) - np.uint64(1))
            over = ~valid
            counters = [np.full(len(own), ones if start >> k & 1 else np.uint64(0)) for k in range(bits)]
            value = fp[own]
            for j in range(BITS):
                differ = planes[j][at] ^ (np.uint64(0) - ((value >> np.uint64(j)) & np.uint64(1)))
                for k in range(bits):
                    differ, counters[k] = counters[k] & differ, counters[k] ^ differ
                over |= differ
                if j % 4 == 3 and j < BITS - 1:
                    live = over != ones
                    if not live.all():
                        own, at, value, over = own[live], at[live], value[live], over[live]
                        counters = [c[live] for c in counters]
                        if not len(own):
                            break
            near = np.flatnonzero(over != ones)
            for part in np.array_split(near, max(1, len(near) * 64 // most_pairs)):
                word = ~over[part]
                hit, lane = np.nonzero((word[:, None] >> lanes) & np.uint64(1))
                u, v = own[part][hit], at[part][hit] * 64 + lane
                pending.append((u, v))
                held += len(u)
                if held > most_pairs:
                    for u, v in pending:
                        found.union(u, v)
                    pending, held = [], 0
        block = block + 1
        go = block * 64 < end[q]
        q, block = q[go], block[go]
    for u, v in pending:
        found.union(u, v)
    return found.label


def dealt(keyed: DataFrame, tile: int, *columns: str) -> DataFrame:
    """``keyed`` (t, key, node and ``columns``) with the rows of each bucket (t, key) together, in order.

    Buckets beyond ``tile`` rows are dealt into tiles by a hash, and each pair of tiles (a, b) is compared by itself,
    so that no bucket has to fit in one task.
    """
    hot = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("t", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    keyed = keyed.join(hot, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(j, "own").alias("a"), F.greatest(j, "own").alias("b")))
    return keyed.withColumn("p", F.explode(pairs)).select("t", "key", "p.a", "p.b", "node", *columns).repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "node")


def solved(dealt_: DataFrame, solve, most_bytes: int = 32_000_000) -> DataFrame:
    """Links (u, v) from ``solve(table, new)``, called with whole tiles; ``new`` is true where one starts."""

    def each(t: pa.Table):
        key = [t.column(c).to_numpy() for c in ("t", "key", "a", "b")]
        new = np.ones(len(t), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in solve(t, new)], names=["u", "v"])

    def work(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 1 << 16 and sum(x.nbytes for x in held) < most_bytes:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = [t.column(c)[-1].as_py() for c in ("t", "key", "a", "b")]
            same = np.logical_and.reduce([t.column(c).to_numpy() == x for c, x in zip(("t", "key", "a", "b"), last, strict=True)])
            cut = len(same) - int(same.sum())
            if cut:
                yield each(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield each(pa.Table.from_batches(held).combine_chunks())

    return dealt_.mapInArrow(work, "u long, v long").distinct()


def dealt_links(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """A spanning set of links (u, v) within the buckets (t, key) of ``keyed``: t, key, node, fp."""

    def solve(t: pa.Table, new: np.ndarray):
        fp, node = t.column("fp").to_numpy(), t.column("node").to_numpy()
        label = bucket_links(fp.view(np.uint64), np.cumsum(new), radius)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return node[label[linked]], node[linked]

    return solved(dealt(keyed, tile, "fp"), solve)


def links(fps: DataFrame, radius: int = 3, blocks: int = 5, tile: int = 2048) -> DataFrame:
    """A spanning set of links between distinct fingerprints: (u, v), u the lesser of a group found in a bucket.

    fps: one row per distinct fingerprint.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    choices = [signed(sum(c)) for c in combinations(masks, blocks - radius)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(choices)])
    return dealt_links(fps.select(F.col("fp").alias("node"), "fp", F.explode(keys).alias("k")).select("node", "fp", "k.t", "k.key"), radius, tile)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (u, v); root is the component's least node.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")


def grouped(own: DataFrame, fps: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fp, component_id from fingerprints (own; fps with their least id) and the roots of those linked."""
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only groups of several fingerprints come back, from a written table, so that Spark can split a large one.
    several = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "component_id")
    named = rooted.join(materialize(several, "groups"), "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return own.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")


def components(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id."""
    own = materialize(document_fingerprints(docs, size), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return grouped(own, fps, connected(links(fps.select("fp"), radius)))


def report(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by shingles of five words ------------------------------------------------------------------------

DRAWS, BANDS, ROWS = 192, 12, 2
_DRAW = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, DRAWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, wide: int) -> np.ndarray:
    """The hashes of a text's shingles of ``wide`` words, each once, ascending."""
    return np.unique(np.array(shingle_hashes(text, wide), np.uint64))


def minima(h: np.ndarray, draws: int = DRAWS) -> np.ndarray:
    """The least of a text's shingle hashes under each of ``draws`` multiplicative hashes, 32 bits each."""
    out = np.full(draws, np.uint64(0xFFFFFFFFFFFFFFFF))
    for s in range(0, len(h), 512):
        out = np.minimum(out, (h[s : s + 512, None] * _DRAW[:draws]).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def sketch_of(h: np.ndarray) -> bytes:
    low = minima(h)
    return (low ^ (low >> np.uint32(16))).astype(np.uint8).tobytes()


def row_key():
    """With doc_id, what tells rows apart: a hash of text and id."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").cast("long"))


def sketches(docs: DataFrame, size: int = 3, wide: int = 5) -> DataFrame:
    """doc_id, row (see row_key), fp, and of the set of shingles of ``wide`` words: bands and node, a hash of the set."""

    def work(batches):
        from xxhash import xxh3_64_intdigest

        for whole in batches:
            for batch in slices(whole):
                texts = texts_of(batch.column("text"))
                bands, nodes = [], []
                for t in texts:
                    h = shingle_set(t, wide)
                    low = minima(h, BANDS * ROWS)
                    bands.append([xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes()) >> 1 for b in range(BANDS)])
                    nodes.append(xxh3_64_intdigest(h.tobytes()) >> 1)
                arrays = [batch.column("doc_id"), batch.column("row"), pa.array(fingerprints(texts, size).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(nodes, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "fp", "bands", "node"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(tidied(work), "doc_id long, row long, fp long, bands array<long>, node long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, wide: int) -> DataFrame:
    """node, sketch and the whole set of shingle hashes (8 bytes each) for ``wanted``: row, node."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole):
                sets = [shingle_set(t, wide) for t in texts_of(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(sketch_of, sets), pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "sketch", "hashes"])

    found = docs.select(row_key().alias("row"), "text").join(wanted, "row").select("node", "text").mapInArrow(tidied(work), "node long, sketch binary, hashes binary")
    return found.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("hashes").alias("hashes"))


def true_links(sets: list[np.ndarray], sketch: np.ndarray, similarity: float, margin: float) -> tuple[list[int], list[int]]:
    """Spanning links of the sets whose Jaccard similarity is ``similarity`` or more.

    Each set is compared with all that no link has reached yet: by size, by the sketches' estimate, and if that is
    not below similarity - margin, by the sets themselves.
    """
    size = np.array([len(x) for x in sets])
    need = DRAWS * ((similarity - margin) * (1 - 1 / 256) + 1 / 256)  # a byte agrees by chance once in 256
    left, u_, v_ = np.arange(len(sets)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            fits = left[np.minimum(size[left], size[u]) >= similarity * np.maximum(size[left], size[u]) - 1e-6]
            reached = []
            for s in range(0, len(fits), 512):
                near = fits[s : s + 512]
                near = near[(sketch[near] == sketch[u]).sum(axis=1) >= need]
                if not len(near):
                    continue
                flat = np.concatenate([sets[i] for i in near])
                at = np.searchsorted(sets[u], flat)
                same = np.zeros(len(flat), np.int64)
                inside = at < size[u]
                same[inside] = sets[u][at[inside]] == flat[inside]
                both = np.add.reduceat(same, np.cumsum(size[near]) - size[near])
                reached.append(near[both / (size[u] + size[near] - both) >= similarity])
            if reached:
                reached = np.concatenate(reached)
                queue += reached.tolist()
                u_ += [u] * len(reached)
                v_ += reached.tolist()
                left = np.setdiff1d(left, reached, assume_unique=True)
    return u_, v_


def alike_links(docs: DataFrame, texts: DataFrame, wide: int, similarity: float, margin: float, tile: int) -> DataFrame:
    """Links (u, v) of the nodes of ``texts`` (node, row, bands) that share a band and whose sets are alike."""
    buckets = texts.select("node", F.posexplode("bands").alias("t", "key"))
    # Near copies share many bands, mostly with the same partners: of buckets with the same nodes, one is compared.
    members = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"m{i}") for i in range(2)]
    several = buckets.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    several = several.groupBy("n", "m0", "m1").agg(F.min(F.struct("t", "key")).alias("k")).select("k.t", "k.key")
    buckets = materialize(buckets.join(several, ["t", "key"]).select("t", "key", "node"), "buckets")
    sets = materialize(shingle_sets(docs, texts.select("row", "node").join(buckets.select("node").distinct(), "node"), wide), "sets")

    def solve(t: pa.Table, new: np.ndarray):
        node, sketch = t.column("node").to_numpy(), np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, DRAWS)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        starts = np.flatnonzero(new)
        u, v = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(new)], strict=True):
            if b - a > 1:
                x, y = true_links(sets[a:b], sketch[a:b], similarity, margin)
                u += [a + i for i in x]
                v += [a + i for i in y]
        return node[np.array(u, np.int64)], node[np.array(v, np.int64)]

    return solved(dealt(buckets.join(sets, "node"), tile, "sketch", "hashes"), solve)


def near_roots(docs: DataFrame, radius: int = 3, size: int = 3, wide: int = 5, similarity: float = 0.8, margin: float = 0.14, tile: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, fp) and, of fingerprints in groups, the (node, root): two fingerprints are linked within
    ``radius``, or if two of their texts have sets of five-word shingles with a Jaccard similarity of ``similarity``.

    Bands and sketches only propose pairs; the sets decide. A pair at 0.8 shares none of 12 bands (each two minima)
    about once in 200,000, and its estimate falls short by ``margin`` (five standard errors) more rarely still.
    """
    own = materialize(sketches(docs, size, wide), "sketches")
    texts = materialize(own.groupBy("node").agg(F.min("fp").alias("f"), F.min("row").alias("row"), F.first("bands").alias("bands")), "texts")
    alike_ = materialize(alike_links(docs, texts, wide, similarity, margin, tile), "alike")
    place = texts.select("node", "f")
    mapped = alike_.join(place.toDF("u", "fu"), "u").join(place.toDF("v", "fv"), "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    other = own.select("node", "fp").distinct().join(place, "node").where("fp <> f").select(F.col("fp").alias("u"), F.col("f").alias("v"))
    fps = own.select("fp").distinct()
    return own.select("doc_id", "row", "fp"), connected(links(fps, radius, tile=tile).union(mapped).union(other))


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp and the least doc_id of its group (see near_roots)."""
    own, roots = near_roots(docs, **options)
    return grouped(own, own.groupBy("fp").agg(F.min("doc_id").alias("least")), roots)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (null ids last; of rows with equal ids,
    one). Rows are told apart by id and text, so rows that share an id, or have none, only go as copies of another."""
    own, roots = near_roots(docs, **options)
    least = own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    kept = least.join(roots, least["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    row = fresh(docs, "row")
    first = docs.withColumn(row, row_key()).join(kept.select(F.col("least.row").alias(other := fresh(docs, "kept_row"))), F.col(row) == F.col(other), "left_semi")
    return first.dropDuplicates([row]).drop(row)
