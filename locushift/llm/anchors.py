"""Repeated windows over sequences of symbols (words or bytes), found from winnowed anchors.

Every window of ``length`` symbols has one anchor: the smallest hash of its k-grams (the rightmost of equal ones).
Equal windows have equal anchors at equal places, so a window can only be repeated within the bucket of its anchor.
Consecutive windows of a document with the same anchor form a span, and a span is one row; equal spans that follow
each other (in runs of a symbol or a short period) are one row with a count.

1. ``spans`` makes the rows (anchor hash, span hash, document, place).
2. ``candidates`` keeps those whose bucket holds anything else. Equal spans are counted before the shuffle and one
   of them stands for all, with their count, so that a passage that a third of all documents holds is one row.
3. ``payload`` fetches the symbols of the rows that stand for others and of those that are alone. A bucket of more
   than ``most`` different spans is split before it is fetched: a window that reaches far to the left of what its
   bucket has in common goes to a bucket that has those symbols in common, too, any other to one with more symbols
   on the right. Each round halves what a bucket's windows do not yet share, so it ends with buckets of one window.
   The parts go through the steps again as rows of their own, equal parts as one.
4. ``compared`` hands whole buckets to the caller, who finds the repeated windows among their spans.
5. ``found_in`` brings them back to every row that was stood for.

Documents are known by (_d, _t): the id, and a hash of id and text; equal rows share both and so their results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import slices, texts_of
from .common import materialize, small_batches, tidied

KEYS = ["_d", "_t"]
SPAN = ["lo", "n", "at", "m", "left", "right", "off"]
FROM = ["ph", "ps"]  # the span that a row is a part of
#: Different spans that one bucket may hold before it is split.
MOST = 512
#: So many document keys (16 bytes each) are broadcast to pick documents before their texts are shuffled.
SMALL = 200_000
#: Symbols are taken in blocks of this many windows, so that places fit into the low bits of a hash.
BLOCK_BITS = 20
_PLACE = np.uint64((1 << (BLOCK_BITS + 1)) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each place on; k is a power of two. The last k - 1 places hold no full gram."""
    h, step = symbols, 1
    for odd in _ODD:
        if step >= k:
            break
        longer = h * odd
        longer[: len(h) - step] += h[step:]
        h, step = longer, step * 2
    return mix(h)


def block_spans(symbols: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For the windows of ``symbols`` at ``starts`` (ascending): anchor hash and place, first and last window start of each span."""
    h = gram_hashes(symbols.astype(np.uint64), k)
    least = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    width, step = length - k + 1, 1
    while step * 2 <= width:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least[: step - width] = np.minimum(least[: step - width], least[width - step :])
    place = (_PLACE - (least[starts] & _PLACE)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return h[place[first]], place[first], starts[first], starts[last]


def anchored_spans(symbols: np.ndarray, n: np.ndarray, length: int, k: int, block: int = 1 << BLOCK_BITS) -> tuple[np.ndarray, ...]:
    """For documents of n symbols laid end to end: anchor hash, anchor place, first and last window start of each span."""
    starts = np.flatnonzero(np.arange(len(symbols)) + length <= np.repeat(np.cumsum(n), n))
    found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)]
    for base in range(0, len(symbols), block):
        own = starts[np.searchsorted(starts, base) : np.searchsorted(starts, base + block)]
        if len(own):
            h, *places = block_spans(symbols[base : base + block + length - 1], own - base, length, k)
            found.append((h, *[x + base for x in places]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """_d, _t, doc_id, text (null as empty)."""
    text = F.coalesce("text", F.lit(""))
    docs = small_batches(docs)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_d"), F.xxhash64(text, "doc_id").alias("_t"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def spans(docs: DataFrame, symbols_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], length: int, k: int, slice_bytes: int = 1_000_000) -> DataFrame:
    """h, s, _d, _t, lo (first window), n (windows), at (anchor's place in the span), m (equal spans in a row), left and
    right (what the bucket has in common beyond the anchor: nothing yet), off (its first window in the span it is a part
    of: it is whole), c (how many spans it stands for). symbols_of: texts to symbols and their counts."""

    def work(batches):
        from xxhash import xxh3_64_intdigest

        for whole in batches:
            for batch in slices(whole, slice_bytes):
                symbols, size_of = symbols_of(texts_of(batch.column("text")))
                h, place, first, last = anchored_spans(symbols, size_of, length, k)
                if not len(h):
                    continue
                ends = np.cumsum(size_of)
                own = np.searchsorted(ends, first, "right")
                raw, size = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
                s = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip((first * size).tolist(), ((last + length) * size).tolist(), strict=True)), np.uint64, len(first))
                n, at = last - first + 1, place - first
                new = np.ones(len(h), bool)
                new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (h, s, n, at, own)])
                keep = np.flatnonzero(new)
                m = np.diff(np.append(keep, len(h)))
                docs_ = pa.array(own[keep])
                short = lambda x: pa.array(x[keep].astype(np.int32))
                none = pa.array(np.zeros(len(keep), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[keep].view(np.int64)), pa.array(s[keep].view(np.int64)), batch.column("_d").take(docs_), batch.column("_t").take(docs_), short(first - (ends - size_of)[own]), short(n), short(at), pa.array(m.astype(np.int32)), none, none, none, pa.array(m.astype(np.int64))],
                    names=["h", "s", *KEYS, *SPAN, "c"],
                )

    return keyed(docs).select("_d", "_t", "text").mapInArrow(tidied(work), "h long, s long, _d long, _t long, " + ", ".join(f"{x} int" for x in SPAN) + ", c long")


def candidates(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The rows whose bucket holds anything else, with c, how often their span occurs, and hot, if the bucket is to be split."""
    groups = materialize(rows.groupBy("h", "s").agg(F.sum("c").alias("c")), f"{name}-groups")
    buckets = groups.groupBy("h").agg(F.count(F.lit(1)).alias("spans"), F.sum("c").alias("total")).where("total > 1")
    wanted = groups.join(buckets.select("h", (F.col("spans") > most).alias("hot")), "h")
    return materialize(rows.drop("c").join(wanted, ["h", "s"]), f"{name}-candidates")


def payload(docs: DataFrame, found: DataFrame, cut: Callable[[bytes], Sequence], join: Callable[[Sequence], bytes], length: int, k: int) -> DataFrame:
    """h, s, ph, ps, _d, _t, the span's columns, c and span: one row of each group of equal spans with its symbols, and
    for those of hot buckets their two parts (ph, ps: what they are parts of), in smaller buckets and without symbols.

    cut: a text to symbols; join: symbols to bytes.
    """
    columns = [*KEYS, *SPAN, "c", "hot"]
    one = found.where("c > 1").groupBy("h", "s").agg(F.min(F.struct(*columns)).alias("x")).select("h", "s", "x.*")
    rows = found.where("c = 1").select("h", "s", *columns).unionByName(one).groupBy(*KEYS).agg(F.collect_list(F.struct("h", "s", *SPAN, "c", "hot")).alias("rows"))
    texts = keyed(docs).select(*KEYS, "text")
    keys = found.select(*KEYS).distinct()
    if keys.limit(SMALL + 1).count() <= SMALL:
        texts = texts.join(F.broadcast(keys), KEYS, "left_semi")
    # A merge join brings equal documents one after the other, and the first of them is enough.
    joined = texts.join(rows.hint("merge"), KEYS)
    schema = pa.schema([(x, pa.int64()) for x in ("h", "s", *FROM, *KEYS)] + [(x, pa.int32()) for x in SPAN] + [("c", pa.int64()), ("span", pa.binary())])

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def work(batches):
        from xxhash import xxh3_64_intdigest

        before = None
        for whole in batches:
            for batch in slices(whole):
                out = []
                for d, t, text, own in zip(*(batch.column(c).to_pylist() for c in KEYS), texts_of(batch.column("text")), batch.column("rows").to_pylist(), strict=True):
                    if (d, t) == before:
                        continue
                    before = d, t
                    symbols = cut(text)
                    for r in own:
                        lo, n, at, left, right = (r[x] for x in ("lo", "n", "at", "left", "right"))
                        if not r["hot"]:
                            out.append((r["h"], r["s"], None, None, d, t, *(r[x] for x in SPAN), r["c"], join(symbols[lo : lo + n - 1 + length])))
                            continue
                        half, anchor = (length - k - left - right + 1) // 2, lo + at
                        split = min(max(at - left - half + 1, 0), n)
                        for a, b, wider_left, wider_right in ((0, split, left + half, right), (split, n, left, length - k - left - half + 1)):
                            if a < b:
                                core = xxh3_64_intdigest(join(symbols[anchor - wider_left : anchor + k + wider_right]), wider_left << 32 | wider_right)
                                same = xxh3_64_intdigest(join(symbols[lo + a : lo + b - 1 + length]))
                                out.append((signed(core), signed(same), r["h"], r["s"], d, t, lo + a, b - a, at - a, 1, wider_left, wider_right, a, r["c"], None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(tidied(work), ", ".join(f"{x} long" for x in ("h", "s", *FROM, *KEYS)) + ", " + ", ".join(f"{x} int" for x in SPAN) + ", c long, span binary")


def compared(rows: DataFrame, solve: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]], block_bytes: int = 2_000_000) -> DataFrame:
    """h, s, c, _d, _t, lo, first, n: runs of repeated windows of the payload's rows, from ``solve`` on blocks of whole buckets.

    solve: a table sorted by h to (row, first window in the span, windows) arrays.
    """

    def work(batches):
        carry: list[pa.RecordBatch] = []
        held = 0

        def done(t: pa.Table):
            row, first, n = solve(t)
            take = pa.array(row)
            names = ["h", "s", "c", "_d", "_t", "lo"]
            return pa.Table.from_arrays([*(t.column(c).take(take) for c in names), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=[*names, "first", "n"]).combine_chunks().to_batches()

        for whole in batches:
            for batch in slices(whole, block_bytes, "span"):
                carry.append(batch)
                held += batch.nbytes
                if held >= block_bytes:
                    t = pa.Table.from_batches(carry).combine_chunks()
                    h = t.column("h").to_numpy()
                    cut = int(np.searchsorted(h, h[-1], "left"))
                    if cut:
                        yield from done(t.slice(0, cut).combine_chunks())
                        carry, held = t.slice(cut).combine_chunks().to_batches(), t.slice(cut).nbytes
        if carry:
            yield from done(pa.Table.from_batches(carry).combine_chunks())

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(tidied(work), "h long, s long, c long, _d long, _t long, lo int, first int, n int")


def found_in(docs: DataFrame, rows: DataFrame, cut, join, solve, length: int, k: int, name: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The candidates among ``rows`` and their repeated windows: h, s, first (window of the span), n and, where the span
    stands for itself alone, _d, _t and lo."""
    found = candidates(rows, name, most)
    fetched = materialize(payload(docs, found, cut, join, length, k), f"{name}-payload")
    hits = compared(fetched.where("span is not null"), solve).select("h", "s", "first", "n", *[F.when(F.col("c") == 1, F.col(x)).alias(x) for x in (*KEYS, "lo")])
    parts = fetched.where("span is null").drop("span")
    if not parts.isEmpty():
        again, inner = found_in(docs, parts, cut, join, solve, length, k, name, most)
        # A part's windows are those of the span that it is a part of; equal parts of different spans share theirs.
        outer = again.select("h", "s", *FROM, "off").join(inner.select("h", "s", "first", "n").distinct(), ["h", "s"])
        outer = outer.select(F.col("ph").alias("h"), F.col("ps").alias("s"), (F.col("off") + F.col("first")).alias("first"), "n")
        hits = hits.unionByName(outer, allowMissingColumns=True)
    return found, materialize(hits, f"{name}-hits")


def repeated(docs: DataFrame, symbols_of, cut, join, solve, length: int, k: int, name: str, most: int | None = None) -> DataFrame:
    """_d, _t, ranges: array of (lo, n), the repeated windows of each document that has any."""
    rows = materialize(spans(docs, symbols_of, length, k), f"{name}-spans")
    found, hits = found_in(docs, rows, cut, join, solve, length, k, name, MOST if most is None else most)
    alone = hits.where("lo is not null").select(*KEYS, (F.col("lo") + F.col("first")).alias("lo"), "n")
    others = found.where("c > 1 or hot").join(hits.where("lo is null").select("h", "s", "first", F.col("n").alias("run")).distinct(), ["h", "s"])
    # A span that occurs several times in a row is repeated as a whole.
    several = F.col("m") > 1
    others = others.select(*KEYS, F.when(several, F.col("lo")).otherwise(F.col("lo") + F.col("first")).alias("lo"), F.when(several, F.col("n") * F.col("m")).otherwise(F.col("run")).alias("n"))
    return alone.union(others).groupBy(*KEYS).agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))


def covered(ranges: list[dict], n: int, length: int) -> np.ndarray:
    """Which of n symbols lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    lo = np.array([r["lo"] for r in ranges], np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(lo + np.array([r["n"] for r in ranges], np.int64) - 1 + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
