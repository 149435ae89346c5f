"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found within a Hamming radius, verified exactly.

Texts are lower-cased words. For an item of n words every window of n words of a document is a
candidate place, unless it shares no shingle with any item, for then its similarity to all is 0;
those windows need no fingerprint. The 64-bit fingerprints are cut in ``blocks`` equal parts. Two
fingerprints within ``radius`` differ by at most radius/blocks bits in one part at least, so a
table of all values that near to an item's part finds every item within the radius. What it finds
is verified by the weighted Jaccard similarity of five-word shingles, a shingle's weight being its
number of distinct words, so that one repeated word weighs little.

Items are taken in blocks of at most ``max_items`` and ``max_bytes``, each broadcast and compared
with all documents in one pass; their number, not the driver's memory, grows with the benchmark.

Edge cases: null or empty items match nothing; an item of fewer than five words is one shingle
and must occur as it is; a document shorter than an item is one window; null text matches nothing;
repeated documents and items match each on their own; a null doc_id or item_id is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordcodes import SHINGLE, hashes, shingle_hashes, slices, text_shingles, word_codes

BITS = 64
#: Window starts of one text that are looked at at once; some 8 MB of sums.
STARTS = 1 << 14


def weights(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct words of every run of ``n`` words."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.int64)
    out = np.ones(size, np.int64)
    for k in range(1, n):
        new = np.ones(size, bool)
        for j in range(k):
            new &= h[k : k + size] != h[j : j + size]
        out += new
    return out


def signed_bits(shingles: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row per shingle: plus or minus its weight for each of 64 bits."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return (2 * bits - 1) * weight[:, None].astype(np.int32)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles, equal shingles having equal weights."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = np.bincount(at[: len(a)], wa, len(keys)), np.bincount(at[len(a) :], wb, len(keys))
    most = np.maximum(left, right).sum()
    return float(np.minimum(left, right).sum() / most) if most else 0.0


class ItemIndex:
    """What a task needs to know of a block of items."""

    def __init__(self, rows: list[tuple[object, str]], blocks: int, radius: int):
        self.blocks, self.radius, self.width = blocks, radius, BITS // blocks
        self.ids = [r[0] for r in rows]
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []
        codes, words, counts = word_codes(pc.utf8_lower(pa.array([r[1] for r in rows], pa.string())))
        h = hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
        prints, by_size = [], {}
        for k, (stop, n) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)):
            own = h[stop - n : stop]
            s, w = text_shingles(own), weights(own, min(SHINGLE, max(1, n)))
            self.items.append((n, s, w))
            prints.append(int(fingerprints(signed_bits(s, w).sum(axis=0, keepdims=True))[0]) if n else 0)
            if n:
                by_size.setdefault(n, []).append(k)
        self.prints = np.array(prints, np.uint64)
        self.sizes = np.array(sorted(by_size), np.int64)
        self.small = {n: ks for n, ks in by_size.items() if n < SHINGLE}
        long = [s for n, s, _ in self.items if n >= SHINGLE]
        self.shingles = np.unique(np.concatenate(long)) if long else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.shingles >> np.uint64(42)] = True
        near = [sum(1 << b for b in c) for r in range(radius // blocks + 1) for c in combinations(range(self.width), r)]
        masks = np.array(near, np.uint64)
        self.tables = {}
        for n in self.sizes[self.sizes >= SHINGLE].tolist():
            ks = np.array(by_size[n])
            parts = []
            for b in range(blocks):
                value = (self.prints[ks] >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)
                around = (value[:, None] ^ masks[None, :]).ravel().astype(np.int64)
                order = np.argsort(around, kind="stable")
                parts.append((np.searchsorted(around[order], np.arange((1 << self.width) + 1)), np.repeat(ks, len(masks))[order]))
            self.tables[n] = parts

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles some item has."""
        out = self.maybe[shingles >> np.uint64(42)]
        at = np.flatnonzero(out)
        if len(at):
            found = np.searchsorted(self.shingles, shingles[at])
            out[at] = self.shingles[np.minimum(found, len(self.shingles) - 1)] == shingles[at]
        return out

    def within(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of size n whose fingerprints are within the radius: the parts' tables, then the whole."""
        left, right = [], []
        for b, (heads, items) in enumerate(self.tables[n]):
            value = ((prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)
            count = heads[value + 1] - heads[value]
            window = np.repeat(np.arange(len(prints)), count)
            item = items[np.repeat(heads[value] - (np.cumsum(count) - count), count) + np.arange(len(window))]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            left.append(window[close])
            right.append(item[close])
        pairs = np.unique(np.concatenate(left) * len(self.items) + np.concatenate(right))
        return pairs // len(self.items), pairs % len(self.items)

    def matches(self, h: np.ndarray, shingles: np.ndarray, hit: np.ndarray, threshold: float) -> list[tuple[int, int, int, float, int]]:
        """(item, start, words, similarity, distance): the best window for each item that this text holds."""
        best: dict[int, tuple[float, int, int, int]] = {}
        m = len(h)
        for n, ks in self.small.items():
            runs = shingle_hashes(h, n)
            for k in ks:
                at = np.flatnonzero(runs == self.items[k][1][0])
                if len(at):
                    best[k] = (1.0, -int(at[0]), n, 0)
        at = np.flatnonzero(hit)
        most = int(self.sizes[-1])
        # a long text is read in portions of window starts, and only where an item's shingle is near
        for low in range(max(0, int(at[0]) - most + SHINGLE), int(at[-1]) + 1, STARTS) if len(at) else ():
            high = min(m, low + STARTS + most)
            if not hit[low:high].any():
                continue
            w = weights(h[low:high])
            sums = np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(signed_bits(shingles[low : low + len(w)], w), axis=0, dtype=np.int32)])
            held = np.concatenate([[0], np.cumsum(hit[low : low + len(w)])])
            for n in self.tables:
                size = min(n, m)
                starts = np.arange(min(STARTS, m - size + 1 - low)) if m - size >= low else np.empty(0, np.int64)
                starts = starts[held[starts + size - SHINGLE + 1] > held[starts]]
                if not len(starts):
                    continue
                prints = fingerprints(sums[starts + size - SHINGLE + 1] - sums[starts])
                for i, k in zip(*(x.tolist() for x in self.within(n, prints)), strict=True):
                    a, b = int(starts[i]), int(starts[i]) + size - SHINGLE + 1
                    found = similarity(shingles[low + a : low + b], w[a:b], self.items[k][1], self.items[k][2])
                    if found >= threshold:
                        mine = (found, -(low + a), size, int(np.bitwise_count(prints[i] ^ self.prints[k])))
                        best[k] = max(best.get(k, mine), mine)
        return [(k, -s, n, round(f, 9), d) for k, (f, s, n, d) in sorted(best.items())]


def item_blocks(items: DataFrame, blocks: int, radius: int, max_items: int, max_bytes: int) -> Iterator[object]:
    """Broadcast indexes over blocks of items, each within the given bounds on average."""
    spark = items.sparkSession
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // max_items), -(-size["b"] // max_bytes))
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        yield spark.sparkContext.broadcast(ItemIndex(rows, blocks, radius))


def _scan(batch: pa.RecordBatch, index: ItemIndex, threshold: float) -> Iterator[tuple[int, list]]:
    """(row, matches) of the rows that have any."""
    codes, words, counts = word_codes(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))
    if not len(codes):
        return
    h = hashes(words)[codes]
    shingles = shingle_hashes(h)
    stops = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    hit = index.known(shingles)
    hit &= row[: len(shingles)] == row[SHINGLE - 1 :]
    rows = range(len(counts)) if index.small else np.unique(row[np.flatnonzero(hit)]).tolist()
    for r in rows:
        begin, stop = int(stops[r] - counts[r]), int(stops[r])
        last = max(begin, stop - SHINGLE + 1)
        found = index.matches(h[begin:stop], shingles[begin:last], hit[begin:last], threshold)
        if found:
            yield r, found


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, blocks: int = 8, radius: int = 19, max_items: int = 20_000, max_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, word_start, n_words, similarity, distance): every document and item whose similarity at some window is at least ``threshold``."""
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, word_start int, n_words int, similarity double, distance int"
    out = None
    for index in item_blocks(items.select("item_id", "text"), blocks, radius, max_items, max_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [(r, *x) for r, xs in _scan(batch, index.value, threshold) for x in xs]
                if found:
                    rows, ks, starts, sizes, sims, far = zip(*found, strict=True)
                    ids = [index.value.ids[k] for k in ks]
                    columns = [batch.column("doc_id").take(pa.array(rows)), pa.array(ids), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(sims), pa.array(far, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "word_start", "n_words", "similarity", "distance"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, blocks: int = 8, radius: int = 19, max_items: int = 20_000, max_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without the rows that hold an item; no shuffle."""
    for index in item_blocks(items.select("item_id", "text"), blocks, radius, max_items, max_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in _scan(batch, index.value, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
