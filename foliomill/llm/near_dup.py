"""N-gram Jaccard join: MinHash bands propose pairs, a Bayesian rule prunes them, exact sets decide.

Texts are lower-cased words; those with equal words are copies and form one text, whatever their
number. Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
least ``threshold``. A class is a connected component of links.

1. Every text gets ``HASHES`` MinHash values of 16 bits; ``BANDS`` bands of four propose pairs (a
   pair at similarity 0.8 is missed with probability 5e-8).
2. Within a band's bucket pairs are compared value by value, 32 at a time. After m of k agree, the
   similarity is Beta(m+1, k-m+1), and a pair goes when P(similarity >= threshold) < ``tolerance``.
3. Pairs that stay join their texts to components; each text's words are sent to its component
   once, sets are compared exactly, and links counted. All pairs of a component are verified, so
   what one band lost another's chain brings back.

Large buckets and components are dealt out as pairs of blocks of at most ``BLOCK`` texts: no task
holds a whole one, and no pair becomes a row. A task tells links as counts and a forest per block.

Edge cases: null text counts as empty; texts without words are copies of each other with no links;
a text of under five words is one shingle; null doc_ids are carried along, a class whose members
all lack an id has a null class_id; repeated rows are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small_side, table
from .components import components
from .wordcodes import SHINGLE, hashes, mixed, shingle_hashes, slices, word_codes

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
CHECKS = (32, 64, 96, 128)
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: Rows of ids and numbers that may be broadcast, some 30 MB; more are shuffled.
SMALL = 500_000
MULTIPLIERS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
SHIFTS = mixed(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64))


def batch_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their number per text, shingle hashes and their number per text."""
    codes, words, counts = word_codes(pc.utf8_lower(pc.fill_null(texts, "")))
    h = hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    out = np.empty(int(n.sum()), np.uint64)
    stops, ends = np.cumsum(counts), np.cumsum(n)
    if len(h):
        row = np.repeat(np.arange(len(counts)), counts)
        runs = shingle_hashes(h)
        inside = row[: len(runs)] == row[SHINGLE - 1 :]
        long = np.repeat(counts >= SHINGLE, n)
        out[long] = runs[inside]
        for r in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
            out[ends[r] - 1] = shingle_hashes(h[stops[r] - counts[r] : stops[r]], int(counts[r]))[0]
    return h, counts, out, n


def signatures(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of MinHash values for each text with shingles (others: zeros)."""
    out = np.zeros((len(n), HASHES), np.uint16)
    full = np.flatnonzero(n)
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        for k in range(HASHES):
            least = np.minimum.reduceat(shingles * MULTIPLIERS[k] + SHIFTS[k], starts)
            out[full, k] = (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def digests(h: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw, stops = h.tobytes(), np.cumsum(counts) * 8
    return [hashlib.blake2b(raw[b - 8 * n : b], digest_size=16).digest() for b, n in zip(stops.tolist(), counts.tolist(), strict=True)]


def digested(docs: DataFrame) -> DataFrame:
    """(digest, text) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, counts, _, _ = batch_shingles(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(digests(h, counts), pa.binary()), batch.column("text")], names=["digest", "text"])

    return docs.select("text").mapInArrow(run, "digest binary, text string")


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, sig) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, counts, shingles, n = batch_shingles(batch.column("text"))
            sig = signatures(shingles, n)
            packed = [pa.array(digests(h, counts), pa.binary()), pa.array(n.astype(np.int32)), pa.array([s.tobytes() for s in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *packed], names=["doc_id", "digest", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, n int, sig binary")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values the fewest agreeing ones with P(similarity >= threshold) >= tolerance, from a uniform prior."""
    out = {}
    for k in CHECKS:
        below = 0.0
        for m in range(k + 1):
            below += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)  # P(Beta(m+1, k-m+1) >= threshold)
            if below >= tolerance:
                break
        out[k] = m
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, and where their groups begin."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        heads = cut(t)
        if len(heads) > 1:
            yield t.slice(0, heads[-1]), heads[:-1]
            held = t.slice(heads[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, cut(t)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node each of n nodes is joined to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def dealt(df: DataFrame, key: str, parts: Column) -> DataFrame:
    """Rows of a group as pairs of its blocks: ``bi`` <= ``bj``, and the row's own ``block``."""
    df = df.withColumn("_parts", parts.cast("int")).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("_parts").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other")
    out = df.select("*", other).withColumn("bi", F.least("block", "_other")).withColumn("bj", F.greatest("block", "_other"))
    return out.drop("_parts", "_other").repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj", "tid")


def group_pairs(heads: np.ndarray, total: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within groups, in portions: groups of one size at a time."""
    sizes = np.diff(np.append(heads, total))
    for g in np.unique(sizes[sizes > 1]).tolist():
        first = heads[sizes == g]
        i, j = np.triu_indices(g, 1)
        step = max(1, most // len(i))
        for k in range(0, len(first), step):
            for c in range(0, len(i), most):
                yield (first[k : k + step, None] + i[None, c : c + most]).ravel(), (first[k : k + step, None] + j[None, c : c + most]).ravel()


def survivors(buckets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): a forest over the texts whose pairs stay after the Bayesian comparison. ``buckets``: key, bi, bj, block, tid, sig."""
    fewest = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads in grouped(batches, ["key", "bi", "bj"]):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            tid, block = t.column("tid").to_numpy(), t.column("block").to_numpy()
            one = t.column("bi").to_numpy() == t.column("bj").to_numpy()
            nodes, at = np.unique(tid, return_inverse=True)
            root = np.arange(len(nodes))
            for a, b in group_pairs(heads, t.num_rows):
                ok = (one[a] | (block[a] != block[b])) & (root[at[a]] != root[at[b]])
                a, b = a[ok], b[ok]
                agreed, done = np.zeros(len(a), np.int64), 0
                for k in CHECKS:
                    agreed += (sig[a, done:k] == sig[b, done:k]).sum(axis=1)
                    stay = agreed >= fewest[k]
                    a, b, agreed, done = a[stay], b[stay], agreed[stay], k
                    if not len(a):
                        break
                if len(a):
                    new = forest(np.concatenate([at[a], np.arange(len(nodes))]), np.concatenate([at[b], root]), len(nodes))
                    root = new
            joined = np.flatnonzero(root != np.arange(len(nodes)))
            if len(joined):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[joined]), pa.array(nodes[root[joined]])], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(tid, links, root) per text and block pair: exact links, and the least text of the block pair it is joined to."""
    top, bottom = round(threshold * 1000), 1000

    def compare(texts: pa.Array, tid: np.ndarray, digest: list[bytes], block: np.ndarray, one: bool) -> pa.RecordBatch | None:
        h, counts, shingles, n = batch_shingles(texts)
        row = np.repeat(np.arange(len(n)), n)
        # a doc_id may stand on several texts: the digest tells the one that is meant, once
        good = np.array([a == b for a, b in zip(digests(h, counts), digest, strict=True)])
        good[np.setdiff1d(np.flatnonzero(good), np.flatnonzero(good)[np.unique(tid[good], return_index=True)[1]])] = False
        pairs = np.unique(np.stack([shingles, row.astype(np.uint64)], axis=1)[good[row]], axis=0) if len(row) else np.empty((0, 2), np.uint64)
        column, row = pairs[:, 0], pairs[:, 1].astype(np.int64)
        size = np.bincount(row, minlength=len(n))
        fresh = np.append(True, column[1:] != column[:-1]) if len(column) else np.empty(0, bool)
        number = np.cumsum(fresh) - 1
        shared = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
        row, number = row[shared], number[shared]
        both = np.zeros((len(n), len(n)), np.float32)
        if len(number):
            number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1
            for c in range(0, int(number[-1]) + 1, 4096):
                low, high = np.searchsorted(number, [c, c + 4096])
                held = np.zeros((len(n), min(4096, int(number[-1]) + 1 - c)), np.float32)
                held[row[low:high], number[low:high] - c] = 1
                both += held @ held.T
        met = both.astype(np.int64)
        union = size[:, None] + size[None, :] - met
        linked = (met * bottom >= top * union) & (union > 0)
        np.fill_diagonal(linked, False)
        if not one:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        root = forest(a, b, len(n))
        keep = np.flatnonzero(linked.any(axis=1))
        if not len(keep):
            return None
        # rows come ordered by tid, so the least row is the least text
        return pa.RecordBatch.from_arrays([pa.array(tid[keep]), pa.array(linked.sum(axis=1)[keep].astype(np.int64)), pa.array(tid[root[keep]])], names=["tid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads in grouped(batches, ["comp", "bi", "bj"]):
            t = t.combine_chunks()
            for first, stop in zip(heads.tolist(), [*heads[1:].tolist(), t.num_rows], strict=True):
                g = t.slice(first, stop - first)
                found = compare(g.column("text").combine_chunks(), g.column("tid").to_numpy(), g.column("digest").to_pylist(), g.column("block").to_numpy(), g.column("bi")[0] == g.column("bj")[0])
                if found is not None:
                    yield found

    return members.mapInArrow(run, "tid long, links long, root long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """(doc_id, digest, class_id, n_links, n_copies) for every row of ``docs`` (doc_id, text).

    ``digest`` is that of the row's words, ``class_id`` the least doc_id of the class, ``n_links`` the number of other texts linked to
    this one, ``n_copies`` the number of rows with the same words.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near-dup")
    rows = work.write(signed(docs), "signed")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("n_copies"))
    texts = work.write(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * 2 * ROWS + 1, F.lit(2 * ROWS)))))
    keys = texts.where("n > 0").select("tid", band.alias("key"))
    many = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = keys.join(many, "key").join(texts.select("tid", "sig"), "tid")
    stays = survivors(dealt(buckets, "key", F.ceil(F.col("size") / BLOCK)), threshold, tolerance)
    joined = components(stays, work, "candidates")

    joined = work.write(joined.withColumnRenamed("node", "tid").join(texts.select("tid", "rep", "digest", "n"), "tid"), "joined")
    sizes = joined.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    # Where few texts have candidates, the others' words stay where they are.
    members = work.write(joined.join(sizes, "root").withColumnsRenamed({"root": "comp", "rep": "_id"}).drop("n"), "members")
    fields = ["comp", "tid", "digest", "parts", "text"]
    with_text = docs.select("doc_id", "text").join(small_side(members, SMALL), F.col("doc_id") == F.col("_id")).select(*fields)
    # texts of which no row has an id are found by their digests
    nameless = digested(docs.where("doc_id is null")).join(small_side(members.where("_id is null"), SMALL), "digest").dropDuplicates(["digest"])
    with_text = with_text.unionByName(nameless.select(*fields))
    links = work.write(verified(dealt(with_text, "comp", F.col("parts")), threshold), "links")

    classes = components(links.select(F.col("tid").alias("a"), F.col("root").alias("b")), work, "classes").withColumnsRenamed({"node": "tid"})
    counted = links.groupBy("tid").agg(F.sum("links").alias("n_links"))
    named = classes.join(texts.select("tid", "rep"), "tid")
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    told = named.join(least, "root").join(counted, "tid").select("tid", "class_id", "n_links")
    per_text = texts.join(told, "tid", "left").select("digest", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return rows.select("doc_id", "digest").join(per_text, "digest")


def one_of_each(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """``docs`` with the document of least doc_id of every class, once. Rows without an id cannot be told apart and stay."""
    work = Workspace(docs.sparkSession, "one-of-each")
    found = work.write(near_duplicates(docs, threshold, tolerance).select("doc_id", "class_id", "digest"), "classes")
    stays = F.bool_or(F.col("doc_id") == F.col("class_id"))
    gone = work.write(found.where("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays")).where("not stays").select("doc_id"), "gone")
    kept = docs.join(small_side(gone, SMALL), "doc_id", "left_anti")
    # A row that is there twice goes once; only then do texts have to meet.
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("digest")
