"""Substring dedup: words in a window of ``words`` words that also starts in a document with a smaller id are removed.

Texts are gathered into batches, one written row each. Every window of every batch gets two Rabin-Karp hashes, rolled over the batch by
prefix sums: one deals it to a bucket, the other is its key there. A batch sends each bucket its distinct keys once, with the least id that has
them, so a passage that a third of all documents share is one key a batch. A bucket counts and answers each batch with one bit a key: "has a smaller owner elsewhere".
With these bits a batch reads its own texts again, merges removed windows into maximal intervals and cuts them out. Only keys and bits are shuffled:
texts stay in the batches' table, which is bucketed by batch.

Buckets hold about ``bucket_windows`` windows whatever the input, so two different windows are taken for equal with a chance of
some 10^-6 a bucket (64 bits of key beyond the bucket's own hash). Where batches times buckets exceed the windows, messages shrink to one key each,
an ordinary shuffle of rows; larger ``batch_bytes`` and ``bucket_windows`` put that off.

Edge cases: null text counts as without words; texts with fewer words than a window lose none; windows are judged on the
input, so a chain of overlapping copies goes whole; a null doc_id is the smallest, as is the least long; rows with the same doc_id spare each other;
a repeat within one document stays; a table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table
from .wordcodes import PLACES, hashes, mixed, slices, word_codes

LEAST = np.iinfo(np.int64).min
#: Odd bases of the two rolling hashes, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95)


@dataclass(frozen=True)
class WindowRule:
    words: int = 50
    #: Bytes of text in a batch, whose windows are hashed together; a text is in one batch.
    batch_bytes: int = 8 << 20
    #: Windows that meet in one task, on average.
    bucket_windows: int = 3 << 20
    #: Bytes of text that a task of the second reading is given, on average.
    task_bytes: int = 16 << 20


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``size`` values, modulo 2^64: sum of h[j + k] * base^(size - 1 - k)."""
    n = len(h)
    if n < size:
        return np.empty(0, np.uint64)
    powers = np.full(n + size, base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(inverse), dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * powers[size - 1 : n]


class Windows:
    """The windows of a batch of texts: where they start, whose they are, and the distinct keys in the order in which buckets get them."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, size: int, buckets: int):
        self.codes, self.dictionary, self.counts = word_codes(texts)
        self.ids, by_id = np.unique(ids, return_inverse=True)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), self.counts)
        first = hashes(self.dictionary)
        h = first[self.codes] if len(self.codes) else np.empty(0, np.uint64)
        key, other = rolling(h, size, BASES[0]), rolling(mixed(first + PLACES[1])[self.codes] if len(h) else h, size, BASES[1])
        inside = row[: len(key)] == row[size - 1 :] if len(key) else np.empty(0, bool)
        self.start = np.flatnonzero(inside)
        bucket = ((mixed(other[inside]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        key = mixed(key[inside] + bucket.astype(np.uint64) * PLACES[2])
        self.owner = by_id[row[self.start]]

        order = np.argsort(key)
        ranked = key[order]
        new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(key) else np.empty(0, np.int64)
        #: For each window its distinct key.
        self.which = np.empty(len(key), np.int64)
        self.which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
        self.least = np.minimum.reduceat(self.owner[order], new) if len(new) else np.empty(0, np.int64)
        self.keys, self.bucket = ranked[new], bucket[order][new]
        self.sent = np.argsort(self.bucket * max(1, len(self.ids)) + self.least, kind="stable")

    def messages(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, owners' ids, how many keys each owns, keys)."""
        bucket, least, keys = self.bucket[self.sent], self.least[self.sent], self.keys[self.sent]
        ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(bucket) else []
        for low, high in zip([0, *ends], ends, strict=False):
            owners, counts = np.unique(least[low:high], return_counts=True)
            yield int(bucket[low]), self.ids[owners], counts, keys[low:high]

    def removed(self, answers: dict[int, np.ndarray], size: int) -> np.ndarray:
        """Which words go, by the buckets' bits."""
        bits = np.zeros(len(self.keys), bool)
        bucket = self.bucket[self.sent]
        for b, packed in answers.items():
            low, high = np.searchsorted(bucket, [b, b + 1])
            bits[self.sent[low:high]] = np.unpackbits(packed, count=high - low).astype(bool)
        gone = self.start[bits[self.which] | (self.owner > self.least[self.which])]
        change = np.bincount(gone, minlength=len(self.codes) + 1) - np.bincount(gone + size, minlength=len(self.codes) + 1)
        return np.cumsum(change)[: len(self.codes)] > 0


def _row(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of a batch's row."""
    part = lambda c: c.values.slice(c.offsets[i].as_py(), c.offsets[i + 1].as_py() - c.offsets[i].as_py())
    return part(batch.column("ids")).to_numpy(zero_copy_only=False), part(batch.column("texts"))


def gather(docs: DataFrame, rule: WindowRule, tasks: int) -> DataFrame:
    """(batch, ids, texts): the documents in batches, written, bucketed by batch for ``tasks`` tasks. A null id becomes the least long."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, TaskContext.get().partitionId() << 32

        def packed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column(c).chunk(0)) for c in ("doc_id", "text")]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *lists], names=["batch", "ids", "texts"])

        for batch in slices(batches, rule.batch_bytes // 4):
            if held and size + batch.nbytes > rule.batch_bytes:
                yield packed()
                held, size, n = [], 0, n + 1
            held.append(batch)
            size += batch.nbytes
        if size:
            yield packed()

    chosen = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LEAST))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    name = f"substring_dedup_{uuid.uuid4().hex}"
    rows = chosen.mapInArrow(run, "batch long, ids array<long>, texts array<string>")
    # A row holds megabytes, so the writer must look at its size after each.
    checks = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "compression": "zstd"}
    rows.write.format("parquet").bucketBy(tasks, "batch").options(**checks).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def answers(batches: DataFrame, rule: WindowRule, buckets: int, tasks: int) -> DataFrame:
    """(batch, bits): for each batch with any such key the buckets and their packed bits, "a smaller id than this batch's owner has it"."""

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, b in enumerate(part.column("batch").to_pylist()):
                rows = [(k, b, ids.tobytes(), counts.astype(np.int32).tobytes(), keys.tobytes()) for k, ids, counts, keys in Windows(*_row(part, i), rule.words, buckets).messages()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "batch", "ids", "counts", "keys"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
        owner = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.int32)) for i, n in zip(rows["ids"], rows["counts"], strict=True)])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        owner = owner[order]
        later = np.empty(len(keys), bool)
        later[order] = owner > np.repeat(np.minimum.reduceat(owner, new), np.diff(np.append(new, len(keys))))
        bits = [np.packbits(x) for x in np.split(later, np.cumsum([len(x) // 8 for x in rows["keys"]])[:-1])]
        return pd.DataFrame({"bucket": rows["bucket"], "batch": rows["batch"], "bits": [x.tobytes() if x.any() else None for x in bits]}).dropna()

    sent = batches.mapInArrow(send, "bucket int, batch long, ids binary, counts binary, keys binary")
    counted = sent.groupBy("bucket").applyInPandas(count, "bucket int, batch long, bits binary")
    # dealt out as the batches' table is, so that texts need no shuffle
    return counted.repartition(tasks, "batch").groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))


def without_repeats(docs: DataFrame, rule: WindowRule = WindowRule()) -> DataFrame:
    """(doc_id, n_words, removed, kept): per row of ``docs`` (doc_id, text) the word intervals [start, stop) that go, and the words that stay, joined by one space."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, bits in enumerate(part.column("bits").to_pylist()):
                ids, texts = _row(part, i)
                w = Windows(ids, texts, rule.words, buckets)
                gone = w.removed({x["bucket"]: np.frombuffer(x["bits"], np.uint8) for x in bits or ()}, rule.words)
                row, stop = np.repeat(np.arange(len(ids)), w.counts), np.cumsum(w.counts)
                begins = gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])[: len(gone)]
                ends = gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]])[: len(gone)]
                first, last = np.flatnonzero(begins), np.flatnonzero(ends)
                base = (stop - w.counts)[row[first]]
                runs = pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last + 1 - base, pa.int64())], names=["start", "stop"])
                offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets(np.bincount(row[first], minlength=len(ids))), runs)
                words = pa.ListArray.from_arrays(offsets(np.bincount(row[~gone], minlength=len(ids))), w.dictionary.take(pa.array(w.codes[~gone])))
                known = pa.array(ids, pa.int64(), mask=ids == LEAST)
                yield pa.RecordBatch.from_arrays([known, pa.array(w.counts, pa.int64()), lists, pc.binary_join(words, " ")], names=["doc_id", "n_words", "removed", "kept"])

    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    # a word takes six bytes or so; only sizes hang on it
    tasks, buckets = max(1, -(-total // rule.task_bytes)), max(1, -(-total // (6 * rule.bucket_windows)))
    batches = gather(docs, rule, tasks)
    told = batches.join(answers(batches, rule, buckets, tasks).hint("shuffle_hash"), "batch", "left")
    return told.select("ids", "texts", "bits").mapInArrow(cut, "doc_id long, n_words long, removed array<struct<start: long, stop: long>>, kept string")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) t(s)
), g AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS low FROM x) WHERE doc_id > low
), p AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS k FROM g
), q AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d
), r AS (
  SELECT doc_id, string_agg(w[q.k], ' ' ORDER BY q.k) AS kept, count(*) AS n FROM q ANTI JOIN p USING (doc_id, k) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
