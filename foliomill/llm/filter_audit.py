"""Filter interaction audit: what each of five document filters removes, in each of their 120 orders.

The filters A to D look at one text. E, "identical to a text with a smaller doc_id", looks at all:
texts are dealt out in ranges of their beginnings, which are as long as needed to hold no more than ``capacity`` bytes
of text, and each task puts whole texts into a compressed radix trie whose terminals hold the least id. A walk
over the terminals tells who is a duplicate. Equal texts met where texts are read are settled there and not sent on, but for the least id.
Each document then is a mask of five bits, and counts by mask answer for all orders.

Edge cases: null text and null source count as empty; a null doc_id is the smallest, as is the least long; rows of
one id and text are no duplicates of each other; several label rows of a document count as their
maximum; documents without labels lose nothing good or toxic; a table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small_side, table
from .wordcodes import slices, word_codes

#: The filters; the letter at place k is bit k of a mask.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class TrieRule:
    #: Bytes of text that may share a beginning, unless it is one text.
    capacity: int = 4 << 20
    #: Bytes of text that a task is given, on average.
    task_bytes: int = 32 << 20
    #: Characters of the shortest beginnings; longer ones are twice as long each time.
    first: int = 8
    #: Heavy beginnings (8 bytes each) that may be broadcast; more are joined by a shuffle.
    most_heavy: int = 1_000_000


def flagged(texts: pa.Array) -> np.ndarray:
    """The bits A to D of each text."""
    codes, _, words = word_codes(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), words)
    distinct = np.bincount(np.unique(row * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1), minlength=len(texts)) if len(codes) else np.zeros(len(texts), np.int64)
    _, starts, data = texts.buffers()
    at = np.frombuffer(starts, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    among = lambda chars: np.concatenate([[0], np.cumsum(np.isin(np.arange(256), list(chars))[raw], dtype=np.int64)])[at - at[0]]
    capitals, symbols = np.diff(among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), np.diff(among(b"#$%&*|"))
    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return (words < 200) * 1 + (100 * distinct < 50 * words) * 2 + (100 * capitals > 2 * points) * 4 + (symbols > 0) * 8


def measure(docs: DataFrame, batch_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, source, mask, text): the text is null where E is settled already, since its batch holds it with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_bytes):
            texts = pc.fill_null(batch.column("text"), "").dictionary_encode()
            code = texts.indices.to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column("doc_id"), int(LEAST)).to_numpy(zero_copy_only=False)
            low = np.full(len(texts.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(low, code, ids)
            later = ids > low[code]
            mask = flagged(texts.dictionary)[code] | np.where(later, DUPLICATE, 0)
            sent = texts.dictionary.take(pa.array(code, mask=later))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.fill_null(batch.column("source"), ""), pa.array(mask.astype(np.int32)), sent], names=["doc_id", "source", "mask", "text"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return chosen.mapInArrow(run, "doc_id long, source string, mask int, text string")


def _beginning(length: int) -> Column:
    return F.substring("text", 1, length)


def by_beginning(texts: DataFrame, rule: TrieRule, work: Workspace) -> DataFrame:
    """``texts`` (a written table) in ranges of adaptive beginnings, and in that order; ``head`` and ``tail`` tell the beginning.

    A beginning is heavy if more than ``capacity`` bytes of different texts share it; there are at most total / capacity
    of a length. Only texts under heavy ones are looked at again with twice the length.
    """
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    length, left, deeper = rule.first, texts, F.lit(rule.first)
    marks = texts
    while True:
        by = left.groupBy(F.xxhash64(_beginning(length)).alias("h"))
        sums = by.agg(F.sum(F.octet_length("text")).alias("b"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
        heavy = work.write(sums.where((F.col("b") > rule.capacity) & (F.col("low") != F.col("high"))).select("h"), f"heavy-{length}")
        if heavy.isEmpty():
            break
        side = small_side(heavy.withColumnRenamed("h", f"h{length}"), rule.most_heavy)
        here = F.xxhash64(_beginning(length)) == F.col(f"h{length}")
        left = left.join(side, here, "left_semi")
        marks = marks.join(side, here, "left")
        deeper = F.when(F.col(f"h{length}").isNotNull(), F.lit(2 * length)).otherwise(deeper)
        length *= 2
    # the longest heavy beginning decides; all shorter ones are heavy as well
    own = F.substring(F.col("text"), F.lit(1), F.col("_length"))
    keyed = marks.withColumn("_length", deeper)
    keyed = keyed.select(*texts.columns, F.substring(own, 1, 64).alias("head"), F.when(F.col("_length") > 64, F.xxhash64(own)).otherwise(F.lit(0)).cast("long").alias("tail"))
    parts = max(1, -(-total // rule.task_bytes))
    return keyed.repartitionByRange(parts, "head", "tail").sortWithinPartitions("head", "tail")


class RadixTrie:
    """A compressed trie of byte strings. A node is [label, children by first byte, payloads of the strings that end here]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def insert(self, text: bytes, payload: object) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                at = len(text)
            elif text.startswith(child[0], at):
                at += len(child[0])
            else:
                k = self._shared(child[0], text, at)
                upper = [child[0][:k], {child[0][k]: child}, None]
                child[0] = child[0][k:]
                node[1][text[at]] = child = upper
                at += k
            node = child
        if node[2] is None:
            node[2] = []
        node[2].append(payload)

    @staticmethod
    def _shared(label: bytes, text: bytes, at: int) -> int:
        """Bytes that the label shares with the text from ``at`` on, by halving; they differ somewhere."""
        low, high = 0, len(label)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if text.startswith(label[low:mid], at + low) else (low, mid)
        return low

    def terminals(self) -> Iterator[list]:
        """The payloads of each distinct string."""
        stack = [self.root]
        while stack:
            _, children, payloads = stack.pop()
            stack.extend(children.values())
            if payloads is not None:
                yield payloads


def settle(ranged: DataFrame) -> DataFrame:
    """(doc_id, source, mask) of the texts of :func:`by_beginning`, with E. A task holds the trie of one beginning at a time."""

    def flags(trie: RadixTrie) -> pa.RecordBatch:
        rows = [(i, s, m | DUPLICATE if k > low else m) for own in trie.terminals() for low in [min(x[0] for x in own)] for k, i, s, m in own]
        ids, sources, masks = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(masks, pa.int32())], names=["doc_id", "source", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = RadixTrie(), None
        for batch in slices(batches, 8 << 20):
            columns = [batch.column(c).to_pylist() for c in ("head", "tail", "doc_id", "source", "mask")]
            for head, tail, i, source, mask, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if (head, tail) != now:
                    yield flags(trie)
                    trie, now = RadixTrie(), (head, tail)
                trie.insert(text, (LEAST if i is None else i, i, source, mask))
        yield flags(trie)

    return ranged.mapInArrow(run, "doc_id long, source string, mask int")


def document_masks(docs: DataFrame, rule: TrieRule = TrieRule()) -> DataFrame:
    """(doc_id, source, mask) for every row of ``docs`` (doc_id, source, text): the filters it fails, one bit each."""
    work = Workspace(docs.sparkSession, "filter-audit")
    rows = work.write(measure(docs), "rows")
    ranged = by_beginning(rows.where("text is not null"), rule, work)
    return settle(ranged).unionByName(rows.where("text is null").drop("text"))


def interactions(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``masks`` (doc_id, source, mask): a row for each source, order and step."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("bad"))
    zero = F.lit(0).cast("long")
    cells = masks.join(marks, "doc_id", "left").groupBy(F.coalesce("source", F.lit("")).alias("part"), "mask")
    cells = cells.agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), zero).alias("good"), F.coalesce(F.sum("bad"), zero).alias("bad"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))  # at most 32

    bit = {letter: 1 << k for k, letter in enumerate(FILTERS)}
    steps = [(order, k + 1, bit[letter], sum(bit[x] for x in order[:k])) for order in ORDERS for k, letter in enumerate(order)]
    of = lambda k: F.get(F.lit([s[k] for s in steps]), F.col("k"))
    rows = parts.select("part", "cells", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("k"))
    rows = rows.select("part", "cells", of(0).alias("filter_order"), of(1).alias("step"), of(2).alias("own"), of(3).alias("before"))

    def total(test, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", test), zero, lambda a, c: a + value(c))

    fails, gone = (lambda c: c["mask"].bitwiseAND(F.col("own")) != 0), (lambda c: c["mask"].bitwiseAND(F.col("before")) != 0)
    removed = lambda c: fails(c) & ~gone(c)
    # In 120 / (filters failed) of all orders a document falls to a given one of them.
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total(lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["bad"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (F.lit(len(ORDERS)) / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(document_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31
), s AS (
  SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, unnest(range(1, 6)) t(k)
), r AS (
  SELECT part, filter_order, step::INT AS step, own,
    coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
