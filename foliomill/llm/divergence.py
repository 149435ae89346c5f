"""Source divergence audit: how far the term counts of each (lang, source) lie from other sources of the language and from the language.

First reading: in how many documents of its language a term occurs, exactly; terms in at least ``least_docs`` are kept.
The kept terms are dealt to shards by hash, and each shard gets a minimal perfect hash, which stores its keys by slot. Second reading: shards are broadcast, as many at a
time as ``broadcast_bytes`` allows (beyond that the documents are read once more for the next ones); a term found is
compared with the stored key, and occurrences are added up in one dense array of slots for each (lang, source). What a task
has counted goes on as (lang, source, slot, count) rows, added up by Spark.
Pairs of sources are compared block of slots by block, each block a matrix of sources by terms.

All numbers are integers: shares are 1 + floor(10^9 * (count + 2) / (N + 2V)), divergence is the sum of floor((p - q)^2 / (p + q)).

Edge cases: null text, lang and source count as empty; a group without kept terms, and a language without any, have their rows
of part ``pair`` (value 0 if no term is kept); a lone source has no pairs; rows with the same doc_id are documents of their own; a
table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table
from .wordcodes import PLACES, hashes, mixed, slices, word_codes

U1 = np.uint64(1)
#: Bytes of letters, A-Z as a-z, and of all beyond ASCII; blanks for any others.
LETTERS = np.array([b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class AuditRule:
    least_docs: int = 10
    top: int = 10
    #: Kept terms in a shard, on average.
    shard_terms: int = 50_000
    #: Bytes of shards that are broadcast at a time; one shard is at least.
    broadcast_bytes: int = 128 << 20
    #: Bytes of dense counts that a task holds before it hands them on.
    dense_bytes: int = 64 << 20
    #: Bytes of documents whose terms are told apart together.
    batch_bytes: int = 8 << 20
    #: Slots of a block in which all pairs of sources of a language are compared.
    block: int = 2048


class PerfectHash:
    """A slot from 0 to n - 1 for each of n distinct strings: levels of bits of which each key has one alone; the slot is that bit's rank.

    A string that is no key may get a slot too, so the stored key is compared. Keys that no level parts (equal 64-bit hashes) are listed.
    """

    LEVELS = 48

    def __init__(self, sizes: list[int], words: np.ndarray, keys: pa.Array, rest: dict[str, int]):
        self.sizes, self.words, self.keys, self.rest = sizes, words, keys, rest
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(h + PLACES[3:4] * np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: pa.Array) -> PerfectHash:
        h, left = hashes(keys), np.arange(len(keys))
        sizes, flags, order = [], [], []
        while len(left) and len(sizes) < cls.LEVELS:
            size = -(-2 * len(left) // 64) * 64
            at = cls._place(h[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            single = alone[at]
            sizes.append(size)
            flags.append(alone)
            order.append(left[single][np.argsort(at[single])])
            left = left[~single]
        words = np.packbits(np.concatenate(flags) if flags else np.zeros(0, bool), bitorder="little").view(np.uint64)
        by_slot = keys.take(pa.array(np.concatenate([*order, left]).astype(np.int64)))
        placed = len(keys) - len(left)
        return cls(sizes, words, by_slot, {k: placed + i for i, k in enumerate(by_slot.slice(placed).to_pylist())})

    def slots(self, keys: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it is none; ``h`` are their hashes."""
        out, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._place(h[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & U1 == U1
            out[left[hit]] = (self.ranks[at >> 6] + np.bitwise_count(word & ((U1 << bit) - U1)))[hit]
            left, base = left[~hit], base + size
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), keys.take(pa.array(found))).to_numpy(zero_copy_only=False)
        out[found[~same]] = -1
        if self.rest:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.rest.get(keys[i].as_py(), -1)
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all terms of some texts, the distinct terms, and how many each text has."""
    _, starts, data = texts.buffers()
    at = np.frombuffer(starts, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = LETTERS[np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]]
    return word_codes(pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(raw)))


def keyed(langs: pa.Array, terms: pa.Array) -> pa.Array:
    """A language and a term as one string; terms have no character 0."""
    return pc.binary_join_element_wise(langs, terms, "\0")


def ranked(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (from 0 to ``top`` - 1), and each one's rank among them; by marks, unless ``top`` is far beyond their number."""
    if top > 8 * len(values) + (1 << 20):
        return np.unique(values, return_inverse=True)
    there = np.zeros(top + 1, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[values]


class Batch:
    """The terms of a batch by language: distinct (lang, term) pairs, and for every occurrence its pair and its row."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column("lang").dictionary_encode()
        lang = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes, words, counts = terms_of(batch.column("text"))
        self.row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), counts)
        used, self.pair = ranked(lang[self.row] * max(1, len(words)) + codes, len(self.langs.dictionary) * len(words))
        self.lang = self.langs.dictionary.take(pa.array(used // max(1, len(words))))
        self.term = words.take(pa.array(used % max(1, len(words))))


def filled(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, rule: AuditRule) -> DataFrame:
    """(lang, term) in at least ``least_docs`` documents of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rule.batch_bytes):
            b = Batch(batch)
            n = max(1, len(b.term))
            docs_of = np.bincount(np.unique(b.row.astype(np.int64) * n + b.pair) % n, minlength=len(b.term))
            yield pa.RecordBatch.from_arrays([b.lang, b.term, pa.array(docs_of, pa.int64())], names=["lang", "term", "n"])

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.least_docs).select("lang", "term")


def index(kept: DataFrame, rule: AuditRule) -> DataFrame:
    """(shard, sizes, words, keys, rest): a perfect hash a shard; ``keys`` in the order of slots."""
    shards = max(1, -(-kept.count() // rule.shard_terms))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keyed(batch.column("lang"), batch.column("term"))
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(hashes(keys), shards), pa.int32()), keys], names=["shard", "key"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        p = PerfectHash.of(pa.array(rows["key"].sort_values(), pa.string()))
        return pd.DataFrame({"shard": rows["shard"][:1].to_numpy(), "sizes": [p.sizes], "words": [p.words.tobytes()], "keys": [p.keys.to_pylist()], "rest": [len(p.rest)]})

    return kept.mapInArrow(deal, "shard int, key string").groupBy("shard").applyInPandas(build, "shard int, sizes array<long>, words binary, keys array<string>, rest int")


class Shards:
    """Some shards of all. Each language's keys in them are numbered on their own, for dense arrays."""

    def __init__(self, rows: list, starts: dict[int, int], count: int):
        self.count, self.own, self.at = count, {}, {}
        langs, numbers = [], []
        for r in rows:
            keys = pa.array(r["keys"], pa.string())
            placed = len(keys) - r["rest"]
            self.own[r["shard"]] = PerfectHash(r["sizes"], np.frombuffer(r["words"], np.uint64), keys, {k: placed + i for i, k in enumerate(r["keys"][placed:])})
            self.at[r["shard"]] = len(langs)
            langs += [k.rpartition("\0")[0] for k in r["keys"]]
            numbers.append(np.arange(len(keys)) + starts[r["shard"]])
        names, lang = np.unique(np.array(langs, object), return_inverse=True) if langs else ([], np.empty(0, np.int64))
        order = np.argsort(lang, kind="stable")
        self.dense, sizes = np.empty(len(langs), np.int64), np.bincount(lang, minlength=len(names))
        self.dense[order] = np.arange(len(langs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.concatenate([*numbers, np.empty(0, np.int64)])[order]
        #: For each language the common numbers of its slots, in dense order.
        self.numbers = dict(zip(names, np.split(whole, np.cumsum(sizes)[:-1]), strict=True)) if langs else {}

    def slots(self, keys: pa.Array) -> np.ndarray:
        """The dense slot of each key among its language's, -1 if it is none."""
        h = hashes(keys)
        shard, out = shard_of(h, self.count), np.full(len(h), -1, np.int64)
        for s in np.unique(shard).tolist():
            if s in self.own:
                mine = np.flatnonzero(shard == s)
                found = self.own[s].slots(keys.take(pa.array(mine)), h[mine])
                out[mine[found >= 0]] = self.dense[found[found >= 0] + self.at[s]]
        return out


def recount(docs: DataFrame, shards: object, rule: AuditRule) -> DataFrame:
    """(lang, source, slot, n): what tasks have counted of the broadcast shards' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dense = shards.value, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                at = np.flatnonzero(counts)
                if len(at):
                    same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(at), np.int64)))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(known.numbers[lang][at]), pa.array(counts[at])], names=["lang", "source", "slot", "n"])
            dense.clear()

        held = 0
        for batch in slices(batches, rule.batch_bytes):
            b = Batch(batch)
            slot = known.slots(keyed(b.lang, b.term))[b.pair]
            sources = batch.column("source").dictionary_encode()
            n = len(sources.dictionary)
            groups, group = np.unique(b.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + sources.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            kept = slot >= 0
            slot, of = slot[kept], group[b.row[kept]]
            order = np.argsort(of.astype(np.int16) if len(groups) < 1 << 15 else of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(groups) + 1))
            for k, g in enumerate(groups.tolist()):
                name = b.langs.dictionary[g // n].as_py(), sources.dictionary[g % n].as_py()
                if name not in dense and name[0] in known.numbers:
                    size = 8 * len(known.numbers[name[0]])
                    if held + size > rule.dense_bytes:
                        yield from flush()
                        held = 0
                    dense[name] = np.zeros(size // 8, np.int64)
                    held += size
                if ends[k + 1] > ends[k]:
                    np.add.at(dense[name], slot[order[ends[k] : ends[k + 1]]], 1)
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, slot long, n long")


def share(n: Column) -> Column:
    """p of a count, beside columns ``total`` and ``v``."""
    scaled = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", scaled, (F.col("total") + 2 * F.col("v")).cast("decimal(20,0)"))


def term_counts(docs: DataFrame, rule: AuditRule, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(lang, source, slot, n) with n > 0, and (lang, term, slot), of the kept terms; both written."""
    spark = docs.sparkSession
    made = work.write(index(work.write(kept_terms(docs, rule), "kept"), rule), "index")
    size = F.length("words") + F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + F.octet_length(k) + 16)
    sizes = made.select("shard", F.size("keys").alias("n"), size.alias("b")).orderBy("shard").collect()  # a row for each shard_terms terms
    starts, at = {}, 0
    for r in sizes:
        starts[r["shard"]], at = at, at + r["n"]
    count = max(1, -(-at // rule.shard_terms))
    passes, held = [[]], 0
    for r in sizes:
        if passes[-1] and held + r["b"] > rule.broadcast_bytes:
            passes.append([])
            held = 0
        passes[-1].append(r["shard"])
        held += r["b"]
    cells = None
    for shards in passes:
        rows = made.where(F.col("shard").isin(shards)).collect() if shards else []
        counted = recount(docs, spark.sparkContext.broadcast(Shards(rows, starts, count)), rule)
        cells = counted if cells is None else cells.unionByName(counted)
    cells = work.write(cells.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), "cells")
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else F.create_map().cast("map<int,int>")
    terms = made.select(F.element_at(start, F.col("shard")).cast("long").alias("start"), F.posexplode("keys").alias("k", "key"))
    cut = F.length("key") - F.length(F.substring_index("key", "\0", -1))
    return cells, work.write(terms.select(F.substring(F.col("key"), F.lit(1), cut - 1).alias("lang"), F.substring_index("key", "\0", -1).alias("term"), (F.col("start") + F.col("k")).alias("slot")), "terms")


def compare(cells: DataFrame, groups: DataFrame, rule: AuditRule) -> DataFrame:
    """(lang, source, item, slot, value), block of slots by block: with ``item`` the distance of two sources over the block's terms, with ``slot`` the distance of a source from its
    language at a term it has more of, of which a block tells the ``top`` largest of each source and all that equal the last.
    """
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    asked = groups.where("v > 0").select("lang", "source", share(F.lit(0)).alias("p0")).join(whole, "lang")
    placed = cells.join(groups, ["lang", "source"]).select("lang", F.expr(f"slot div {rule.block}").alias("block"), "source", "slot", "n", share(F.col("n")).alias("p"))
    asked = asked.join(placed.select("lang", F.col("block").alias("b")).distinct(), "lang").withColumnRenamed("b", "block")

    def block(own: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        sides = sides.sort_values("source").reset_index(drop=True)
        names, (slots, at) = sides["source"].to_numpy(), np.unique(own["slot"], return_inverse=True)
        side = pd.Index(names).get_indexer(own["source"])
        p = np.repeat(sides["p0"].to_numpy()[:, None], len(slots), axis=1)
        p[side, at] = own["p"]
        sums = [((p[i] - p[i + 1 :]) ** 2 // (p[i] + p[i + 1 :])).sum(axis=1) for i in range(len(p))]
        i, j = np.triu_indices(len(p), 1)
        value = np.concatenate([*sums, np.empty(0, np.int64)]).astype(np.int64)
        pairs = pd.DataFrame({"source": np.concatenate([names[i], names[j]]), "item": np.concatenate([names[j], names[i]]), "slot": -1, "value": np.concatenate([value, value])})

        n = np.zeros(len(slots), np.int64)
        np.add.at(n, at, own["n"].to_numpy())
        total, v = int(sides["total"][0]), int(sides["v"][0])
        q = np.array([1 + 10**9 * (int(x) + 2) // (total + 2 * v) for x in n], np.int64)[at]
        mine = own["p"].to_numpy()
        terms = pd.DataFrame({"source": own["source"], "item": None, "slot": own["slot"], "value": (mine - q) ** 2 // (mine + q)})[mine > q]
        if len(terms):
            terms = terms[terms.groupby("source")["value"].rank(method="min", ascending=False) <= rule.top]
        return pd.concat([x for x in (pairs, terms) if len(x)] or [pairs]).assign(lang=sides["lang"][0])

    return placed.groupBy("lang", "block").cogroup(asked.groupBy("lang", "block")).applyInPandas(block, "lang string, source string, item string, slot long, value long")


def divergence(docs: DataFrame, rule: AuditRule = AuditRule()) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source): part ``pair`` against each other source, part ``term`` the terms that most set the source apart from its language."""
    work = Workspace(docs.sparkSession, "divergence")
    docs = filled(docs)
    cells, terms = term_counts(docs, rule, work)
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = terms.groupBy("lang").agg(F.count("*").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(v, "lang", "left")
    groups = work.write(groups.select("lang", "source", zero("total"), zero("v")), "groups")

    told = work.write(compare(cells, groups, rule), "told")
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item")
    distances = told.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(distances, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", zero("value"))
    apart = told.where("item is null").join(terms, ["lang", "slot"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    numbered = lambda df: df.withColumn("rank", F.row_number().over(order))
    return numbered(pairs).unionByName(numbered(apart).where(F.col("rank") <= rule.top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), o AS (
  SELECT id, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 10
), n AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM c JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)
), a AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p))::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), b AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM b
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
