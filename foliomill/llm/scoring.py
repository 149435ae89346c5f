"""LM scoring: an interpolated trigram model learned from the corpus, held in Elias-Fano tries, queried for every text.

p(w | u v) = a3 + b3 (a2 + b2 p1(w)): a3 and a2 are the smoothed shares of the trigram and bigram,
b3 and b2 the weights their contexts leave over (Dirichlet priors), p1 the add-0.1 share of the
word. Each distribution sums to one before shares are quantised to 8 bits, and a probability that
quantising lifts above one counts as one. A text is END w1 ... wn END; the first END is only context.

Nothing grows in one place. Texts become chunks of word codes, written once. Chunks send their
distinct words to buckets of the hash range, which add up counts and number the words; then their
distinct bigrams and trigrams to shards by first word (a word above ``hot`` tokens is spread over
shards by its bigrams), where the training counts of all chunks meet, a trie is built, memory-mapped,
and asked for each chunk's n-grams. Replies go back to the chunk. Messages are sorted,
differenced and compressed; their number of entries is that of distinct n-grams per chunk.

Words are told apart by 64-bit hashes; of training words at most 2^32 - 2 can be numbered, and more
are an error. Edge cases: null text counts as empty (one END); without
training texts every score is 0; repeated rows are scored each; a null doc_id is in the fold of
the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, crc_bucket, table
from .elias_fano import LEVELS, Trie
from .wordcodes import hashes, mixed, slices, word_codes

END = np.uint64(0x5BD1E9955BD1E995)
NONE = np.uint32(0xFFFFFFFF)
BUCKET_WORDS = 600_000
SHARD_TOKENS = 1_500_000
CHUNK_BYTES = 6 << 20


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array by planes, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return a.dtype.str.encode() + len(a).to_bytes(8, "little") + bytes(pa.compress(planes, codec="zstd", asbytes=True))


def expand(b: bytes) -> np.ndarray:
    kind, n = np.dtype(b[:3].decode()), int.from_bytes(b[3:11], "little")
    raw = pa.decompress(b[11:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().reshape(-1).view(kind) if n else np.empty(0, kind)


def steps(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def unsteps(b: bytes) -> np.ndarray:
    a = expand(b)
    return np.cumsum(a, dtype=a.dtype)


def chunked(docs: DataFrame) -> DataFrame:
    """Rows (chunk, doc_ids, lens, held, codes, order, vocab, counts, words, train_tokens) of ``docs`` (doc_id, text, held)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, doc_ids array<{kind}>, lens binary, held binary, codes binary, rank binary, vocab binary, counts binary, words long, train_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in slices(batches, CHUNK_BYTES):
            if not batch.num_rows:
                continue
            codes, words, counts = word_codes(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            h, at = np.unique(np.append(hashes(words), END), return_inverse=True)
            tokens = at[np.insert(codes, np.cumsum(counts), len(words))]
            lens = (counts + 1).astype(np.int32)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8)
            trained = np.bincount(tokens[np.repeat(held == 0, lens)], minlength=len(h)).astype(np.uint32)
            rank = np.argsort(-np.bincount(tokens, minlength=len(h)), kind="stable").astype(np.uint32)
            place = np.empty(len(h), np.uint32)
            place[rank] = np.arange(len(h), dtype=np.uint32)
            row = [[number], [batch.column("doc_id").to_pylist()], [squeeze(lens)], [squeeze(held)], [squeeze(place[tokens])], [squeeze(rank)], [steps(h)], [squeeze(trained)], [len(h)], [int(trained.sum())]]
            types = [pa.int64(), pa.list_(batch.column("doc_id").type), *[pa.binary()] * 6, pa.int64(), pa.int64()]
            names = ["chunk", "doc_ids", "lens", "held", "codes", "rank", "vocab", "counts", "words", "train_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)
            number += 1

    return docs.select("doc_id", "text", "held").mapInArrow(run, schema)


REPLY = "chunk long, kind int, part int, one binary, two binary, three binary, distinct long"
REPLY_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
REPLY_NAMES = ["chunk", "kind", "part", "one", "two", "three", "distinct"]


def replies(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(REPLY_NAMES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, REPLY_TYPES, strict=True)], names=REPLY_NAMES)


def number_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Replies of kind 0: ids and training counts of a chunk's words of one bucket; and one row a bucket with its distinct training words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocab, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "vocab", "counts")), strict=True):
                h, c = unsteps(vocab), expand(counts)
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                rows = [(chunk, b, steps(h[edges[b] : edges[b + 1]]), squeeze(c[edges[b] : edges[b + 1]])) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["chunk", "bucket", "h", "c"])

    def add_up(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        each = [(chunk, unsteps(h), expand(c)) for chunk, h, c in zip(*(group.column(x).to_pylist() for x in ("chunk", "h", "c")), strict=True)]
        h, at = np.unique(np.concatenate([x[1] for x in each]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[2] for x in each]), len(h)).astype(np.int64)
        known = int((total > 0).sum())
        if known * buckets + bucket >= 0xFFFFFFFF:
            raise OverflowError("more distinct words than 32-bit ids")
        ids = np.full(len(h), NONE, np.uint32)
        # frequent words get small ids, so that sorted n-grams lie close
        ids[np.argsort(-total, kind="stable")[:known]] = np.arange(known, dtype=np.uint32) * buckets + bucket
        out, begin = [(-1, 0, bucket, None, None, None, known)], 0
        for chunk, own, _ in each:
            mine = at[begin : begin + len(own)]
            begin += len(own)
            out.append((chunk, 0, bucket, squeeze(ids[mine]), squeeze(total[mine]), None, None))
        return replies(out)

    sent = chunks.select("chunk", "vocab", "counts").mapInArrow(split, "chunk long, bucket int, h binary, c binary")
    return sent.groupBy("bucket").applyInArrow(add_up, REPLY)


class Chunk:
    """A chunk whose words are numbered, and its n-grams by shard; built alike for asking and for scoring."""

    def __init__(self, row: dict, words: list[tuple[int, bytes, bytes]], shards: int, hot: int):
        words = sorted(words)
        ids = np.concatenate([expand(x[1]) for x in words])
        counts = np.concatenate([expand(x[2]) for x in words])
        rank = expand(row["rank"])
        codes = expand(row["codes"])
        self.lens, self.held, self.doc_ids = expand(row["lens"]).astype(np.int64), expand(row["held"]).astype(bool), row["doc_ids"]
        self.ids, self.counts = ids[rank][codes], counts[rank][codes]
        # END ends every document, so the last token's id is END's
        end_id, end_count = self.ids[-1], self.counts[-1]
        first = np.cumsum(self.lens) - self.lens
        before, self.before_counts = np.roll(self.ids, 1), np.roll(self.counts, 1)
        before[first], self.before_counts[first] = end_id, end_count
        known = (self.ids != NONE) & (before != NONE)
        train = np.repeat(~self.held, self.lens)
        self.at2 = np.full(len(self.ids), -1, np.int64)
        keys, index, at = np.unique((before[known].astype(np.uint64) << np.uint64(32)) | self.ids[known], return_index=True, return_inverse=True)
        self.at2[known] = at
        seen = np.flatnonzero(known)
        self.keys, self.count2 = keys, np.bincount(at, train[seen], len(keys)).astype(np.uint32)
        first_count = self.before_counts[seen[index]]
        spread = np.where(first_count > hot, mixed(keys), mixed(keys >> np.uint64(32)))
        self.shard = (spread % np.uint64(shards)).astype(np.int64)
        self.first_count = np.where(first_count > hot, first_count, 0)
        # the bigram before each token, known or not; the first token has none
        context = self.context = np.roll(self.at2, 1)
        context[first] = -1
        both = np.flatnonzero((context >= 0) & (self.ids != NONE))
        self.at3 = np.full(len(self.ids), -1, np.int64)
        keys3, at3 = np.unique((context[both].astype(np.uint64) << np.uint64(32)) | self.ids[both], return_inverse=True)
        self.at3[both] = at3
        self.context3, self.word3 = (keys3 >> np.uint64(32)).astype(np.int64), (keys3 & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.count3 = np.bincount(at3, train[both], len(keys3)).astype(np.uint32)

    def by_shard(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, its bigrams, its trigrams), each as indices in order."""
        two, three = np.argsort(self.shard, kind="stable"), np.argsort(self.shard[self.context3], kind="stable")
        shards = np.unique(self.shard)
        cut2 = [np.searchsorted(self.shard[two], shards, side) for side in ("left", "right")]
        cut3 = [np.searchsorted(self.shard[self.context3[three]], shards, side) for side in ("left", "right")]
        for k, s in enumerate(shards.tolist()):
            yield s, two[cut2[0][k] : cut2[1][k]], three[cut3[0][k] : cut3[1][k]]


ASK = "chunk long, shard int, keys binary, count2 binary, totals binary, context3 binary, word3 binary, count3 binary"


def ask(chunk: int, c: Chunk) -> list[tuple]:
    out = []
    for s, two, three in c.by_shard():
        place = np.searchsorted(two, c.context3[three]).astype(np.uint32)
        out.append((chunk, s, steps(c.keys[two]), squeeze(c.count2[two]), squeeze(c.first_count[two]), steps(place), squeeze(c.word3[three]), squeeze(c.count3[three])))
    return out


def answer(group: pa.Table, prior: float) -> pa.Table:
    """Build a shard's trie from all chunks' training counts, and look up every chunk's n-grams in it."""
    asked = []
    for chunk, keys, c2, totals, context3, word3, c3 in zip(*(group.column(x).to_pylist() for x in ("chunk", "keys", "count2", "totals", "context3", "word3", "count3")), strict=True):
        asked.append((chunk, unsteps(keys), expand(c2), expand(totals), unsteps(context3).astype(np.int64), expand(word3), expand(c3)))
    shard = group.column("shard")[0].as_py()
    pick = lambda k, c: np.concatenate([x[k][x[c] > 0] for x in asked])
    keys, at = np.unique(pick(1, 2), return_inverse=True)
    counts = np.bincount(at, pick(2, 2), len(keys)).astype(np.float64)
    given = np.zeros(len(keys))
    given[at] = pick(3, 2)
    _, own = np.unique(keys >> np.uint64(32), return_inverse=True)
    summed = np.bincount(own, counts)[own] if len(keys) else counts
    totals = np.where(given > 0, given, summed)
    contexts = np.concatenate([np.searchsorted(keys, x[1][x[4][x[6] > 0]]) for x in asked]).astype(np.uint64)
    tri, at3 = np.unique((contexts << np.uint64(32)) | pick(5, 6).astype(np.uint64), return_inverse=True)
    counts3 = np.bincount(at3, pick(6, 6), len(tri))
    raw = Trie.build(keys, counts, (tri >> np.uint64(32)).astype(np.int64), tri & np.uint64(0xFFFFFFFF), counts3, totals, prior).to_bytes()
    del contexts, tri, at3, at
    trie = Trie.mapped(raw)
    del raw
    out = []
    for chunk, own_keys, _, _, context3, word3, _ in asked:
        two = trie.bigram(own_keys >> np.uint64(32), own_keys & np.uint64(0xFFFFFFFF))
        three = trie.trigram(two[context3], word3)
        codes = [np.where(i >= 0, level[np.maximum(i, 0)] if len(level) else 0, 0).astype(np.uint8) for i, level in ((two, trie.two), (two, trie.keep), (three, trie.three))]
        out.append((chunk, 1, shard, *[squeeze(x) for x in codes], None))
    return replies(out)


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", prior: float = 4.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token) for every row; the model learns from rows where ``held_out`` is false."""
    spark = docs.sparkSession
    work = Workspace(spark, "scoring")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held"))
    chunks = work.write(chunked(rows), "chunks", "uncompressed")
    size = chunks.agg(F.sum("words").alias("words"), F.sum("train_tokens").alias("n"), F.count("*").alias("chunks")).first()
    words, total = size["words"] or 0, size["n"] or 0
    buckets, shards = max(1, -(-words // BUCKET_WORDS)), max(1, -(-total // SHARD_TOKENS))
    numbered = work.write(number_words(chunks, buckets), "numbered", "uncompressed")
    distinct = numbered.where("chunk < 0").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    stored = chunks.select("chunk", "doc_ids", "lens", "held", "codes", "rank")
    hot = max(1, SHARD_TOKENS // 8)

    def asking(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            out = ask(row["chunk"], Chunk(row, list(zip(*(right.column(c).to_pylist() for c in ("part", "one", "two")), strict=True)), shards, hot))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk", "shard", "keys", "count2", "totals", "context3", "word3", "count3"])

    words_of_chunk = numbered.where("chunk >= 0")
    asked = stored.groupBy("chunk").cogroup(words_of_chunk.groupBy("chunk")).applyInArrow(asking, ASK)
    answered = asked.groupBy("shard").applyInArrow(lambda g: answer(g, prior), REPLY)
    id_type = rows.schema["doc_id"].dataType
    result = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scoring(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kind = left.schema.field("doc_ids").type.value_type
        types = [kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        row = left.slice(0, 1).to_pylist()[0]
        back = list(zip(*(right.column(c).to_pylist() for c in ("kind", "part", "one", "two", "three")), strict=True))
        c = Chunk(row, [(p, a, b) for k, p, a, b, _ in back if k == 0], shards, hot)
        two, keep, three = np.zeros(len(c.keys), np.uint8), np.zeros(len(c.keys), np.uint8), np.zeros(len(c.word3), np.uint8)
        got = {p: (a, b, d) for k, p, a, b, d in back if k == 1}
        for s, i2, i3 in c.by_shard():
            two[i2], keep[i2], three[i3] = (expand(x) for x in got[s])
        p1 = (c.counts + 0.1) / (total + 0.1 * (distinct + 1))
        here, before = np.maximum(c.at2, 0), np.maximum(c.context, 0)
        share = lambda codes, at, i: LEVELS[np.where(at >= 0, codes[i], 0)] if len(codes) else np.zeros(len(at))
        p2 = share(two, c.at2, here) + prior / (c.before_counts + prior) * p1
        # a context leaves its weight to shorter ones whether or not the word is known
        left_over = share(keep, c.context, before)
        p3 = share(three, c.at3, np.maximum(c.at3, 0)) + np.where(left_over > 0, left_over, 1.0) * p2
        starts = np.cumsum(c.lens) - c.lens
        add = lambda x: np.add.reduceat(x, starts)
        columns = [c.doc_ids, c.held, c.lens, add((c.counts > 0).astype(np.int64)), np.full(len(starts), total), add(np.log10(p1)), add(np.log10(np.minimum(p3, 1.0)))]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=names)

    back = words_of_chunk.unionByName(answered)
    scored = stored.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scoring, result)
    # a total is mostly a text's length; per token, texts can be compared
    return scored.withColumn("score_per_token", F.col("score") / F.col("n_tokens"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, crc_bucket(F.col("doc_id"), 10) == 0)
