"""Mixture-controlled packing: deficit round-robin over source queues into windows of equal length.

Every source is a queue of token segments. Each round credits every queue with its share of one
window; a queue sends its next segments while its deficit covers them and carries the rest over.
A segment whose queue position ends at E tokens, with share s of a window of W tokens, therefore
leaves in round ceil(E / (s W)): the schedule has a closed form over running sums, so windows and
partitions carry deficits exactly without any worker seeing the queue before its own part. The
segments in order of (round, source, queue position) form one stream, cut every W tokens.

Shares default to the sources' shares of all tokens, so that all queues run dry together. Given
``shares`` set other targets, of all of which the sum is one window: while every such queue holds
tokens, at any cut a source is at most about one segment off its target. Once one has run dry the
others go on in their proportions; sources not named, or with a share of 0, follow when all named
ones are done, in proportion to what they hold.

Running sums go over buckets: per queue, then per block of rounds. Neither a hot source nor the
whole stream meets in one task; only sums per block do.

Edge cases: null text counts as empty and yields only the end id; a null source is a queue of its
own; repeated rows are packed once each; an empty table gives no rows; a document longer than a
window goes on in later windows; only the last window is shorter than W.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, table
from .wordcodes import slices, word_codes

MARK = "\x01"
#: Segments of a queue that are added up in one bucket.
BUCKET_SEGMENTS = 1 << 13
ROUNDS_A_BLOCK = 1024
NO_SOURCE = "\x00none"


# Fixed value: the pre-tokenizer's pattern under which a run of letters is encoded apart from marks after it.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = '.,;:!?")'
#: Small letters that no normalisation changes.
LETTERS = "a-zß-öø-ÿ"


class WordEncoder:
    """Token ids of white-space separated words, by a tokenizer that drops white space; about ``limit`` strings are remembered.

    Where the tokenizer cuts between letters and the marks after them, both are encoded apart: there are fewer of them than of words.
    Of these, runs of small letters skip the tokenizer's normalisation, which leaves them as they are.
    """

    def __init__(self, tokenizer: str, limit: int = 500_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_str(tokenizer), limit
        self._forget()
        self.folds = self._ids("A Zz") == self._ids("a zz")
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 and self._ids(f"a {MARK} b") == self._ids("a") + mark + self._ids("b") else None
        steps = (json.loads(tokenizer).get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.apart = len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == LETTER_RUNS and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.plain = Tokenizer.from_str(tokenizer)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lens = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, words: list[str], tokenizer: object) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        if self.mark is None or any(MARK in w for w in words):
            each = [self._ids(w) for w in words]
            return np.fromiter((i for x in each for i in x), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        joined = [f" {MARK} ".join(words[i : i + 256]) + f" {MARK}" for i in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]) if joined else np.empty(0, np.uint32)
        at = np.flatnonzero(ids == self.mark)
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def _learn(self, strings: pa.Array) -> None:
        """Remember the ids of distinct strings."""
        if len(self.known) > self.limit:
            self._forget()
        asked = strings.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in asked if w not in self.known]
        plain = pc.match_substring_regex(pa.array(new, pa.string()), f"^[{LETTERS}]+$").to_pylist() if self.apart else [False] * len(new)
        for held, tokenizer in ((True, self.plain), (False, self.tokenizer)):
            mine = [w for w, is_plain in zip(new, plain, strict=True) if is_plain == held]
            flat, lens = self._batch(mine, tokenizer)
            self.known.update(zip(mine, range(len(self.known), len(self.known) + len(mine)), strict=True))
            self.flat, self.lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
        index = np.fromiter(map(self.known.__getitem__, asked), np.int64, len(asked))
        self.place = (np.cumsum(self.lens) - self.lens)[index], self.lens[index]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: flat ids, and where each word's ids start and how many they are."""
        if not self.apart:
            self._learn(words)
            return self.flat, *self.place
        heads = pc.utf8_rtrim(words, MARKS)
        # a mark begins a token of its own only after a sign that stays a letter
        cut = pc.match_substring_regex(heads, f"[{LETTERS}]$")
        heads = pc.if_else(cut, heads, words)
        tails = pc.if_else(cut, pc.replace_substring_regex(words, f"^(?s:.)*[^{MARKS}]", ""), "")
        both = pa.concat_arrays([heads, tails]).dictionary_encode()
        self._learn(both.dictionary)
        at = both.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()
        starts, lens = (x[at] for x in self.place)
        own = lens[0::2] + lens[1::2]
        return self.flat[ranges(starts, lens)], np.cumsum(own) - own, own


class ShippedEncoder:
    """A tokenizer's text that travels to workers; its encoder is built there once and serves all tasks of a worker process."""

    def __init__(self, tokenizer: str):
        self.tokenizer, self.built = tokenizer, None

    def __getstate__(self) -> dict:
        return {"tokenizer": self.tokenizer, "built": None}

    def encoder(self) -> WordEncoder:
        self.built = self.built or WordEncoder(self.tokenizer)
        return self.built


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of start, start+1, ..., start+len-1."""
    total = int(lens.sum())
    out = np.ones(total, np.int64)
    full = lens > 0
    starts, lens = starts[full], lens[full]
    if total:
        begin = np.cumsum(lens) - lens
        out[begin] = starts
        out[begin[1:]] -= starts[:-1] + lens[:-1] - 1
        np.cumsum(out, out=out)
    return out


def encode_texts(texts: pa.Array, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of texts, and how many each has."""
    # Case is lost anyway; folding it first leaves fewer distinct words. Not where a special token could arise from it.
    if encoder.folds and not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    index, words, counts = word_codes(texts)
    flat, starts, lens = encoder.encode(words)
    ids = flat[ranges(starts[index], lens[index])]
    ends = np.concatenate([[0], np.cumsum(lens[index])])
    stops = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(ends[stops])


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, segment: int, spaced: bool, batch_bytes: int) -> DataFrame:
    """Segments (uid, doc_id, source, start, length, doc_tokens, ids) of at most ``segment`` ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(ShippedEncoder(tokenizer))  # a vocabulary file of fixed size
    schema = f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, start long, length int, doc_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = shipped.value.encoder()
        wide = encoder.tokenizer.get_vocab_size() > 65536 or end_id >= 65536
        kind = np.uint32 if wide else np.uint16
        uid = TaskContext.get().partitionId() << 36
        for batch in slices(batches, batch_bytes):
            texts = pc.fill_null(batch.column("text"), "")
            if spaced:
                ids, counts = encode_texts(texts, encoder)
            else:
                each = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
                ids, counts = np.fromiter((i for x in each for i in x), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
            ids = np.insert(ids.astype(kind), np.cumsum(counts), end_id)
            counts = counts + 1
            pieces = -(-counts // segment)
            row = np.repeat(np.arange(batch.num_rows), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * segment
            length = np.minimum(segment, counts[row] - start)
            offsets = np.concatenate([[0], np.cumsum(length)]) * ids.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid + row), batch.column("doc_id").take(take), batch.column("source").take(take), pa.array(start), pa.array(length.astype(np.int32)), pa.array(counts[row]), packed],
                names=["uid", "doc_id", "source", "start", "length", "doc_tokens", "ids"],
            )
            uid += batch.num_rows

    return docs.select("doc_id", "text", F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("source")).mapInArrow(run, schema)


def schedule(segments: DataFrame, window: int, shares: dict[str, float] | None = None) -> DataFrame:
    """(uid, start, at): where in the packed stream each segment begins. ``shares`` are positive or 0."""
    size = segments.agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).first()
    buckets = max(1, -(-size["n"] // BUCKET_SEGMENTS))
    meta = segments.select("uid", "start", "length", "source").withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    per_bucket = meta.groupBy("source", "bucket").agg(F.sum("length").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    queue = Window.partitionBy("source")
    firsts = per_bucket.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("held", F.sum("n").over(queue)).drop("n")
    share, late = F.col("held") / F.lit(float(size["tokens"] or 1)), F.lit(0)
    named = {k: float(v) / sum(shares.values()) for k, v in (shares or {}).items() if v > 0}
    if named:
        given = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.lit(v))])
        share, late = F.coalesce(F.try_element_at(given, F.col("source")), share), (~F.col("source").isin(list(named))).cast("int")
    inside = Window.partitionBy("source", "bucket").orderBy("uid", "start").rowsBetween(Window.unboundedPreceding, 0)
    queued = meta.withColumn("run", F.sum("length").over(inside)).join(firsts, ["source", "bucket"]).withColumn("end", F.col("first") + F.col("run"))
    timed = queued.withColumn("late", late).withColumn("round", F.ceil(F.col("end") / (share * window))).select(
        "uid", "start", "length", "source", "end", "late", "round", F.floor(F.col("round") / ROUNDS_A_BLOCK).alias("block")
    )
    # One row per block of rounds: the only sums that meet in one task.
    blocks = timed.groupBy("late", "block").agg(F.sum("length").alias("n"))
    blocks = blocks.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("late", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("late", "block").orderBy("round", "source", "end").rowsBetween(Window.unboundedPreceding, 0)
    return timed.withColumn("run", F.sum("length").over(within)).join(blocks, ["late", "block"]).select("uid", "start", (F.col("first") + F.col("run") - F.col("length")).alias("at"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    segment: int = 256,
    end_id: int = 2,
    shares: dict[str, float] | None = None,
    spaced: bool = True,
    with_ids: bool = True,
    batch_bytes: int = 6 << 20,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids as little-endian uint32).

    ``tokenizer`` is the text of a tokenizer file; ``spaced`` tells that it drops white space, so that words are encoded apart.
    """
    if segment > window:
        raise ValueError("a segment must fit a window")
    work = Workspace(docs.sparkSession, "packing")
    segments = work.write(tokenise(docs, tokenizer, end_id, segment, spaced, batch_bytes), "segments")
    placed = segments.join(schedule(segments, window, shares), ["uid", "start"]).select("doc_id", "start", "length", "doc_tokens", "at", "ids")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, length, start = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "length", "start"))
            offset = at % window
            left = np.minimum(length, window - offset)
            two = left < length
            row = np.repeat(np.arange(batch.num_rows), 1 + two)
            second = np.zeros(len(row), bool)
            second[1:] = row[1:] == row[:-1]
            skip = np.where(second, left[row], 0)
            size = np.where(second, (length - left)[row], left[row])
            crcs, pieces = np.empty(len(row), np.int64), []
            ids = batch.column("ids")
            for k, (r, s, n) in enumerate(zip(row.tolist(), skip.tolist(), size.tolist(), strict=True)):
                raw = ids[r].as_buffer()
                wide = np.frombuffer(raw, np.uint16 if raw.size == 2 * length[r] else np.uint32)[s : s + n].astype("<u4").tobytes()
                crcs[k] = zlib.crc32(wide)
                if with_ids:
                    pieces.append(wide)
            take = pa.array(row)
            columns = [batch.column("doc_id").take(take), pa.array(start[row] + skip), pa.array(size), pa.array(crcs), batch.column("doc_tokens").take(take), pa.array((at // window)[row] + second), pa.array(np.where(second, 0, offset[row]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(pieces, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(cut, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)
