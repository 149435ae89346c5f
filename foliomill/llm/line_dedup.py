"""Line dedup: the first place of a repeated passage of ``min_words`` words or more stays, all others go.

Chunks are content-defined. From each line with words runs the shortest run of whole lines with ``chunk_words`` words, and a rolling hash over its line hashes. In every stretch of
``span_words`` words the chunk with the least hash is chosen, by nothing but the lines in it, so equal passages have chunks at equal places, wherever they stand: as
``span_words + chunk_words <= min_words + 1``, the first stretch of a passage of ``min_words`` words has its chosen chunk, whole, inside the passage.

Chunks that occur more than once in all documents are grown: each to the windows of whole lines, as short as ``min_words`` words allow, that begin in its stretch, forward
from each line and backward to each. Only a passage's own lines decide where windows lie, and together they cover it, so a repeated passage goes whole. Windows are equal if
the SHA-256 of their very bytes is. Of equal windows the one with the smallest (doc_id, text hash, place) stays; the others' lines are taken out. Where a
window overlaps its own first place (lines that repeat at once), the lines of that place stay.
A line is so taken out only if an equal line stays at an earlier place.

Edge cases: null text stays null and has no chunks; lines are split at \\n only; lines without
words are part of a window only between its lines, so some may be left around what was taken out;
shorter repeats (a heading, a license line) stay everywhere; one line of ``min_words`` words is a passage; a text all of
whose lines go becomes empty; rows with the same doc_id and text count as one and are treated
alike; a null doc_id sorts first; tables without rows or with more columns are fine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import Workspace, small_side, table


#: Rows of ids and window places that may be broadcast, some 30 MB; more are shuffled.
SMALL = 300_000


@dataclass(frozen=True)
class ChunkRule:
    min_words: int = 50
    #: Words of a chunk, and of the stretch in which one is chosen: together at most one more than ``min_words``.
    chunk_words: int = 20
    span_words: int = 31


#: The rolling hash: sum of line hashes times powers of a base, modulo a prime that leaves room for products in 64 bits.
PRIME, BASE = (1 << 31) - 1, 1_000_003
NONE = (1 << 63) - 1


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def reaches(counts: Column, least: int) -> Column:
    """For each of ``counts`` (positive) the index at which the sum from it on reaches ``least``; the array's size or more if none does.

    Sums of 1, 2, 4 ... counts, then a descent through them: log2(least) steps a line.
    """
    steps = [1 << k for k in range(least.bit_length())]

    def further(s: Column, step: int) -> Callable[[Column], Column]:
        more = lambda a: a["n"] + F.coalesce(F.get(s, a["at"]), F.lit(0))
        return lambda a: F.when(more(a) < least, F.struct(more(a).alias("n"), (a["at"] + step).alias("at"))).otherwise(a)

    def descend(sums: list[Column]) -> Column:
        at = F.transform(counts, lambda x, i: F.struct(F.lit(0).alias("n"), i.alias("at")))
        for step, s in reversed(list(zip(steps, sums, strict=True))):
            at = F.transform(at, further(s, step))
        return F.transform(at, lambda a: a["at"])

    def build(sums: list[Column]) -> Column:
        if len(sums) == len(steps):
            return descend(sums)
        s, step = sums[-1], steps[len(sums) - 1]
        return let(F.transform(s, lambda x, i: x + F.coalesce(F.get(s, i + step), F.lit(0))), lambda t: build([*sums, t]))

    return build([counts])


def held_lines(lines: Column) -> Column:
    """The lines with words, as (i: place, n: words, h: hash)."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), n_words(x).alias("n"), F.xxhash64(x).alias("h"))), lambda x: x["n"] > 0)


def with_chosen(df: DataFrame, rule: ChunkRule) -> DataFrame:
    """``df`` with ``chosen`` for its ``held`` lines: for each line the chunk chosen in the stretch that begins with it, rolling hash * 2^32 + the chunk's first line; null if either
    is not whole. ``ends`` tells for each line where the chunk that begins with it ends.

    Words and hashes of 1, 2, 4 ... lines, each from two of half the length, then a descent through them to the chunk's words; then minima of 1, 2, 4 ... chunks. Each step is a
    column of its own.
    """
    sizes = [1 << k for k in range((rule.chunk_words - 1).bit_length())]
    power = {s: pow(BASE, s, PRIME) for s in [1, *sizes]}
    or_0 = lambda x: F.coalesce(x, F.lit(0))
    df = df.withColumn("_t1", F.transform("held", lambda x: F.struct(x["n"].alias("n"), F.pmod(x["h"], F.lit(PRIME)).alias("r"))))
    for s in sizes[:-1]:
        df = df.withColumn(f"_t{2 * s}", _joined(F.col(f"_t{s}"), s, power[s]))
    df = df.withColumn("_at", F.transform("held", lambda x, i: F.struct(F.lit(0).alias("n"), i.alias("at"), F.lit(0).cast("long").alias("r"))))
    for s in reversed(sizes):
        df = df.withColumn("_at", F.transform("_at", _further(F.col(f"_t{s}"), s, power[s], rule.chunk_words)))
    last = lambda a: or_0(F.get("_t1", a["at"])["r"])
    whole = F.transform("_at", lambda a, i: F.when(a["at"] < F.size("held"), (a["r"] * power[1] + last(a)) % PRIME * (1 << 32) + i).otherwise(NONE))
    df = df.withColumn("_m1", whole).withColumn("ends", F.transform("_at", lambda a: a["at"]))
    df = df.withColumn("_span", reaches(F.transform("held", lambda x: x["n"]), rule.span_words))
    spans = [1 << k for k in range(rule.span_words.bit_length())]
    for s in spans[:-1]:
        df = df.withColumn(f"_m{2 * s}", _lesser(F.col(f"_m{s}"), s))

    def of(end: Column, i: Column) -> Column:
        out = F.when(end >= F.size("held"), None)
        for s in spans:
            out = out.when(end - i + 1 < 2 * s, F.least(F.get(f"_m{s}", i), F.get(f"_m{s}", end - s + 1)))
        return out

    df = df.withColumn("_least", F.transform("_span", of)).withColumn("chosen", F.transform("_least", lambda c: F.when(c < NONE, c)))
    return df.drop("_at", "_span", "_least", *[f"_t{s}" for s in sizes], *[f"_m{s}" for s in spans])


def _joined(t: Column, s: int, power: int) -> Column:
    """Words and hashes of twice as many lines."""
    other = lambda i, c: F.coalesce(F.get(t, i + s)[c], F.lit(0))
    return F.transform(t, lambda x, i: F.struct((x["n"] + other(i, "n")).alias("n"), ((x["r"] * power + other(i, "r")) % PRIME).alias("r")))


def _further(t: Column, s: int, power: int, least: int) -> Callable[[Column], Column]:
    """On by ``s`` lines, unless these reach ``least`` words."""

    def move(a: Column) -> Column:
        x = lambda c: F.coalesce(F.get(t, a["at"])[c], F.lit(0))
        return F.when(a["n"] + x("n") < least, F.struct((a["n"] + x("n")).alias("n"), (a["at"] + s).alias("at"), ((a["r"] * power + x("r")) % PRIME).alias("r"))).otherwise(a)

    return move


def _lesser(m: Column, s: int) -> Column:
    """Minima over twice as many values."""
    return F.transform(m, lambda x, i: F.least(x, F.get(m, i + s)))


def first_of(chunk: Column) -> Column:
    return chunk.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def chunks(texts: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """The chosen chunks of each row's ``lines``: its other columns, with ``first`` (the chunk's place among lines with words) and ``key`` (a hash of its lines)."""
    others = [c for c in texts.columns if c != "lines"]
    df = with_chosen(texts.withColumn("held", held_lines(F.col("lines"))), rule)
    df = df.withColumn("_own", F.array_distinct(F.filter("chosen", lambda c: c.isNotNull()))).withColumn("_h", F.transform("held", lambda x: x["h"]))
    key = lambda a: F.xxhash64(F.slice("_h", a + 1, F.get("ends", a) - a + 1))
    return df.select(*others, F.explode(F.transform("_own", lambda c: F.struct(first_of(c).alias("first"), key(first_of(c)).alias("key")))).alias("_c")).select(*others, "_c.first", "_c.key")


#: Lines whose marks one number holds.
MARKS = 32


def windows(texts: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """The distinct windows of each row's ``lines`` in the stretches of repeated chunks, ``first`` and ``last`` line. ``marks`` has the bits of these chunks' first lines, ``MARKS`` a number."""
    bit = lambda d: F.get("marks", (d / MARKS).cast("int")).bitwiseAND(F.element_at(F.lit([1 << k for k in range(MARKS)]), d % MARKS + 1)) != 0
    df = with_chosen(texts.withColumn("held", held_lines(F.col("lines"))), rule)
    df = df.withColumn("_on", F.transform("chosen", lambda c: F.coalesce(bit(first_of(c)), F.lit(False)))).withColumn("_n", F.transform("held", lambda x: x["n"]))
    df = df.withColumn("_forward", reaches(F.col("_n"), rule.min_words)).withColumn("_backward", reaches(F.reverse("_n"), rule.min_words))
    n, pair = F.size("held"), lambda a, b: F.get("held", a)["i"].cast("long") * (1 << 32) + F.get("held", b)["i"]
    both = F.concat(
        F.transform("_forward", lambda e, i: F.when((e < n) & F.get("_on", i), pair(i, e))),
        F.transform("_backward", lambda e, i: F.when((e < n) & F.get("_on", n - 1 - e), pair(n - 1 - e, n - 1 - i))),
    )
    found = df.withColumn("_both", both).select(*[c for c in texts.columns if c != "marks"], F.explode(F.array_distinct(F.filter("_both", lambda x: x.isNotNull()))).alias("_w"))
    return found.withColumn("first", F.shiftright("_w", 32).cast("int")).withColumn("last", first_of(F.col("_w"))).drop("_w")


def repeated_chunks(docs: DataFrame, rule: ChunkRule, work: Workspace) -> DataFrame:
    """(doc_id, _text, marks): for documents with chunks that occur again, anywhere, the bits of these chunks' first lines."""
    rows = work.write(chunks(docs.select("doc_id", F.xxhash64("text").alias("_text"), F.split("text", "\n", -1).alias("lines")), rule), "chunks")
    again = work.write(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    hit = rows.join(small_side(again, SMALL), "key", "left_semi")
    bits = hit.groupBy("doc_id", "_text", F.floor(F.col("first") / MARKS).cast("int").alias("block")).agg(F.bit_or(F.element_at(F.lit([1 << k for k in range(MARKS)]), F.col("first") % MARKS + 1)).alias("bits"))
    listed = bits.groupBy("doc_id", "_text").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("_bits"))
    return work.write(listed.select("doc_id", "_text", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_bits"))), lambda b: F.coalesce(F.try_element_at("_bits", b), F.lit(0))).alias("marks")), "marks")


def removals(docs: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """(doc_id, _text, gone): for each document with repeats, by id and hash of its text, the windows (first, low, last) of which the lines from low on go."""
    work = Workspace(docs.sparkSession, "line-dedup")
    marks = repeated_chunks(docs, rule, work).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "marks")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    cut = docs.select("doc_id", "text").join(small_side(marks, SMALL), same).select("doc_id", F.col("_hash").alias("_text"), F.split("text", "\n", -1).alias("lines"), "marks")
    body = F.array_join(F.slice("lines", F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n")
    # The digest tells bytes apart; its hash only finds what may be repeated.
    found = windows(cut, rule).select("doc_id", "_text", "first", "last", F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = work.write(found.withColumn("key", F.xxhash64("digest")), "windows")
    again = work.write(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    rows = work.write(rows.join(small_side(again, SMALL), "key", "left_semi").drop("key"), "equal")
    work.free("chunks", "repeated", "windows")
    place = F.struct("doc_id", "_text", "first")
    kept = work.write(rows.groupBy("digest").agg(F.min(place).alias("kept")), "kept")
    others = rows.join(small_side(kept, SMALL), "digest").where(~place.eqNullSafe(F.col("kept")))
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("_text") == F.col("kept._text"))
    low = F.when(same, F.greatest("first", F.col("kept.first") + F.col("last") - F.col("first") + 1)).otherwise(F.col("first"))
    others = others.select("doc_id", "_text", F.struct("first", low.alias("low"), "last").alias("w"))
    return work.write(others.groupBy("doc_id", "_text").agg(F.collect_set("w").alias("gone")), "gone")


def dedup_lines(docs: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines``, ``n_gone_windows``, ``n_gone_lines`` (of null text: null, 0, 0)."""
    # Where few documents lose lines, the others' texts stay where they are.
    out = F.array_distinct(F.flatten(F.transform("gone", lambda w: F.sequence(w["low"], w["last"]))))
    gone = removals(docs, rule).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), F.size("gone").alias("_n"), out.alias("_out"))
    # a row is kept apart from what is added to it, whatever its columns are called
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_hash"))
    joined = whole.join(small_side(gone, SMALL), same, "left").withColumn("_lines", F.split("row.text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_out"))
    text = F.when(F.col("_out").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_gone_windows"),
        F.coalesce(F.size("_out"), F.lit(0)).cast("long").alias("n_gone_lines"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_gone_windows", "n_gone_lines", F.length("text").cast("long").alias("kept_chars"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_crc32"))
