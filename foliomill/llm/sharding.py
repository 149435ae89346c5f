"""Minimax contiguous partition: the smallest shard capacity over ordered atomic groups, then cuts.

Rows of equal text are one atomic group and never part. Groups stand in the order of their text's
SHA-256, so a row knows its place without a join, and a shard is a range of digests. The smallest
capacity for which a greedy walk needs no more than ``shards`` shards is found by binary search.

Under that capacity the cuts themselves follow the mean: each shard closes at the known group end
nearest to what is left for it, groups larger than that aside, as long as the rest still fits. So
sizes are near equal, and all shards are used where there are groups enough.

The walk never sees the groups themselves: the driver holds at most ``max_cells`` digest ranges
with their total bytes. The search brackets the capacity from both sides (cells cut freely, cells
kept whole); only cells in which a cut can fall are counted finer, in another distributed pass,
until every such cell is one group. The result is exact and the driver's part bounded.

Edge cases: null text has size 16 and all null texts are one group; an empty table gives no rows;
repeated rows each get a slot; texts whose first 60 digest bits agree are one group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, table

BITS = 60
#: Rows of a shard, on average, that are numbered in one task; and the least number of such buckets a shard, so that a hot shard is no single task.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 16, 32
#: Rows of counts that may be broadcast, some 30 MB; more are shuffled.
SMALL = 1_000_000


def place(text: Column) -> Column:
    """The group's place in the order: 60 bits of the text's digest; -1 for null."""
    return F.when(text.isNull(), F.lit(-1).cast("long")).otherwise(F.conv(F.substring(F.sha2(text, 256), 1, BITS // 4), 16, 10).cast("long"))


@dataclass(frozen=True, order=True)
class Cell:
    """A digest range with rows: its first place, its bytes, whether it holds one group, and the bits below its key."""

    low: int
    bytes: int
    single: bool
    bits: int


def count_cells(rows: DataFrame, bits: int) -> list[Cell]:
    cell = F.shiftright("place", bits) if bits else F.col("place")
    found = rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.min("place").alias("low"), F.max("place").alias("high")).collect()
    return sorted(Cell(r["low"], r["bytes"], r["low"] == r["high"], bits) for r in found)


def walk(ends: list[int], capacity: int, shards: int, inside: list[bool] | None = None) -> list[int] | None:
    """Where, in bytes, a greedy walk closes its shards; None if it needs more than ``shards``.

    It closes at the last cell end within capacity, or, given ``inside``, anywhere within cells marked so.
    """
    total, at, closed = ends[-1], 0, []
    while at < total:
        if len(closed) == shards:
            return None
        reach = at + capacity
        i = bisect_right(ends, reach)  # the first cell that ends beyond reach
        if i == len(ends):
            to = total
        elif inside is not None and inside[i]:
            to = reach
        else:
            to = ends[i - 1] if i else 0
        if to <= at:
            return None
        closed.append(to)
        at = to
    return closed


def least(ends: list[int], shards: int, inside: list[bool] | None = None) -> int:
    """Binary search for the smallest capacity that the walk can do with."""
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if walk(ends, mid, shards, inside) is None:
            low = mid + 1
        else:
            high = mid
    return low


def level(sizes: np.ndarray, shards: int) -> float:
    """The mean of what ``shards`` shards get, where sizes above it have a shard of their own."""
    mean = sizes.sum() / shards
    while True:
        large = sizes > mean
        n = int(large.sum())
        new = (sizes.sum() - sizes[large].sum()) / (shards - n) if n < shards else mean
        if new >= mean:
            return mean
        mean = new


def balanced(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Where, in bytes, shards close that follow the mean; the walk must be able to do with ``capacity``. Only cell ends are used."""
    low = [ends[-1]]  # from where on, at the least, the last shards can hold the rest
    for _ in range(shards):
        i = bisect_left(ends, low[-1] - capacity)
        low.append(0 if low[-1] <= capacity else ends[i])
    sizes, at, closed = np.diff(ends, prepend=0), 0, []
    for left in range(shards, 1, -1):
        first = bisect_right(ends, at)  # the shard's first cell
        if first >= len(ends):
            break
        to = at + level(sizes[first:], left)
        i = bisect_left(ends, to)
        i = i - 1 if i >= len(ends) or (i > first and to - ends[i - 1] <= ends[i] - to) else i
        i = min(i, len(ends) - left)  # a cell at least for each later shard, if there are so many
        i = max(i, first, bisect_left(ends, low[left - 1]))
        i = min(i, bisect_right(ends, at + capacity) - 1)
        at = ends[i]
        closed.append(at)
    return closed if closed and closed[-1] == ends[-1] else [*closed, ends[-1]]


def minimax_cuts(rows: DataFrame, shards: int, max_cells: int = 1 << 16) -> tuple[int, list[int]]:
    """The smallest capacity over the groups of ``rows`` (``place``, ``size``), and the places at which shards 1, 2, ... begin.

    The driver holds at most about twice ``max_cells`` ranges. Sizes must be positive.
    """
    cells = count_cells(rows, max(0, BITS - (max_cells.bit_length() - 1)))
    while cells:
        ends = list(accumulate(c.bytes for c in cells))
        inside = [not c.single for c in cells]
        low, high = least(ends, shards, inside), least(ends, shards)
        # With a capacity in [low, high] the i-th shard closes between these two, step by step.
        wanted, first, last = set(), 0, 0
        for _ in range(shards):
            i = bisect_right(ends, first + low)
            first = ends[i - 1] if 0 < i <= len(ends) else (0 if i == 0 else ends[-1])
            last = min(last + high, ends[-1])
            stop = bisect_right(ends, last)
            wanted.update(k for k in range(max(0, bisect_right(ends, first)), min(stop + 1, len(ends))) if inside[k])
            if first >= ends[-1]:
                break
        if not wanted:
            closed = balanced(ends, high, shards)
            return high, [cells[bisect_right(ends, to)].low for to in closed[:-1]]
        step = max(1, (max_cells // len(wanted)).bit_length() - 1)
        finer = []
        for bits in sorted({cells[k].bits for k in wanted}):
            keys = rows.sparkSession.createDataFrame([(cells[k].low >> bits,) for k in sorted(wanted) if cells[k].bits == bits], "cell long")
            # At most max_cells keys of one long each: safe to broadcast.
            part = rows.withColumn("cell", F.shiftright("place", bits) if bits else F.col("place")).join(F.broadcast(keys), "cell", "left_semi")
            finer += count_cells(part, max(0, bits - step))
        cells = sorted([c for k, c in enumerate(cells) if k not in wanted] + finer)
    return 0, []


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, max_cells: int = 1 << 16) -> DataFrame:
    """Rows ``(id_col, size, text_crc32, shard, slot)``: every row of ``docs`` in one of ``shards`` shards of least possible maximum size."""
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    text = F.col(text_col)
    rows = work.write(
        docs.select(
            F.col(id_col),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            place(text).alias("place"),
        ),
        "rows",
    )
    _, cuts = minimax_cuts(rows, shards, max_cells)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("place") >= F.lit(cut)).cast("int")
    buckets = max(LEAST_BUCKETS, -(-rows.count() // (shards * BUCKET_ROWS)))
    out = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64(id_col, "place"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "bucket").orderBy(id_col, "place")
    return (
        out.withColumn("k", F.row_number().over(inside))
        .join(F.broadcast(firsts) if shards * buckets <= SMALL else firsts, ["shard", "bucket"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("k") - 1).cast("long").alias("slot"))
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
