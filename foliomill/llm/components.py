"""Connected components of a graph too large for one machine: large-star and small-star, alternately."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


#: Parts among which the pairs of one node may be spread.
SALTS = 1024


def _least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and its v.

    The centre of a star has a pair for each of its nodes. They meet its least node in parts, told by v: it is sent
    to those parts only that hold a pair of the centre, so it is never sent more often than there are pairs.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = pairs.groupBy("u", "salt").agg(F.min("v").alias("low"))
    low = parts.groupBy("u").agg(F.min("low").alias("_low"), F.collect_set("salt").alias("_salts"))
    low = low.select(F.col("u").alias("_u"), "_low", F.explode("_salts").alias("_salt"))
    met = pairs.join(low, (F.col("u") == F.col("_u")) & (F.col("salt") == F.col("_salt")))
    return met.select("u", "v", F.least("u", "_low").alias("m"))


def components(edges: DataFrame, work: Workspace, name: str, most: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), longs; the root is the least node of the component.

    Every step is written, so a lost executor repeats one step at most. Steps are about the
    logarithm of the longest path.
    """
    now = work.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    last = None
    for step in range(1, most):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.write(large, f"{name}-large-{step}")
        small = _least(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = work.write(small.select("e.*").where("a <> b").distinct(), f"{name}-{step}")
        sign = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        work.free(f"{name}-{step - 1}", f"{name}-large-{step}")
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
