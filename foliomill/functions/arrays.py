"""Running sums and placed matches in arrays, in about linear time and without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are added up by appending, which copies; such blocks then meet as sums.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _appended(sizes: Column) -> Column:
    """(sum, out): the sum of an array of ints, and the sum before each element."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))


def sums_before(sizes: Column) -> Column:
    """For each int of an array the sum of those before it. Null stays null.

    Appending to an array copies it, so sums are appended within blocks, and blocks' sums within an outer array: for n elements some
    n * BLOCK / 2 + (n / BLOCK)^2 / 2 copies of a number instead of n^2 / 2.
    """

    def joined(blocks: Column) -> Column:
        return let(_appended(F.transform(blocks, lambda b: b["sum"]))["out"], lambda starts: F.flatten(F.transform(blocks, lambda b, k: F.transform(b["out"], lambda x: x + F.get(starts, k)))))

    def of(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda k: _appended(F.slice(s, k * BLOCK + 1, F.lit(BLOCK))))
        return F.when(s.isNull(), None).when(F.size(s) <= BLOCK, _appended(s)["out"]).otherwise(let(blocks, joined))

    return let(sizes, of)


def matches_of(text: Column, pattern: str, needs: str | None = None) -> Column:
    """The matches of a pattern in a text, (s, e, m, left, right): start, end (exclusive, in code points), the match, and the text between it and the match before and after.

    Null and a text that does not pass ``needs`` (a pattern that every text with a match has; else the pattern itself) give null.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(gaps: Column, hits: Column, starts: Column) -> Column:
        at = lambda i: F.get(starts, i) + F.length(F.get(gaps, i))
        return F.transform(hits, lambda m, i: F.struct(at(i).alias("s"), (at(i) + F.length(m)).alias("e"), m.alias("m"), F.get(gaps, i).alias("left"), F.get(gaps, i + 1).alias("right")))

    def of(gaps: Column) -> Column:
        return let(hits, lambda h: let(sums_before(F.transform(h, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))), lambda starts: placed(gaps, h, starts)))

    return F.when(text.rlike(needs or pattern), let(gaps, of))


def with_context(matches: Column, size: int) -> Column:
    """Placed matches as (s, e, m, before, after): the text on either side, up to ``size`` characters; it reaches into the matches beside, not past them."""
    near = lambda a, x, i: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.right(F.concat(F.coalesce(F.get(a, i - 1)["m"], F.lit("")), x["left"]), F.lit(size)).alias("before"),
        F.left(F.concat(x["right"], F.coalesce(F.get(a, i + 1)["m"], F.lit(""))), F.lit(size)).alias("after"),
    )
    return let(matches, lambda a: F.transform(a, lambda x, i: near(a, x, i)))
