"""Spans out of positioned text pieces: merged, numbered, identified, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import DEFAULTS, Params

LINE = ["doc_id", "page", "line_no"]


def merge_pieces(pieces: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``pieces`` with ``grp``: on one line a piece goes on with the one before it if font, size, paint and baseline agree and the gap is small.

    Both ends of the gap's range count as inside. Null font objects agree with each other.
    """
    w = Window.partitionBy(*LINE).orderBy("piece_no")
    before = lambda c: F.lag(c).over(w)
    gap = F.col("bbox.x0") - before("bbox")["x1"]
    goes_on = (
        before("font").eqNullSafe(F.col("font"))
        & before("font_object").eqNullSafe(F.col("font_object"))
        & (F.abs(before("size") - F.col("size")) <= p.size_eps)
        & before("color").eqNullSafe(F.col("color"))
        & before("opacity").eqNullSafe(F.col("opacity"))
        & (F.abs(before("origin")["y"] - F.col("origin.y")) <= p.baseline_eps)
        & gap.between(p.kerning, F.col("size") * p.gap_ratio)
    )
    starts = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return pieces.withColumn("_starts", starts).withColumn("grp", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def assemble(merged: DataFrame) -> DataFrame:
    """A span per group: text joined, box the union of rounded fragment boxes, style of the first piece. Blank groups are no spans and take no ordinal.

    Rounding is decimal half-even at two places. ``turned``: written leftwards or not level.
    """
    side = lambda s: F.bround(F.col(f"bbox.{s}"), 2)
    fragment = F.struct("piece_no", "text", F.struct(*[side(s).alias(s) for s in ("x0", "y0", "x1", "y1")]).alias("bbox"), F.struct(F.bround("origin.x", 2).alias("x"), F.bround("origin.y", 2).alias("y")).alias("origin"))
    style = ("font", "font_object", "size", "color", "opacity", "dir")
    groups = merged.groupBy(*LINE, "grp").agg(
        F.array_sort(F.collect_list(fragment)).alias("parts"),
        F.struct(F.min(side("x0")).alias("x0"), F.min(side("y0")).alias("y0"), F.max(side("x1")).alias("x1"), F.max(side("y1")).alias("y1")).alias("bbox"),
        F.min_by(F.struct(*style), "piece_no").alias("style"),
    )
    spans = groups.select("*", *[f"style.{c}" for c in style]).withColumn("text", F.concat_ws("", F.transform("parts", lambda x: x["text"]))).where(F.length(F.regexp_replace("text", r"\s", "")) > 0)
    order = Window.partitionBy("doc_id").orderBy("page", "line_no", "grp")
    return spans.select(
        "doc_id",
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        "page",
        "line_no",
        "text",
        "font",
        "font_object",
        F.bround("size", 2).alias("size"),
        "color",
        "opacity",
        "bbox",
        F.col("parts")[0]["origin"].alias("origin"),
        "dir",
        ((F.col("dir.x") < 0) | (F.abs("dir.y") > 0.01)).alias("turned"),
        F.transform("parts", lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"), x["origin"].alias("origin"))).alias("fragments"),
    )


def with_span_id(spans: DataFrame) -> DataFrame:
    """Adds ``span_id``: the first 12 hex digits of a SHA-256 over page, box corner to one place, font, text and ordinal."""
    tenth = lambda c: F.bround(F.col(c) * 10).cast("long").cast("string")
    key = F.concat_ws(":", F.col("page").cast("string"), tenth("bbox.x0"), tenth("bbox.y0"), "font", "text", F.col("ordinal").cast("string"))
    return spans.withColumn("span_id", F.substring(F.sha2(key, 256), 1, 12))


def build_spans(pieces: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return with_span_id(assemble(merge_pieces(pieces, p)))


def document_inventory(spans: DataFrame) -> DataFrame:
    """Per document: spans, fragments, spans of several fragments, fonts, pages with text."""
    n = F.size("fragments")
    return spans.groupBy("doc_id").agg(
        F.count("*").alias("spans"),
        F.sum(n).alias("fragments"),
        F.count_if(n > 1).alias("merged"),
        F.count_distinct("font_object", "font").alias("fonts"),
        F.count_distinct("page").alias("pages"),
    )


def font_facts(spans: DataFrame) -> DataFrame:
    """Per document and font what its first span says, and how many spans use it."""
    return spans.groupBy("doc_id", "font_object", "font").agg(F.min("ordinal").alias("first_ordinal"), F.min_by("text", "ordinal").alias("first_text"), F.min_by("size", "ordinal").alias("size"), F.count("*").alias("spans"))
