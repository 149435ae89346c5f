"""Queries over spans of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spans as op
from ..sources import derive
from . import model_sql as m
from .registry import query


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are dealt out by document before they are cut up: lines, spans and ordinals then need no shuffle of pieces. The number is explicit, as texts are far smaller than what becomes of them.
    docs = derive.table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.build_spans(derive.pieces(docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")))


@query("span_inventory", f"""WITH {m.SPANS} SELECT doc_id, count(*)::BIGINT AS spans, sum(n_fragments)::BIGINT AS fragments, count(*) FILTER (n_fragments > 1)::BIGINT AS merged,
 count(DISTINCT font)::BIGINT AS fonts, count(DISTINCT page)::BIGINT AS pages FROM spans GROUP BY doc_id""")
def span_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.document_inventory(spans_of(spark, sf_dir))


@query("span_groups", f"""WITH {m.SPANS} SELECT doc_id, page::BIGINT AS page, line_no::BIGINT AS line_no, max(grp)::BIGINT AS groups, count(*)::BIGINT AS pieces FROM s2 GROUP BY ALL""")
def span_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = op.merge_pieces(derive.pieces(derive.table(spark, sf_dir, "documents")))
    return merged.groupBy("doc_id", F.col("page").cast("long").alias("page"), F.col("line_no").cast("long").alias("line_no")).agg(F.max("grp").alias("groups"), F.count("*").alias("pieces"))


@query("span_assembly", f"""WITH {m.SPANS} SELECT doc_id, page::BIGINT AS page, max(ordinal)::BIGINT AS last_ordinal, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
 sum(length(text))::BIGINT AS letters FROM spans GROUP BY ALL""")
def span_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lambda s: F.col(f"bbox.{s}")
    return spans_of(spark, sf_dir).groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(
        F.max("ordinal").alias("last_ordinal"), F.min(b("x0")).alias("x0"), F.min(b("y0")).alias("y0"), F.max(b("x1")).alias("x1"), F.max(b("y1")).alias("y1"), F.sum(F.length("text")).alias("letters")
    )


@query("span_ids", f"""WITH {m.SPANS} SELECT doc_id, ordinal::BIGINT AS ordinal,
 substr(sha256(concat_ws(':', page::VARCHAR, round(x0 * 10)::BIGINT::VARCHAR, round_even(y0 * 10, 0)::BIGINT::VARCHAR, font, text, ordinal::VARCHAR)), 1, 12) AS span_id FROM spans""")
def span_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(spark, sf_dir).select("doc_id", "ordinal", "span_id")


@query("font_facts", f"""WITH {m.SPANS} SELECT doc_id, font_object::BIGINT AS font_object, font, min(ordinal)::BIGINT AS first_ordinal, min_by(text, ordinal) AS first_text, min_by(size, ordinal) AS size, count(*)::BIGINT AS spans
 FROM spans GROUP BY doc_id, font_object, font""")
def font_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.font_facts(spans_of(spark, sf_dir)).withColumn("font_object", F.col("font_object").cast("long"))
