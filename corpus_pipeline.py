"""From raw documents to training sequences: five stages, each written as Parquet and read by the next.

Each stage works on all rows its predecessor kept and returns the columns of ``documents``, but
for the last, which returns the packed pieces. Null texts pass as empty ones until they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import Workspace, table
from foliomill.llm.decontamination import without_leaks
from foliomill.llm.line_dedup import dedup_lines
from foliomill.llm.near_dup import one_of_each
from foliomill.llm.packing import default_tokenizer, pack
from foliomill.llm.toxicity import fit, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half stay; the score learns from labelled rows of training folds."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).where("score < 0.5").select(docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; a passage found before is taken out of their texts."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, sources mixed by their shares."""
    return pack(docs, default_tokenizer(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_tokens),
]

#: Toxicity's learned score and the packing cannot be stated in SQL; a test holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
