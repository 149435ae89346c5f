"""Queries over what is read and admitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..sources import derive, ingest
from ..workspace import Workspace
from . import model_sql as m
from .registry import query


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "documents")


@query("quarantined", "SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN trim(text) = '' THEN 'empty' ELSE 'broken characters' END AS note FROM documents WHERE text IS NULL OR trim(text) = '' OR contains(text, chr(65533))")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.scan_corpus(docs_of(spark, sf_dir))[1]


@query(
    "quarantined_files",
    """WITH n AS (SELECT doc_id % 40 AS file, count(*) AS rows FROM documents GROUP BY 1)
SELECT file::BIGINT AS file, CASE file % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'truncated' WHEN 3 THEN 'unreadable' END AS note, CASE WHEN file % 5 IN (0, 4) THEN rows ELSE 0 END::BIGINT AS rows FROM n""",
)
def quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' ids in 40 gzipped files of the shared folder, of which some are then emptied, cut within their head or overwritten, read again."""
    folder = f"{Workspace(spark, 'broken').root}/files"
    docs = docs_of(spark, sf_dir).select((F.col("doc_id") % 40).alias("file"), "doc_id", "lang")
    docs.repartition("file").write.partitionBy("file").option("compression", "gzip").json(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for number in range(40):
        place = path(f"{folder}/file={number}")
        for part in fs.listStatus(place) if number % 5 in (1, 2, 3) and fs.exists(place) else ():
            head = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0, 0xAB, 0x56])  # a packed file that breaks off after its head
            out = fs.create(part.getPath(), True)
            out.write(bytearray({1: b"", 2: head, 3: b"not packed " * 9}[number % 5]))
            out.close()
    good, bad = ingest.scan_files(spark, folder, "doc_id long, lang string")
    number = F.regexp_extract("file", "file=([0-9]+)", 1).cast("long")
    counts = good.groupBy(number.alias("file")).agg(F.count("*").alias("rows"))
    return bad.select(number.alias("file"), "note").join(counts, "file", "full_outer").select("file", "note", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


@query("distinct_documents", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.distinct_documents(docs_of(spark, sf_dir)).select("digest", "doc_id")


@query("due_documents", "SELECT doc_id FROM documents WHERE NOT (n_chars % 3 = 0 AND lang <> 'fr')")
def due_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    done = ingest.with_digest(docs).where("n_chars % 3 = 0").select("doc_id", "digest", F.when(F.col("lang") == "fr", "older build").otherwise(DEFAULTS.build_key()).alias("build_key"))
    return ingest.due_for_analysis(docs, done, DEFAULTS.build_key()).select("doc_id")


@query(
    "limits",
    f"""WITH {m.EDITS}, p AS (SELECT doc_id, count(*) AS n, max(length(text)) AS longest FROM edits GROUP BY doc_id) SELECT d.doc_id, CASE WHEN d.n_chars <= 60 THEN 'no_header' WHEN strlen(d.text) > 12000 THEN 'too_large'
WHEN d.n_chars // 3000 > 2 THEN 'too_many_pages' WHEN p.n > 9 THEN 'too_many_edits' WHEN p.longest > 5 THEN 'edit_too_long' END AS refusal FROM documents d LEFT JOIN p USING (doc_id)""",
)
def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    facts = docs.select("doc_id", F.octet_length("text").alias("bytes"), F.floor(F.col("n_chars") / 3000).alias("pages"), (F.col("n_chars") > 60).alias("header"))
    return ingest.check_limits(facts, derive.edits(derive.table(spark, sf_dir, "events"), docs.count()), 12_000, 2, 9, 5)


@query("illegal_characters", r"SELECT doc_id, strpos(text, chr(10)) - 1 AS place, 'U+000A' AS code FROM documents WHERE contains(text, chr(10))")
def illegal_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.illegal_characters(docs_of(spark, sf_dir)).select("doc_id", F.col("place").cast("long").alias("place"), "code")
