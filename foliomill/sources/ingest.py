"""Reading and admitting data sets: fixed schemas, quarantine, identity, limits, what is due again."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import SPAN
from ..workspace import Workspace


def write_spans(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Spans as Parquet, partitioned by a hash of the document, so that a document is found in one folder."""
    df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("doc_bucket").parquet(path)


def read_spans(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Spans of a Parquet or JSON data set; the schema is fixed, never inferred."""
    reader = spark.read.schema(SPAN)
    return reader.json(path) if kind == "json" else reader.parquet(path)


def scan_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines that fit the schema, and the others as (path, note). An unreadable line stops nothing."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("path"))
    rows = lines.withColumn("_r", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    good, bad = F.col("_r._corrupt").isNull(), F.col("_r._corrupt").isNotNull()
    return rows.where(good).select("_r.*").drop("_corrupt"), rows.where(bad).select("path", F.col("value").alias("note"))


def scan_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that can be read, and a quarantine (doc_id, note) of those without text or with replacement characters."""
    note = F.when(F.col("text").isNull(), "no text").when(F.trim("text") == "", "empty").when(F.contains("text", F.lit("�")), "broken characters")
    marked = docs.withColumn("note", note)
    return marked.where("note is null").drop("note"), marked.where("note is not null").select("doc_id", "note")


def scan_files(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Gzipped JSON lines of a folder that fit the schema, with their ``file``, and a quarantine (file, note) of files that hold none: empty, truncated, or nothing that can be read.

    A file is unpacked where it is read, and must fit into a task; line by line, so one that breaks off gives the rows before the break and a note. Nothing readable in any file is an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = reader.select(F.col("path").alias("file"), "content")
    # Spark reads no file without bytes; the listing that it keeps has them
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+(?=[^/])", "$1:/")
    listed = spark.createDataFrame([(unquote(f),) for f in reader.inputFiles()], "file string").select(plain("file").alias("file"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                lines, note = [], None
                try:
                    with gzip.open(io.BytesIO(content), "rt", encoding="utf-8", errors="strict") as text:
                        for line in text:
                            lines.append(line)
                except EOFError:
                    note = "truncated"
                except (OSError, zlib.error, UnicodeDecodeError):
                    note = "unreadable"
                rows = lines or [None]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(rows, pa.string()), pa.array([note] * len(rows), pa.string())], names=["file", "line", "note"])

    lines = Workspace(spark, "files").write(files.mapInArrow(unpack, "file string, line string, note string").withColumn("file", plain("file")), "lines")
    rows = lines.where("trim(line) <> ''").withColumn("_r", F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    good = rows.where("_r._corrupt is null").select("file", "_r.*").drop("_corrupt")
    if good.isEmpty():
        raise ValueError(f"nothing in {folder} can be read")
    bad = rows.groupBy("file").agg(F.count_if(F.col("_r._corrupt").isNull()).alias("_good"))
    told = lines.groupBy("file").agg(F.max("note").alias("note")).join(bad, "file", "left")
    note = F.coalesce("note", F.when(F.coalesce("_good", F.lit(0)) == 0, "no rows"))
    empty = listed.join(lines.select("file").distinct(), "file", "left_anti").withColumn("note", F.lit("empty"))
    return good, told.select("file", note.alias("note")).where("note is not null").unionByName(empty)


def with_digest(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds ``digest``, the SHA-256 of the content, which is a document's identity."""
    return df.withColumn("digest", F.sha2(F.coalesce(col, F.lit("")), 256))


def distinct_documents(df: DataFrame, order: str = "doc_id", col: str = "text") -> DataFrame:
    """The first arrival of each content, deterministically."""
    w = Window.partitionBy("digest").orderBy(order)
    return with_digest(df, col).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def due_for_analysis(docs: DataFrame, analyses: DataFrame, build_key: str) -> DataFrame:
    """Documents without an analysis of their digest under this build key: new ones, changed ones, and all after a change of any tuning number."""
    done = analyses.where(F.col("build_key") == build_key).select("doc_id", "digest")
    return with_digest(docs).join(done, ["doc_id", "digest"], "left_anti")


def check_limits(docs: DataFrame, edits: DataFrame, most_bytes: int = 100_000_000, most_pages: int = 1000, most_edits: int = 10_000, most_chars: int = 1000) -> DataFrame:
    """(doc_id, refusal): the first limit a document (doc_id, bytes, pages, header) breaks, or null: no_header, too_large, too_many_pages, too_many_edits, edit_too_long."""
    per_doc = edits.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max(F.length("text")).alias("_longest"))
    d = docs.join(per_doc, "doc_id", "left")
    told = (
        F.when(~F.col("header"), "no_header")
        .when(F.col("bytes") > most_bytes, "too_large")
        .when(F.col("pages") > most_pages, "too_many_pages")
        .when(F.col("_n") > most_edits, "too_many_edits")
        .when(F.col("_longest") > most_chars, "edit_too_long")
    )
    return d.select("doc_id", told.alias("refusal"))


ILLEGAL = r"[\p{Cc}\p{Zl}\p{Zp}\p{Cs}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def illegal_characters(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows with a control, line separator, surrogate or direction mark: its place (from 0, code points) and code point."""
    at = F.regexp_instr(F.col(col), F.lit(ILLEGAL))
    c = F.regexp_extract(col, f"({ILLEGAL})", 1)
    found = df.withColumn("place", at - 1).where("place >= 0")
    return found.withColumn("code", F.concat(F.lit("U+"), F.lpad(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0+", ""), 4, "0")))


LICENCES = ("apache", "ofl", "ufl")


def build_font_catalog(tree: DataFrame, metadata: DataFrame) -> DataFrame:
    """Font files (key, family, path, weight, style, static, reserved) from a tree listing (line: mode, kind, blob, tab, path) and metadata texts (path, text).

    Families are folders at depth 2 under the licence roots; a file counts if the tree has it; static files if any is, else variable ones;
    of a key listed twice the first folder's holds; ``reserved`` if the licence text reserves the name.
    """
    paths = tree.select(F.split_part("line", F.lit("\t"), F.lit(2)).alias("path")).where("path <> ''")
    parts = F.split("path", "/")
    held = paths.where((F.size(parts) == 3) & parts[0].isin(*LICENCES)).select("path", F.array_join(F.slice(parts, 1, 2), "/").alias("folder"))
    meta = metadata.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    family = F.regexp_extract("text", r'(?m)^name: "([^"]*)"', 1)
    blocks = meta.where("path like '%METADATA.pb'").select("folder", family.alias("family"), F.explode(F.regexp_extract_all("text", F.lit(r"fonts \{([^}]*)\}"), F.lit(1))).alias("b"))
    field = lambda n: F.regexp_extract("b", rf'{n}: "?([^"\n]*)"?', 1)
    files = blocks.select("folder", "family", F.concat_ws("/", "folder", field("filename")).alias("path"), field("weight").try_cast("int").alias("weight"), field("style").alias("style"))
    files = files.join(held.select("path"), "path", "left_semi").withColumn("static", ~F.contains("path", F.lit("[")))
    files = files.withColumn("_any", F.bool_or("static").over(Window.partitionBy("folder"))).where("static = _any").drop("_any")
    key = F.concat_ws(":", F.lower("family"), F.col("weight").cast("string"), "style")
    first = files.withColumn("key", key).withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("folder", "path"))).where("_n = 1").drop("_n")
    licence = meta.where("path like '%OFL.txt'").select("folder", F.col("text").rlike("(?i)reserved font name").alias("reserved"))
    return first.join(licence, "folder", "left").select("key", "family", "path", "weight", "style", "static", F.coalesce("reserved", F.lit(False)).alias("reserved"))
