"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes says for documents and tokenizer versions what now holds: ``insert``, ``revise``
(a new count, source or language) or ``delete``. ``commit`` turns it into signed ledger rows, the
old contribution taken off and the new one put on, adds them up per (source, lang, version) and
writes both under the batch's id. Totals are the sums of all committed deltas, so nothing is ever
counted again, and order of commits between batches that touch other documents does not matter.

Committing is idempotent: a batch whose rollup folder holds a success marker is left as it is, and
one that broke off is written anew from the same ledger of earlier batches, to the same folder.

A batch meets only the ledger rows of its own keys. Batches are committed one after another: two
committers at once that touch one document would both take off its old contribution. ``compact``
writes a base, from which later commits read instead of the batches' ledgers.

Edge cases: a delete or revise of an unknown document is a no-op or an insert; several changes of
one key in a batch: the one with the highest ``seq`` holds, then the larger count; a document
without an id cannot be named again, so each insert of one counts for itself and its other changes
are no-ops; null source, lang or text are values of their own (null text: no tokens); a group whose
totals return to zero documents stays with zeros, unless ``drop_empty``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, shared_folder, table, words_of
from .packing import ShippedEncoder, encode_texts
from .wordcodes import slices

KEY = ["doc_id", "version"]
GROUP = ["source", "lang", "version"]
CHANGES = "doc_id long, version string, op string, source string, lang string, tokens long, seq long"
LEDGER = "doc_id long, version string, source string, lang string, tokens long, sign int"
ROLLUP = "source string, lang string, version string, docs long, tokens long"

#: Tokenizer versions that Spark counts without leaving the JVM.
VERSIONS = {
    "words-1": lambda text: F.size(words_of(text)).cast("long"),
    "pieces-2": lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}]+|[0-9]|[^\p{L}\p{M}0-9\x20\x09-\x0D]")).cast("long"),
}


class TokenRollup:
    """The ledger and rollups under one folder, a subfolder per batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def batches(self) -> list[str]:
        """Committed batches, in the order of their ids."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rollup")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if self._exists(f"{self.folder}/rollup/{n}/_SUCCESS"))

    def compact(self, name: str) -> bool:
        """Write what all committed batches amount to as one base under ``name``; False if it is there already.

        Later reads take the base last in order of names and the batches it does not cover. The list of covered batches is written last and marks
        a base as whole, so one that broke off is not seen and can be written again. A batch's rollup folder stays as the mark that it is
        committed; the ledger folders of covered batches are not read again.
        """
        base = f"{self.folder}/base/{name}"
        if self._exists(f"{base}/covers/_SUCCESS"):
            return False
        names = self.batches()
        ledger = self.current().withColumn("sign", F.lit(1)).unionByName(self._read("ledger", LEDGER).where("doc_id is null"))
        ledger.select("doc_id", "version", "source", "lang", "tokens", "sign").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{base}/ledger")
        self.totals(drop_empty=False).write.mode("overwrite").parquet(f"{base}/rollup")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{base}/covers")
        return True

    def _base(self) -> tuple[list[str], set[str]]:
        """The newest whole base's folder, if any, and the batches it covers."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/base")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = sorted(f"{self.folder}/base/{s.getPath().getName()}" for s in fs.listStatus(root)) if fs.exists(root) else []
        whole = [p for p in paths if self._exists(f"{p}/covers/_SUCCESS")]
        # names of batches, not rows of them
        return whole[-1:], {r.batch for r in self.spark.read.parquet(f"{whole[-1]}/covers").collect()} if whole else set()

    def _read(self, kind: str, schema: str) -> DataFrame:
        base, covered = self._base()
        paths = [f"{p}/{kind}" for p in base] + [f"{self.folder}/{kind}/{b}" for b in self.batches() if b not in covered]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """What each (doc_id, version) contributes now; of ``keys`` only, if given. Documents without an id aside."""
        ledger = self._read("ledger", LEDGER).where("doc_id is not null")
        if keys is not None:
            asked = keys.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).distinct()
            ledger = ledger.join(asked, (F.col("doc_id") == F.col("_d")) & F.col("version").eqNullSafe(F.col("_v")), "left_semi")
        left = ledger.groupBy("doc_id", *GROUP, "tokens").agg(F.sum("sign").alias("n"))
        return left.where("n > 0").drop("n")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it is already committed."""
        if self._exists(f"{self.folder}/rollup/{batch}/_SUCCESS"):
            return False
        last = Window.partitionBy(*KEY).orderBy(F.desc("seq"), F.desc_nulls_last("tokens"), "source", "lang")
        named = changes.where("doc_id is not null")
        new = named.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "seq")
        if self.batches():
            old = self.current(named).alias("o")
            both = new.alias("n").join(old, F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("n.version").eqNullSafe(F.col("o.version")), "left")
            off = F.struct("o.source", "o.lang", "o.tokens", F.when(F.col("o.tokens").isNotNull(), -1).alias("sign"))
        else:
            both, off = new.alias("n"), F.lit(None).cast("struct<source:string,lang:string,tokens:bigint,sign:int>")
        on = F.struct("n.source", "n.lang", F.coalesce("n.tokens", F.lit(0)).cast("long").alias("tokens"), F.when(F.col("n.op") != "delete", 1).alias("sign"))
        signed = both.select("n.doc_id", "n.version", F.explode(F.array(off, on)).alias("x")).where("x.sign is not null")
        signed = signed.select("doc_id", "version", "x.*").select("doc_id", "version", "source", "lang", "tokens", "sign")
        nameless = changes.where("doc_id is null and op = 'insert'").select("doc_id", "version", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.lit(1).alias("sign"))
        signed.unionByName(nameless).write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch}")
        rows = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/{batch}")
        delta = rows.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/rollup/{batch}")
        return True

    def totals(self, drop_empty: bool = True) -> DataFrame:
        out = self._read("rollup", ROLLUP).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0") if drop_empty else out


def tokenizer_counts(docs: DataFrame, tokenizer: str, batch_bytes: int = 6 << 20) -> DataFrame:
    """``docs`` (doc_id, source, lang, text) without texts, with ``tokens`` by a tokenizer that drops white space (the text of its file); to be committed under a version of its own."""
    shipped = docs.sparkSession.sparkContext.broadcast(ShippedEncoder(tokenizer))  # a vocabulary file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_bytes):
            _, counts = encode_texts(pc.fill_null(batch.column("text"), ""), shipped.value.encoder())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts)], names=[*names, "tokens"])

    names = ["doc_id", "source", "lang"]
    chosen = docs.select(*names, "text")
    return chosen.mapInArrow(run, ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in names) + ", tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents under both versions, delete those labelled toxic, revise those labelled of low quality (license and markup
    symbols no longer count), commit the last batch twice, and return the totals."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = TokenRollup(spark, f"{shared_folder(spark)}/token-counts-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}")
    # Texts are counted where they are read; only numbers are shuffled.
    plain = F.regexp_replace("text", r"[#*$%&|<>]+", " ")
    both = F.array(*[F.struct(F.lit(v).alias("version"), count(F.col("text")).alias("tokens"), count(plain).alias("revised")) for v, count in VERSIONS.items()])
    work = Workspace(spark, "token-counts")
    counts = work.write(docs.select("doc_id", "source", "lang", F.explode(both).alias("x")).select("doc_id", "source", "lang", "x.*"), "counts")

    def changes(of: DataFrame, op: str, tokens: Column) -> DataFrame:
        return of.select("doc_id", "version", F.lit(op).alias("op"), "source", "lang", tokens.cast("long").alias("tokens"), F.lit(0).cast("long").alias("seq"))

    store.commit("0001-load", changes(counts, "insert", F.col("tokens")))
    toxic = counts.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    store.commit("0002-remove", changes(toxic, "delete", F.lit(None)))
    poor = counts.join(labels.where("quality = 0 and toxic = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    revised = changes(poor, "revise", F.col("revised"))
    store.commit("0003-revise", revised)
    store.commit("0003-revise", revised)
    return store.totals()


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT d.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0 AND l.toxic = 0) AS poor FROM d
), k AS (
  SELECT source, lang, CASE WHEN poor THEN regexp_replace(text, '[#*$%&|<>]+', ' ', 'g') ELSE text END AS text FROM t WHERE NOT toxic
), c AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM k
  UNION ALL
  SELECT source, lang, 'pieces-2', len(regexp_extract_all(text, '[\p{L}\p{M}]+|[0-9]|[^\p{L}\p{M}0-9\x20\x09-\x0D]')) FROM k
)
SELECT source, lang, version, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM c GROUP BY ALL
"""
