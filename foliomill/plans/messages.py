"""Queries over message catalogues, languages and notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages as op
from ..sources import derive
from . import model_sql as m
from .registry import query

CATALOG = [("en", "opened", "one", "{who} opened {n} file"), ("en", "opened", "other", "{who} opened {n} files"), ("en", "took", "", "took {ms} ms"), ("fr", "opened", "", "{who} a ouvert {n}"), ("de", "took", "", "dauerte {zeit} ms")]
CATALOG_SQL = "cat(language, key, form, template) AS (VALUES " + ", ".join(str(r) for r in CATALOG) + ")"


def catalog_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "language string, key string, form string, template string")


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message an event: views opened k % 3 files, the others took some time."""
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    opened = F.col("event_type") == "view"
    params = F.when(opened, F.create_map(F.lit("who"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("n"), (F.col("k") % 3).cast("string"))).otherwise(F.create_map(F.lit("ms"), F.col("value").cast("decimal(18,2)").cast("string")))
    language = F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), language.alias("language"), F.when(opened, "opened").otherwise("took").alias("code"), params.alias("params"))


@query(
    "rendered_messages",
    f"""WITH {m.EVENTS}, g AS (SELECT event_id AS id, list_value('en', 'fr', 'de')[user_id % 3 + 1] AS language, event_type = 'view' AS opened, user_id, k % 3 AS n, replace(round(value::DECIMAL(18,2)::DECIMAL(30,10), 1)::DECIMAL(30,1)::VARCHAR, '.', CASE WHEN user_id % 3 = 0 THEN '.' ELSE ',' END) AS ms FROM ev)
SELECT id, language, CASE WHEN opened THEN 'opened' ELSE 'took' END AS code, CASE WHEN opened AND language = 'fr' THEN 'u' || user_id || ' a ouvert ' || n WHEN opened THEN 'u' || user_id || ' opened ' || n || CASE WHEN n = 1 THEN ' file' ELSE ' files' END
WHEN language = 'de' THEN 'dauerte {{zeit}} ms' ELSE 'took ' || ms || ' ms' END AS text FROM g""",
)
def rendered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.render_messages(messages_of(spark, sf_dir), catalog_of(spark))


@query(
    "catalog_audit",
    f"""WITH {CATALOG_SQL}, l AS (SELECT DISTINCT language FROM cat), used AS (SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'opened' ELSE 'took' END AS key FROM events)
SELECT DISTINCT l.language, e.key, 'missing' AS problem FROM cat e, l WHERE e.language = 'en' AND NOT EXISTS (SELECT 1 FROM cat c WHERE c.language = l.language AND c.key = e.key AND c.form = e.form)
UNION SELECT 'de', 'took', 'other_placeholders' FROM used WHERE key = 'took'""",
)
def catalog_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.audit_catalog(catalog_of(spark), messages_of(spark, sf_dir))


@query(
    "best_language",
    f"""WITH {m.EVENTS} SELECT event_id AS request, CASE k % 5 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' WHEN 2 THEN 'en' WHEN 3 THEN 'en' ELSE 'de' END AS language FROM ev""",
)
def best_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["fr-CA, en;q=0.8", "fr;q=0.3, de-AT;q=0.9", "xx, *;q=0.1", "fr-CA, fr;q=0, en;q=0.5", "en;q=high, de"]
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    accept = F.element_at(F.array(*[F.lit(a) for a in asked]), F.col("k") % 5 + 1)
    return op.best_language(e.select(F.col("event_id").alias("request"), accept.alias("accept")), ["en", "fr", "de"])


@query(
    "unprintable_census",
    r"""WITH c AS (SELECT source, unnest(regexp_extract_all(text, '[\x00-\x09\x0B-\x1F\x7F-\x9F\xAD\x{200B}-\x{200F}\x{A0}]')) AS c FROM documents
UNION ALL SELECT event_type, chr([9, 160, 173, 8203, 13][event_id % 5 + 1]) FROM events)
SELECT source, CASE WHEN c = chr(9) THEN 'tab' ELSE 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0') END AS name, count(*)::BIGINT AS n FROM c GROUP BY ALL""",
)
def unprintable_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and a note an event with a tab, a space that does not break, a soft hyphen, a mark without width or a carriage return."""
    odd = F.get(F.array(*[F.lit(chr(c)) for c in (9, 160, 173, 8203, 13)]), (F.col("event_id") % 5).cast("int"))
    notes = derive.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.concat(F.lit("a b"), odd, F.lit("c\n")).alias("text"))
    return op.visible_characters(derive.table(spark, sf_dir, "documents").select("source", "text").unionByName(notes), {"\t": "tab"}, ["source"])


@query(
    "notices",
    f"""WITH {m.EVENTS}, n AS (SELECT user_id AS doc_id, k % 4 AS page, event_id AS position, CASE WHEN event_type = 'error' THEN 'warning' ELSE 'plain' END AS tone, CASE WHEN k % 9 = 0 THEN 'signed_file' ELSE event_type END AS type, event_type || ' ' || (k % 6) AS text FROM ev),
k AS (SELECT * FROM n WHERE page <> 3 AND NOT (type = 'signed_file' AND doc_id IN (SELECT user_id FROM ev WHERE event_type = 'purchase'))), f AS (SELECT doc_id, text, min(CASE WHEN tone = 'warning' THEN 0 ELSE 1 END * 1000000000 + position) AS o FROM k GROUP BY ALL)
SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY o, text) AS place FROM f""",
)
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    n = e.select(F.col("user_id").alias("doc_id"), (F.col("k") % 4).alias("page"), F.col("event_id").alias("position"), F.when(F.col("event_type") == "error", "warning").otherwise("plain").alias("tone"), F.when(F.col("k") % 9 == 0, "signed_file").otherwise(F.col("event_type")).alias("type"), F.concat_ws(" ", "event_type", (F.col("k") % 6).cast("string")).alias("text"))
    redacted = e.where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"))
    deleted = n.select("doc_id", F.lit(3).alias("page")).distinct()
    return op.consolidate_notices(n, deleted, redacted).withColumn("place", F.col("place").cast("long"))
