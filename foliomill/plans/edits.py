"""Queries that replay the edit log of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import edits as op
from ..sources import derive
from . import model_sql as m
from .layout import pages_of
from .registry import query
from .spans import spans_of

BASE = f"{m.SPANS}, {m.EDITS}, pg AS (SELECT DISTINCT doc_id, page FROM lines)"
LATEST = "latest AS (SELECT doc_id, span_ordinal, max_by(position, position) AS position, arg_max(kind, position) AS kind, arg_max_null(text, position) AS text, arg_max_null(start, position) AS start, arg_max_null(stop, position) AS stop, min(position) AS first_position FROM edits WHERE span_ordinal IS NOT NULL GROUP BY ALL)"
ASCII = "regexp_full_match(s.text, '[\\x00-\\x7F]*')"


def edits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.edits(derive.table(spark, sf_dir, "events"), derive.table(spark, sf_dir, "documents").count())


def longs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


@query(
    "latest_edits",
    f"WITH {m.EDITS}, {LATEST} SELECT doc_id, span_ordinal::BIGINT AS span_ordinal, position::BIGINT AS position, kind, text, start::BIGINT AS start, stop::BIGINT AS stop, first_position::BIGINT AS first_position FROM latest",
)
def latest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.latest_edits(edits_of(spark, sf_dir)))


@query(
    "edit_references",
    f"""WITH {BASE}, o AS (SELECT e.doc_id, e.position, e.kind, CASE WHEN e.kind = 'redact' AND s.doc_id IS NULL THEN 'error' WHEN e.kind = 'replace' AND s.doc_id IS NULL THEN 'no_span'
WHEN e.kind IN ('insert', 'rotate', 'delete_page') AND g.doc_id IS NULL THEN 'no_page' ELSE 'ok' END AS outcome FROM edits e LEFT JOIN spans s ON e.doc_id = s.doc_id AND e.span_ordinal = s.ordinal
LEFT JOIN pg g ON e.doc_id = g.doc_id AND e.page = g.page)
SELECT doc_id, position::BIGINT AS position, kind, outcome, bool_or(outcome = 'error') OVER (PARTITION BY doc_id) AS request_fails FROM o""",
)
def edit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.classify_references(edits_of(spark, sf_dir), spans_of(spark, sf_dir), pages_of(spark, sf_dir))
    return longs(found.select("doc_id", "position", "kind", "outcome", "request_fails"))


@query(
    "redaction_conflicts",
    f"""WITH {m.EDITS}, b AS (SELECT *, max((kind = 'redact')::INT) OVER (PARTITION BY doc_id, span_ordinal ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM edits WHERE kind IN ('replace', 'redact'))
SELECT doc_id, span_ordinal::BIGINT AS span_ordinal, position::BIGINT AS position FROM b WHERE kind = 'replace' AND before = 1""",
)
def redaction_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.redaction_conflicts(edits_of(spark, sf_dir)).select("doc_id", "span_ordinal", "position"))


def redactions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spans_of(spark, sf_dir).select("doc_id", F.col("ordinal").alias("span_ordinal"), F.col("text").alias("span_text"))
    return edits_of(spark, sf_dir).where("kind = 'redact'").join(spans, ["doc_id", "span_ordinal"]).drop("text").withColumnRenamed("span_text", "text")


WIDEN = f"""r0 AS (SELECT e.doc_id, e.span_ordinal, e.position, s.text, e.start, e.stop, substr(s.text, e.start + 1, 5) AS inside FROM edits e JOIN spans s ON e.doc_id = s.doc_id AND e.span_ordinal = s.ordinal WHERE e.kind = 'redact'),
r1 AS (SELECT *, length(inside) - length(regexp_replace(inside, '^\\s+', '')) AS lead, regexp_replace(regexp_replace(inside, '^\\s+', ''), '\\s+$', '') AS trimmed FROM r0),
r2 AS (SELECT *, start + lead AS s, start + lead + length(trimmed) AS e, stop <= length(text) AND length(trimmed) > 0 AS ok FROM r1),
r3 AS (SELECT doc_id, span_ordinal, position, ok, s - length(regexp_extract(substr(text, 1, s::BIGINT), '([\\p{{L}}\\p{{N}}\\p{{M}}]*)$', 1)) AS start, e + length(regexp_extract(substr(text, (e + 1)::BIGINT), '^([\\p{{L}}\\p{{N}}\\p{{M}}]*)', 1)) AS stop FROM r2)"""


@query(
    "merged_ranges",
    f"""WITH {BASE}, {WIDEN}, w AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, span_ordinal ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT doc_id, span_ordinal, start, stop FROM r3 WHERE ok)),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, span_ordinal ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM w)
SELECT doc_id, span_ordinal::BIGINT AS span_ordinal, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM g GROUP BY doc_id, span_ordinal, run""",
)
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.merge_ranges(redactions_of(spark, sf_dir)))


@query("bad_ranges", f"WITH {BASE}, {WIDEN} SELECT doc_id, span_ordinal::BIGINT AS span_ordinal, position::BIGINT AS position FROM r3 WHERE NOT ok")
def bad_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.bad_ranges(redactions_of(spark, sf_dir)).select("doc_id", "span_ordinal", "position"))


# The events hold no moves: a page is gone from its first delete on, unless it is the last one left.
@query(
    "page_ops",
    f"""WITH {BASE}, d AS (SELECT e.doc_id, e.page, min(e.position) AS gone FROM edits e JOIN pg ON e.doc_id = pg.doc_id AND e.page = pg.page WHERE e.kind = 'delete_page' GROUP BY ALL),
s AS (SELECT pg.doc_id, pg.page, CASE WHEN count(d.gone) OVER a = count(*) OVER a AND d.gone = max(d.gone) OVER a THEN NULL ELSE d.gone END AS gone FROM pg LEFT JOIN d ON pg.doc_id = d.doc_id AND pg.page = d.page WINDOW a AS (PARTITION BY pg.doc_id)),
t AS (SELECT s.doc_id, s.page, coalesce(sum(e.degrees), 0) % 360 AS degrees FROM s LEFT JOIN edits e ON e.doc_id = s.doc_id AND e.page = s.page AND e.kind = 'rotate' AND (s.gone IS NULL OR e.position < s.gone) GROUP BY ALL)
SELECT s.doc_id, s.page::BIGINT AS page, t.degrees::BIGINT AS degrees, CASE WHEN s.gone IS NULL THEN count(*) FILTER (s.gone IS NULL) OVER (PARTITION BY s.doc_id ORDER BY s.page) - 1 END AS place FROM s JOIN t ON s.doc_id = t.doc_id AND s.page = t.page""",
)
def page_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edits_of(spark, sf_dir).withColumn("before", F.lit(None).cast("int"))
    return longs(op.fold_page_ops(e, derive.page_counts(derive.table(spark, sf_dir, "documents"))))


DELETED = "gone AS (SELECT DISTINCT doc_id, page FROM edits WHERE kind = 'delete_page' AND page > 0)"


def order_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = edits_of(spark, sf_dir).where("kind = 'delete_page' and page > 0")
    return op.page_order(pages_of(spark, sf_dir), deleted)


ORDER = f"""{DELETED}, ord AS (SELECT p.doc_id, p.page, CASE WHEN g.doc_id IS NULL THEN sum(CASE WHEN g.doc_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.page) - 1 END AS place FROM pg p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.page = g.page)"""


@query("page_order", f"WITH {BASE}, {ORDER} SELECT doc_id, page::BIGINT AS page, place::BIGINT AS place FROM ord")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(order_of(spark, sf_dir))


# Every step of this log has one entry, so a remove takes whole steps.
HISTORY_SQL = f"""WITH RECURSIVE {m.EVENTS}, a0 AS (SELECT user_id AS doc_id, event_id, k, CASE WHEN event_type = 'click' AND k % 2 = 0 THEN 'revise' WHEN event_type IN ('purchase', 'click') THEN 'add' WHEN event_type = 'view' THEN 'undo' WHEN event_type = 'signup' THEN 'redo' ELSE 'remove' END AS action FROM ev),
l0 AS (SELECT *, max(CASE WHEN action IN ('add', 'revise') THEN event_id END) OVER (PARTITION BY doc_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) AS n FROM a0),
log AS (SELECT *, CASE WHEN k % 2 = 0 THEN coalesce(before, event_id - k) ELSE event_id - k END AS gone FROM l0),
walk AS (SELECT doc_id, 0::BIGINT AS n, []::STRUCT(e BIGINT, v VARCHAR, r BIGINT)[] AS done, []::STRUCT(e BIGINT, v VARCHAR, r BIGINT)[] AS undone FROM log GROUP BY doc_id
  UNION ALL SELECT w.doc_id, w.n + 1,
    CASE action WHEN 'add' THEN list_append(done, {{'e': event_id, 'v': k::VARCHAR, 'r': NULL::BIGINT}})
      WHEN 'revise' THEN CASE WHEN k % 4 = 0 AND coalesce(done[-1].e = before, false) THEN list_append(done[:-2], {{'e': event_id, 'v': k::VARCHAR, 'r': done[-1].r}}) ELSE list_append(done, {{'e': event_id, 'v': k::VARCHAR, 'r': before}}) END
      WHEN 'undo' THEN done[:-2] WHEN 'redo' THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END ELSE list_filter(done, lambda x: x.e <> gone) END,
    CASE WHEN action IN ('add', 'revise') THEN [] WHEN action = 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[-1]) ELSE undone END WHEN action = 'redo' THEN undone[:-2] WHEN len(list_filter(done, lambda x: x.e = gone)) > 0 THEN [] ELSE undone END
  FROM walk w JOIN log l ON l.doc_id = w.doc_id AND l.n = w.n + 1),
last AS (SELECT doc_id, unnest(arg_max(done, n)) AS s FROM walk GROUP BY doc_id)
SELECT doc_id, s.e AS entry, s.v AS value, s.r AS replaces FROM last"""


@query("history_replay", HISTORY_SQL)
def history_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as one log: purchases and odd clicks add, even clicks revise the entry before (every other one folds), views undo, signups redo, errors remove (even ones the entry before, others any entry)."""
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    kind, k = F.col("event_type"), F.col("k")
    action = F.when((kind == "click") & (k % 2 == 0), "revise").when(kind.isin("purchase", "click"), "add").when(kind == "view", "undo").when(kind == "signup", "redo").otherwise("remove")
    log = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), action.alias("action"), k.alias("k"), k.cast("string").alias("value"), (k % 4 == 0).alias("folds"))
    before = F.max(F.when(F.col("action").isin("add", "revise"), F.col("seq"))).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    log = log.withColumn("_before", before).withColumn("replaces", F.when(F.col("action") == "revise", F.col("_before")))
    other = F.col("seq") - k
    gone = F.when(k % 2 == 0, F.coalesce("_before", other)).otherwise(other)
    return op.replay_history(log.withColumn("entries", F.array(F.when(F.col("action") == "remove", gone).otherwise(F.col("seq")))).drop("k", "_before"))


CHAINS = """ins AS (SELECT user_id AS doc_id, event_id AS entry, CASE WHEN k % 3 <> 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS replaces, CASE WHEN k % 7 = 0 THEN '' ELSE 'new ' || k END AS text FROM ev WHERE event_type = 'signup')"""


@query(
    "version_chains",
    f"""WITH RECURSIVE {m.EVENTS}, {CHAINS}, c AS (SELECT doc_id, entry, entry AS root FROM ins WHERE replaces IS NULL UNION ALL SELECT i.doc_id, i.entry, c.root FROM ins i JOIN c ON i.doc_id = c.doc_id AND i.replaces = c.entry),
l AS (SELECT c.doc_id, c.root, max(c.entry) AS entry, arg_max(i.text, c.entry) AS text FROM c JOIN ins i ON i.doc_id = c.doc_id AND i.entry = c.entry GROUP BY ALL)
SELECT * FROM l WHERE text <> ''""",
)
def version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.key_of(derive.table(spark, sf_dir, "events")).where("event_type = 'signup'")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    ins = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("entry"), F.when(F.col("k") % 3 != 0, before).alias("replaces"), F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit("new "), F.col("k").cast("string"))).alias("text"))
    return op.latest_versions(ins)


@query(
    "effective_edits",
    f"WITH {BASE}, {LATEST} SELECT l.doc_id, l.span_ordinal::BIGINT AS span_ordinal, l.kind FROM latest l JOIN spans s ON l.doc_id = s.doc_id AND l.span_ordinal = s.ordinal WHERE NOT (l.kind = 'replace' AND l.text IS NOT DISTINCT FROM s.text)",
)
def effective_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.effective_edits(op.latest_edits(edits_of(spark, sf_dir)), spans_of(spark, sf_dir)).select("doc_id", "span_ordinal", "kind")


@query(
    "reading_diff",
    f"""WITH {m.EDITS}, {LATEST}, was AS (SELECT doc_id, span_ordinal, arg_max(kind, position) AS kind, arg_max_null(text, position) AS text, arg_max_null(start, position) AS start, arg_max_null(stop, position) AS stop FROM edits WHERE span_ordinal IS NOT NULL AND position <= 5 GROUP BY ALL)
SELECT coalesce(l.doc_id, w.doc_id) AS doc_id, coalesce(l.span_ordinal, w.span_ordinal)::BIGINT AS span_ordinal, CASE WHEN w.doc_id IS NULL THEN 'new' WHEN l.doc_id IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM latest l FULL JOIN was w ON l.doc_id = w.doc_id AND l.span_ordinal = w.span_ordinal WHERE (l.kind, l.text, l.start, l.stop) IS DISTINCT FROM (w.kind, w.text, w.start, w.stop)""",
)
def reading_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edits_of(spark, sf_dir)
    return op.diff_readings(op.latest_edits(e), op.latest_edits(e.where("position <= 5")))


COMMON = "coalesce(list_min(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {x} <> {y})) - 1, least(len({a}), len({b})))"


@query(
    "word_churn",
    f"""WITH {BASE}, w AS (SELECT e.doc_id, list_filter(regexp_split_to_array(s.text, '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(e.text, '\\s+'), lambda x: x <> '') AS b
  FROM edits e JOIN spans s ON e.doc_id = s.doc_id AND e.span_ordinal = s.ordinal WHERE e.kind = 'replace'),
p AS (SELECT *, {COMMON.format(a="a", b="b", x="a[i]", y="b[i]")} AS p FROM w), r AS (SELECT doc_id, a[p + 1:] AS a, b[p + 1:] AS b FROM p),
q AS (SELECT *, {COMMON.format(a="a", b="b", x="a[len(a) - i + 1]", y="b[len(b) - i + 1]")} AS q FROM r),
x AS (SELECT doc_id, unnest(a[:len(a) - q]) AS word, 1 AS taken, 0 AS put FROM q UNION ALL SELECT doc_id, unnest(b[:len(b) - q]), 0, 1 FROM q)
SELECT doc_id, word, sum(taken)::BIGINT AS taken, sum(put)::BIGINT AS put FROM x GROUP BY ALL""",
)
def word_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spans_of(spark, sf_dir).select("doc_id", F.col("ordinal").alias("span_ordinal"), F.col("text").alias("before"))
    after = edits_of(spark, sf_dir).where("kind = 'replace'").withColumnRenamed("text", "after")
    return op.word_churn(after.join(spans, ["doc_id", "span_ordinal"]))


@query(
    "split_documents",
    f"""WITH {BASE}, {ORDER}, p AS (SELECT *, CASE WHEN place < 1 THEN 1 ELSE 2 END AS part FROM ord WHERE place IS NOT NULL)
SELECT doc_id, part::BIGINT AS part, count(*)::BIGINT AS pages, arg_min(page, place)::BIGINT AS first_page, arg_max(page, place)::BIGINT AS last_page FROM p GROUP BY ALL""",
)
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = order_of(spark, sf_dir)
    return longs(op.split_documents(order, order.select("doc_id").distinct().withColumn("cut", F.lit(1))))
