"""Queries over request logs, rate limits and lifetimes derived from all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as op
from ..sources import derive
from . import model_sql as m
from .registry import query


def requests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.requests(derive.table(spark, sf_dir, "events"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line an event; every 13th is a trace line."""
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("k") % 5 == 0, "WARN").otherwise("INFO")
    line = F.concat_ws(" ", F.col("us").cast("string"), level, F.lit("noted"), F.lit("app.events"), F.col("event_type"), F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit("k="), F.col("k").cast("string")))
    return e.select((F.col("event_id") % 16).alias("file"), F.col("event_id").alias("n"), F.when(F.col("event_id") % 13 == 12, F.concat(F.lit("  at line "), F.col("k").cast("string"))).otherwise(line).alias("line"))


@query(
    "parsed_log",
    f"""WITH {m.EVENTS}, g AS (SELECT *, event_id % 16 AS file, event_id % 13 = 12 AS trace, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN k % 5 = 0 THEN 'WARN' ELSE 'INFO' END AS level FROM ev),
h AS (SELECT *, max(CASE WHEN NOT trace THEN event_id END) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS head FROM g), t AS (SELECT file, head, count(*) AS n FROM h WHERE trace GROUP BY ALL)
SELECT h.file, h.event_id AS n, h.us::VARCHAR AS ts, h.level, h.event_type AS event, h.user_id::VARCHAR AS user, coalesce(t.n, 0)::BIGINT AS trace_lines FROM h LEFT JOIN t ON t.file = h.file AND t.head = h.event_id WHERE NOT h.trace""",
)
def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = op.parse_log(lines_of(spark, sf_dir))
    return log.select("file", "n", "ts", "level", "event", F.col("fields")["user"].alias("user"), F.coalesce(F.size("trace"), F.lit(0)).cast("long").alias("trace_lines"))


@query(
    "event_check",
    f"""WITH {m.EVENTS}, g AS (SELECT event_id, event_type AS event, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN k % 5 = 0 THEN 'WARN' ELSE 'INFO' END AS level FROM ev WHERE event_id % 13 <> 12),
c(event, level) AS (VALUES ('view', 'INFO'), ('click', 'INFO'), ('error', 'ERROR'), ('purchase', 'WARN'))
SELECT g.event_id AS n, CASE WHEN c.event IS NULL THEN 'unknown_event' ELSE 'unusual_level' END AS problem FROM g LEFT JOIN c USING (event) WHERE c.event IS NULL OR c.level <> g.level""",
)
def event_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = spark.createDataFrame([("view", "noted", "INFO"), ("click", "noted", "INFO"), ("error", "noted", "ERROR"), ("purchase", "noted", "WARN")], "event string, outcome string, level string")
    return op.check_events(op.parse_log(lines_of(spark, sf_dir))[0], catalogue).select("n", "problem")


@query("request_tallies", f"WITH {m.EVENTS} SELECT user_id AS request, event_type AS name, sum(k)::BIGINT AS n FROM ev GROUP BY 1, 2 UNION ALL SELECT user_id, 'events', count(*)::BIGINT FROM ev GROUP BY 1")
def request_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    return op.request_tallies(e.select(F.col("user_id").alias("request"), F.create_map("event_type", F.col("k").cast("long"), F.lit("events"), F.lit(1).cast("long")).alias("tallies")))


LATENCY = """SELECT {key}, count(*)::BIGINT AS n, list_sort(list(ms))[least(count(*) - 1, floor(0.5 * count(*)))::BIGINT + 1] AS median, list_sort(list(ms))[least(count(*) - 1, floor(0.95 * count(*)))::BIGINT + 1] AS p95, max(ms) AS max,
 count(*) FILTER (status >= 500)::BIGINT AS errors, count(*) FILTER (status = 499)::BIGINT AS left FROM requests GROUP BY {group}"""


@query("route_latency", f"WITH {m.REQUESTS} " + LATENCY.format(key="route", group="1"))
def route_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.route_latency(requests_of(spark, sf_dir))


@query("route_latency_hourly", f"WITH {m.REQUESTS} " + LATENCY.format(key="route, us // 3600000000 * 3600 AS w", group="1, 2"))
def route_latency_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.route_latency(requests_of(spark, sf_dir), 3600)


@query(
    "scrubbed_log",
    r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'GET /d/<document>/' || page_id ELSE 'GET /' || page_id END AS scrubbed, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS replaced FROM pages""",
)
def scrubbed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derive.table(spark, sf_dir, "pages")
    folder = F.substring(F.sha2("url", 256), 1, 22)
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("GET /d/"), folder, F.lit("/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("GET /"), F.col("page_id").cast("string")))
    return op.scrub_log(pages.select("page_id", line.alias("line"))).select("page_id", "scrubbed", F.col("replaced").cast("long").alias("replaced"))


@query("cold_tasks", f"WITH {m.REQUESTS} SELECT key % 32 AS worker, request AS task, row_number() OVER (PARTITION BY key % 32 ORDER BY us, request) = 1 AS cold FROM requests")
def cold_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = requests_of(spark, sf_dir).select((F.col("key") % 32).alias("worker"), F.col("us").alias("started"), F.col("request").alias("task"))
    return op.cold_tasks(tasks).select("worker", "task", "cold")


@query(
    "admitted_requests",
    f"""WITH RECURSIVE {m.REQUESTS}, j AS (SELECT key, request, us, row_number() OVER (PARTITION BY key ORDER BY us, request) AS n FROM requests),
w AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS request, NULL::BIGINT AS us, []::BIGINT[] AS times, false AS admitted FROM (SELECT DISTINCT key FROM j)
 UNION ALL SELECT j.key, j.n, j.request, j.us, CASE WHEN len(list_filter(w.times, lambda x: x > j.us - 21600000000)) < 3 THEN list_append(list_filter(w.times, lambda x: x > j.us - 21600000000), j.us) ELSE w.times END,
  len(list_filter(w.times, lambda x: x > j.us - 21600000000)) < 3 FROM w JOIN j ON j.key = w.key AND j.n = w.n + 1)
SELECT key, request, us, admitted FROM w WHERE n > 0""",
)
def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.admit(requests_of(spark, sf_dir), 3, 6 * 3600)


@query("request_rate", f"WITH {m.REQUESTS} SELECT request, key, count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)::BIGINT AS rate FROM requests")
def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.request_rate(requests_of(spark, sf_dir), 86400).select("request", "key", "rate")


@query(
    "concurrency",
    f"""WITH RECURSIVE {m.REQUESTS}, j AS (SELECT key, us AS s, us + ms * 3600000000 AS e, row_number() OVER (PARTITION BY key ORDER BY us, us + ms * 3600000000) AS n FROM requests),
w AS (SELECT key, 0::BIGINT AS n, []::BIGINT[] AS line, 0::BIGINT AS peak, 0::BIGINT AS over FROM (SELECT DISTINCT key FROM j)
 UNION ALL SELECT j.key, j.n, CASE WHEN len(list_filter(w.line, lambda x: x > j.s)) < 6 THEN list_append(list_filter(w.line, lambda x: x > j.s), j.e) ELSE list_filter(w.line, lambda x: x > j.s) END,
  CASE WHEN len(list_filter(w.line, lambda x: x > j.s)) < 6 THEN greatest(w.peak, len(list_filter(w.line, lambda x: x > j.s)) + 1) ELSE w.peak END, w.over + CASE WHEN len(list_filter(w.line, lambda x: x > j.s)) < 6 THEN 0 ELSE 1 END
  FROM w JOIN j ON j.key = w.key AND j.n = w.n + 1)
SELECT key, max(n) AS jobs, max(peak) AS peak, max(over) AS over FROM w GROUP BY key""",
)
def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = requests_of(spark, sf_dir).select("key", F.col("us").alias("started"), (F.col("us") + F.col("ms") * 3_600_000_000).alias("ended"))
    return op.concurrency(jobs, 2, 4)


@query(
    "lifetimes",
    f"""WITH {m.EVENTS}, g AS (SELECT user_id AS doc_id, us, CASE WHEN us - lag(us) OVER w <= 36000000000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS life FROM g)
SELECT doc_id, life::BIGINT AS life, min(us) AS first_us, max(us) AS last_us, count(*)::BIGINT AS touches FROM r GROUP BY doc_id, life""",
)
def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    return op.lifetimes(e.select(F.col("user_id").alias("doc_id"), "us"), 36000)


@query("expired_documents", f"WITH {m.EVENTS} SELECT user_id AS doc_id, max(us) AS last_us FROM ev GROUP BY 1 HAVING max(us) < 1706572800000000 - 36000000000")
def expired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    return op.expired(e.select(F.col("user_id").alias("doc_id"), "us"), 1_706_572_800_000_000, 36000)


@query(
    "held_sources",
    f"""WITH {m.EVENTS}, a AS (SELECT user_id % 20 AS source, us, event_id AS attempt, CASE WHEN event_type <> 'error' THEN 'ok' WHEN k % 5 = 0 THEN 'no_answer' ELSE 'failed' END AS outcome FROM ev),
b AS (SELECT *, max(CASE WHEN outcome = 'failed' THEN us END) OVER (PARTITION BY source ORDER BY us, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own,
 max(CASE WHEN outcome = 'no_answer' THEN us END) OVER (ORDER BY us, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS quiet, max(CASE WHEN outcome <> 'no_answer' THEN us END) OVER (ORDER BY us, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answer FROM a)
SELECT source, attempt, coalesce(us < own + 600000000, false) OR coalesce(us < quiet + 600000000 AND NOT coalesce(answer > quiet, false), false) AS held FROM b""",
)
def held_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.key_of(derive.table(spark, sf_dir, "events"))
    outcome = F.when(F.col("event_type") != "error", "ok").when(F.col("k") % 5 == 0, "no_answer").otherwise("failed")
    return op.held(e.select((F.col("user_id") % 20).alias("source"), "us", F.col("event_id").alias("attempt"), outcome.alias("outcome"))).select("source", "attempt", "held")
