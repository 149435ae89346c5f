"""Queries over usage, billing and mail ledgers derived from all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as op
from ..sources import derive
from . import model_sql as m
from .registry import query

SECRET = "example"


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "events")


METERED = """f0 AS (SELECT *, strftime(make_timestamp(us), '%Y-%m') AS month FROM opens),
f1 AS (SELECT *, row_number() OVER (PARTITION BY account, month, digest ORDER BY us, event_id) = 1 AS first FROM f0),
f2 AS (SELECT account, month, digest, row_number() OVER (PARTITION BY account, month ORDER BY us, event_id) AS r FROM f1 WHERE first)"""


@query("meter_accounts", f"WITH {m.OPENS}, {METERED} SELECT f1.account, f1.event_id, f1.month, f1.first, f2.r <= 10 AS admitted FROM f1 JOIN f2 USING (account, month, digest)")
def meter_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.meter_accounts(derive.opens(events_of(spark, sf_dir)), 10).select("account", "event_id", "month", "first", "admitted")


@query(
    "meter_browsers",
    f"""WITH RECURSIVE {m.OPENS}, o AS (SELECT account AS browser, digest, event_id, us, row_number() OVER (PARTITION BY account ORDER BY us, event_id) AS n FROM opens),
walk AS (SELECT browser, digest, event_id, us, n, [digest] AS held, us AS since, true AS admitted FROM o WHERE n = 1
  UNION ALL SELECT browser, digest, event_id, us, n, CASE WHEN fresh THEN list_append(kept, digest) ELSE kept END, CASE WHEN fresh THEN us ELSE since END, fresh OR known
  FROM (SELECT *, list_contains(kept, digest) AS known, NOT list_contains(kept, digest) AND len(kept) < 3 AS fresh
    FROM (SELECT o.*, w.since, CASE WHEN o.us - w.since >= {op.KEPT_S * 1_000_000} THEN [] ELSE w.held END AS kept FROM walk w JOIN o ON o.browser = w.browser AND o.n = w.n + 1)))
SELECT browser, digest, event_id, us, admitted FROM walk""",
)
def meter_browsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.meter_browsers(derive.opens(events_of(spark, sf_dir)).withColumnRenamed("account", "browser"), 3)


LEDGER = f"""{m.BILLING}, led AS (SELECT * FROM billing QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1),
ap AS (SELECT *, CASE WHEN type <> 'invoice.paid' THEN 'ignored' WHEN account IS NULL THEN 'no_account' WHEN paid_read_at <= max(CASE WHEN type = 'invoice.paid' THEN paid_read_at END) OVER (PARTITION BY account ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
 THEN 'superseded' ELSE 'applied' END AS outcome FROM led)"""


def applied_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.apply_events(op.ledger(derive.billing_events(events_of(spark, sf_dir))))


@query(
    "exempt_at",
    f"""WITH {LEDGER}, pay AS (SELECT account, created AS us, paid_until FROM ap WHERE outcome = 'applied'), op AS (SELECT user_id AS account, event_id, us FROM ev WHERE event_type = 'view')
SELECT o.account, o.event_id, o.account % 25 = 0 OR coalesce(o.us < ((SELECT arg_max(p.paid_until, (p.us, p.paid_until)) FROM pay p WHERE p.account = o.account AND p.us <= o.us) + 7200) * 1000000, false) AS exempt FROM op o""",
)
def exempt_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = applied_of(spark, sf_dir).where("outcome = 'applied'").select("account", F.col("created").alias("applied_us"), "paid_until")
    accounts = events_of(spark, sf_dir).select(F.col("user_id").alias("account")).distinct().withColumn("is_unlimited", F.col("account") % 25 == 0)
    return op.exempt_at(derive.opens(events_of(spark, sf_dir)), accounts, paid).select("account", "event_id", "exempt")


@query(
    "documents_left",
    f"WITH {m.OPENS} SELECT account, strftime(make_timestamp(us), '%Y-%m') AS month, CASE WHEN account % 25 = 0 THEN NULL ELSE greatest(10 - count(DISTINCT digest), 0) END::BIGINT AS left FROM opens GROUP BY 1, 2",
)
def documents_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = events_of(spark, sf_dir).select(F.col("user_id").alias("account")).distinct().withColumn("exempt", F.col("account") % 25 == 0)
    return op.documents_left(derive.opens(events_of(spark, sf_dir)), accounts, 10)


@query("billing_ledger", f"WITH {LEDGER} SELECT id, arrival, account, type FROM led")
def billing_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ledger(derive.billing_events(events_of(spark, sf_dir))).select("id", "arrival", "account", "type")


@query("applied_events", f"WITH {LEDGER} SELECT id, arrival, outcome FROM ap")
def applied_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied_of(spark, sf_dir).select("id", "arrival", "outcome")


@query("paid_state", f"WITH {LEDGER} SELECT account, arg_max(paid_until, paid_read_at) AS paid_until, max(paid_read_at) AS paid_read_at FROM ap WHERE outcome = 'applied' GROUP BY account")
def paid_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.paid_state(applied_of(spark, sf_dir))


SUBS = """subs AS (SELECT event_id AS id, user_id AS customer, k % 9 <> 0 AS own, CASE k % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' ELSE 'canceled' END AS status, k % 11 = 0 AS paused, us // 1000000 AS created,
 us // 1000000 + 86400 * (k % 3 + 1) AS period_end FROM ev WHERE event_type = 'purchase')"""


def subscriptions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase starts a subscription of two items."""
    e = derive.key_of(events_of(spark, sf_dir)).where("event_type = 'purchase'")
    k, s = F.col("k"), F.floor(F.col("us") / 1_000_000)
    status = F.when(k % 4 == 0, "active").when(k % 4 == 1, "trialing").when(k % 4 == 2, "past_due").otherwise("canceled")
    items = F.array(*[F.struct((s + 86400 * n).alias("current_period_end")) for n in (F.lit(1), k % 3 + 1)])
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("customer"), (k % 9 != 0).alias("own"), status.alias("status"), (k % 11 == 0).alias("paused"), s.alias("created"), items.alias("items"))


def customers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir).select(F.col("user_id").alias("customer")).distinct().where("customer % 10 <> 0")


@query(
    "paid_until",
    f"WITH {m.EVENTS}, {SUBS} SELECT customer, max(CASE WHEN own AND status IN ('active', 'trialing') AND NOT paused THEN greatest(created + 86400, period_end) END) AS paid_until FROM subs GROUP BY customer",
)
def paid_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.paid_until(subscriptions_of(spark, sf_dir))


@query(
    "billing_alerts",
    f"""WITH {m.EVENTS}, {SUBS} SELECT customer, 'subscribed_twice' AS alert FROM subs WHERE own AND status <> 'canceled' GROUP BY customer HAVING count(*) > 1
UNION ALL SELECT DISTINCT customer, 'no_account' FROM subs WHERE customer % 10 = 0""",
)
def billing_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.billing_alerts(subscriptions_of(spark, sf_dir), customers_of(spark, sf_dir))


@query(
    "disputed_subscriptions",
    f"""WITH {m.EVENTS}, {SUBS}, d AS (SELECT user_id AS customer, max(us // 1000000) AS until FROM ev WHERE event_type = 'error' GROUP BY 1)
SELECT id, customer FROM subs JOIN d USING (customer) WHERE own AND status <> 'canceled' AND created <= until""",
)
def disputed_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    disputes = derive.key_of(events_of(spark, sf_dir)).where("event_type = 'error'").select(F.col("user_id").alias("customer"), F.floor(F.col("us") / 1_000_000).alias("created"))
    return op.disputed(subscriptions_of(spark, sf_dir), disputes).select("id", "customer")


def mail_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events_of(spark, sf_dir).select(F.col("user_id").alias("account")).distinct().where("account % 3 <> 0")
    return a.withColumn("email", F.concat(F.lit("u"), F.col("account").cast("string"), F.lit("@mail.example")))


@query(
    "suppressions",
    f"""WITH {m.MAIL}, l AS (SELECT email, arg_max(event, (us, event_id)) AS event, arg_max(us, (us, event_id)) AS us FROM mail WHERE event <> 'other' GROUP BY email), a AS (SELECT DISTINCT user_id AS account, 'u' || user_id || '@mail.example' AS email FROM events WHERE user_id % 3 <> 0)
SELECT a.account, CASE WHEN a.account IS NULL THEN sha256('{SECRET}|' || l.email) END AS digest, l.us FROM l LEFT JOIN a USING (email) WHERE l.event = 'hard_bounce'""",
)
def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.suppressions(derive.mail_events(events_of(spark, sf_dir)), mail_accounts(spark, sf_dir), SECRET)


@query(
    "clean_addresses",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]*@[^ \n]*')) AS email FROM documents)
SELECT doc_id, lower(trim(email)) AS address, regexp_full_match(lower(trim(email)), '[^@\s,;<>]+@[^@\s,;<>]+\.[^@\s,;<>]+') AND length(trim(email)) <= 254 AS valid FROM w""",
)
def clean_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derive.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]*@[^ \n]*"), F.lit(0))).alias("email"))
    return op.clean_addresses(docs).select("doc_id", "address", "valid")


@query(
    "colliding_addresses",
    r"""WITH w AS (SELECT doc_id AS account, unnest(regexp_extract_all(text, '[^ \n]*@[^ \n]*')) AS email FROM documents
UNION ALL SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN ' U' || user_id % 40 || '@Mail.Example' ELSE 'u' || user_id % 40 || '@mail.example ' END FROM events)
SELECT lower(trim(email)) AS address, count(DISTINCT account)::BIGINT AS accounts FROM w GROUP BY 1 HAVING count(DISTINCT account) > 1""",
)
def colliding_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents, and those of accounts, which write forty addresses in their own ways."""
    docs = derive.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("account"), F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]*@[^ \n]*"), F.lit(0))).alias("email"))
    number = (F.col("user_id") % 40).cast("string")
    written = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" U"), number, F.lit("@Mail.Example"))).otherwise(F.concat(F.lit("u"), number, F.lit("@mail.example ")))
    accounts = derive.table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), written.alias("email")).distinct()
    return op.colliding_addresses(docs.unionByName(accounts), "account")


@query(
    "spent_tokens",
    f"WITH {m.TOKENS} SELECT account, arrival, used_at < until AND coalesce(until > max(CASE WHEN used_at < until THEN until END) OVER (PARTITION BY account ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS works FROM tokens",
)
def spent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.spend_tokens(derive.token_uses(events_of(spark, sf_dir))).select("account", "arrival", "works")


@query(
    "account_removals",
    f"""WITH {LEDGER}, st AS (SELECT account, arg_max(paid_until, paid_read_at) AS paid_until FROM ap WHERE outcome = 'applied' GROUP BY account), r AS (SELECT user_id AS account, event_id, us // 1000000 AS at FROM ev WHERE event_type = 'error')
SELECT r.account, r.event_id, CASE WHEN s.account IS NULL THEN 'no_account' WHEN r.at < s.paid_until + 7200 THEN 'paying' ELSE 'removed' END AS outcome FROM r LEFT JOIN st s USING (account)""",
)
def account_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derive.key_of(events_of(spark, sf_dir)).where("event_type = 'error'").select(F.col("user_id").alias("account"), "event_id", F.floor(F.col("us") / 1_000_000).alias("at"))
    return op.removals(r, op.paid_state(applied_of(spark, sf_dir))).select("account", "event_id", "outcome")
