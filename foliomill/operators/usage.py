"""Usage, billing and mail ledgers: idempotent, safe against late and repeated events.

Times are microseconds since 1970 (``us``) or whole seconds where said; months are UTC. Ties in
time are broken by event id or arrival, so every result is deterministic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import Workspace

LEEWAY_S = 2 * 3600
KEPT_S = 365 * 86400


def month(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM")


def meter_accounts(opens: DataFrame, limit: int) -> DataFrame:
    """``opens`` (account, digest, event_id, us) with ``month``, ``first`` and ``admitted``.

    A digest counts once per account and month; new ones past the limit are refused and not counted, now and later that month, so the
    rank among first opens decides. Exact as long as an account's exemption does not change within the month.
    """
    o = opens.withColumn("month", month(F.col("us")))
    group = ["account", "month", "digest"]
    o = o.withColumn("first", F.row_number().over(Window.partitionBy(*group).orderBy("us", "event_id")) == 1)
    firsts = o.where("first").withColumn("rank", F.row_number().over(Window.partitionBy("account", "month").orderBy("us", "event_id"))).select(*group, "rank")
    return o.join(firsts, group).withColumn("admitted", F.col("rank") <= limit).drop("rank")


def meter_browsers(opens: DataFrame, free: int) -> DataFrame:
    """``opens`` (browser, digest, event_id, us) with ``admitted``: a browser's free documents, its list kept 365 days from its last new file.

    A list admits its first ``free`` digests, each of them within 365 days of the one before, and lapses at the first open 365 days or more after its last new one.
    So all lists of an age are told at once, by each digest's first open: an age a round, as many rounds as any browser had lists, each at least 365 days
    of its log. Rows of one browser are never brought together, only ``free`` digests.
    """
    work = Workspace(opens.sparkSession, "browsers")
    o = opens.select(F.col("browser").cast("long").alias("browser"), F.col("digest").cast("string").alias("digest"), *[F.col(c).cast("long").alias(c) for c in ("event_id", "us")])
    left, told, at, kept = work.write(o, "opens-0"), [], F.struct("us", "event_id"), KEPT_S * 1_000_000
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    while True:
        age = len(told)
        firsts = left.groupBy("browser", "digest").agg(F.min(at).alias("first"))
        order = Window.partitionBy("browser").orderBy("first", "digest")
        list_of = firsts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= free)
        late = F.coalesce(F.col("first.us") >= F.lag("first.us").over(order) + kept, F.lit(False))
        list_of = list_of.withColumn("_late", late).withColumn("_lapsed", F.max("_late").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not _lapsed")
        list_of = work.write(list_of.select(F.col("browser").alias("_browser"), F.col("digest").alias("_digest"), "first"), f"lists-{age}")
        until = list_of.groupBy("_browser").agg((F.max("first.us") + kept).alias("_until"))
        ends = left.join(until, same("browser")).where("us >= _until").groupBy(F.col("browser").alias("_browser")).agg(F.min(at).alias("_end"))
        ends = work.write(ends, f"ends-{age}")
        # browsers whose list has not lapsed have no end
        timed = left.join(ends, same("browser"), "left").drop("_browser").withColumn("_over", F.coalesce(at >= F.col("_end"), F.lit(False)))
        now = timed.where("not _over").drop("_end", "_over")
        known = list_of.select("_browser", "_digest", F.lit(True).alias("_known"))
        told.append(work.write(now.join(known, same("browser") & same("digest"), "left").select("browser", "digest", "event_id", "us", F.coalesce("_known", F.lit(False)).alias("admitted")), f"told-{age}"))
        if ends.isEmpty():
            return reduce(DataFrame.unionByName, told)
        left = work.write(timed.where("_over").drop("_end", "_over"), f"opens-{age + 1}")


def exempt_at(opens: DataFrame, accounts: DataFrame, paid: DataFrame) -> DataFrame:
    """``opens`` with ``exempt``: the account is unlimited, or the last payment applied before the open (account, applied_us, paid_until in s) plus two hours is not over."""
    both = opens.select("account", "us", "event_id", F.lit(None).cast("long").alias("until"), F.lit(1).alias("kind")).unionByName(
        paid.select("account", F.col("applied_us").alias("us"), F.lit(None).cast("long").alias("event_id"), F.col("paid_until").alias("until"), F.lit(0).alias("kind"))
    )
    w = Window.partitionBy("account").orderBy("us", "kind", "until").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("held", F.last("until", ignorenulls=True).over(w)).where("kind = 1")
    at = at.join(accounts.select("account", "is_unlimited"), "account", "left")
    paying = F.coalesce(F.col("us") < (F.col("held") + LEEWAY_S) * 1_000_000, F.lit(False))
    return at.select("account", "event_id", "us", (F.coalesce("is_unlimited", F.lit(False)) | paying).alias("exempt"))


def documents_left(opens: DataFrame, accounts: DataFrame, monthly: int) -> DataFrame:
    """Per account and month max(monthly - distinct documents, 0); null for an exempt account (account, exempt)."""
    used = opens.groupBy("account", month(F.col("us")).alias("month")).agg(F.count_distinct("digest").alias("used"))
    return used.join(accounts.select("account", "exempt"), "account", "left").select(
        "account", "month", F.when(F.coalesce("exempt", F.lit(False)), None).otherwise(F.greatest(monthly - F.col("used"), F.lit(0))).alias("left")
    )


def ledger(events: DataFrame) -> DataFrame:
    """Each event id once, as it first arrived."""
    w = Window.partitionBy("id").orderBy("arrival")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_events(events: DataFrame) -> DataFrame:
    """Ledger rows with ``outcome``: ignored (another type), no_account, superseded (an earlier arrival was read as late or later), applied.

    A superseded reading never raises the maximum, so the running maximum of all before is that of the applied.
    """
    pays = (F.col("type") == "invoice.paid") & F.col("account").isNotNull()
    w = Window.partitionBy("account").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(pays, F.col("paid_read_at"))).over(w)
    outcome = F.when(F.col("type") != "invoice.paid", "ignored").when(F.col("account").isNull(), "no_account").when(F.col("paid_read_at") <= before, "superseded").otherwise("applied")
    return events.withColumn("outcome", outcome)


def paid_state(applied: DataFrame) -> DataFrame:
    """Per account the paid time of the latest reading applied."""
    return applied.where("outcome = 'applied'").groupBy("account").agg(F.max_by("paid_until", "paid_read_at").alias("paid_until"), F.max("paid_read_at").alias("paid_read_at"))


def paid_until(subscriptions: DataFrame) -> DataFrame:
    """Per customer the latest period end of items of own, active or trialing, unpaused subscriptions; null if none."""
    live = F.col("own") & F.col("status").isin("active", "trialing") & ~F.col("paused")
    end = F.when(live, F.array_max(F.transform("items", lambda i: i["current_period_end"])))
    return subscriptions.groupBy("customer").agg(F.max(end).alias("paid_until"))


ENDED = ("canceled", "incomplete_expired")


def billing_alerts(subscriptions: DataFrame, accounts: DataFrame) -> DataFrame:
    """(customer, alert): subscribed_twice, with more than one subscription not ended; no_account, for a customer without one."""
    live = subscriptions.where(F.col("own") & ~F.col("status").isin(*ENDED))
    twice = live.groupBy("customer").agg(F.count("*").alias("n")).where("n > 1").select("customer", F.lit("subscribed_twice").alias("alert"))
    orphan = subscriptions.select("customer").distinct().join(accounts.select("customer"), "customer", "left_anti").select("customer", F.lit("no_account").alias("alert"))
    return twice.unionByName(orphan)


def disputed(subscriptions: DataFrame, disputes: DataFrame) -> DataFrame:
    """Own subscriptions not ended and made at or before a dispute of their customer; later ones stay."""
    d = disputes.groupBy("customer").agg(F.max("created").alias("_until"))
    live = subscriptions.where(F.col("own") & ~F.col("status").isin(*ENDED))
    return live.join(d, "customer").where("created <= _until").drop("_until")


def suppressions(mail_events: DataFrame, accounts: DataFrame, secret: str) -> DataFrame:
    """Addresses whose last event is a hard bounce: on the account if there is one, else under a keyed digest. An invitation clears it.

    Later events win; at equal times the later id.
    """
    last = mail_events.where("event in ('hard_bounce', 'invite')").groupBy(F.lower(F.trim("email")).alias("email")).agg(F.max_by(F.struct("event", "us"), F.struct("us", "event_id")).alias("e"))
    held = last.where("e.event = 'hard_bounce'").join(accounts.select("email", "account"), "email", "left")
    return held.select("account", F.when(F.col("account").isNull(), F.sha2(F.concat(F.lit(secret), F.lit("|"), "email"), 256)).alias("digest"), F.col("e.us").alias("us"))


def clean_addresses(df: DataFrame, col: str = "email") -> DataFrame:
    """``df`` with ``address`` (trimmed, lower case) and ``valid``: one @ with both parts, a dot in the domain, no spaces or separators, at most 254 characters."""
    address = F.lower(F.trim(col))
    valid = address.rlike(r"^[^@\s,;<>]+@[^@\s,;<>]+\.[^@\s,;<>]+$") & (F.length(address) <= 254)
    return df.withColumn("address", address).withColumn("valid", F.coalesce(valid, F.lit(False)))


def colliding_addresses(df: DataFrame, key: str, col: str = "email") -> DataFrame:
    """Addresses that several accounts share once cleaned."""
    return clean_addresses(df, col).groupBy("address").agg(F.count_distinct(key).alias("accounts")).where("accounts > 1")


def spend_tokens(uses: DataFrame) -> DataFrame:
    """``uses`` (account, until, used_at in s, arrival) with ``works``: not expired, and later than every token that worked before.

    An expired token never counts, so only unexpired ones enter the running maximum.
    """
    fresh = F.col("used_at") < F.col("until")
    w = Window.partitionBy("account").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(fresh, F.col("until"))).over(w)
    return uses.withColumn("works", fresh & F.coalesce(F.col("until") > before, F.lit(True)))


def removals(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests (account, at in s) with ``outcome``: no_account, paying (within two hours of the paid time), removed."""
    a = requests.join(accounts.select("account", "paid_until", F.lit(True).alias("_held")), "account", "left")
    paying = F.coalesce(F.col("at") < F.col("paid_until") + LEEWAY_S, F.lit(False))
    return a.withColumn("outcome", F.when(F.col("_held").isNull(), "no_account").when(paying, "paying").otherwise("removed")).drop("_held", "paid_until")
