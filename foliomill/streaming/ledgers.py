"""Streaming forms of the ledgers: the same answers as in batch, row by row as events arrive.

Every operator takes a streaming DataFrame and returns one. Events later than the watermark are
dropped by Spark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators.edits import History, with_revisions
from ..sources.buckets import BucketTable


def put(state, rows: list[tuple]) -> None:
    """Replaces a list state; one without rows is cleared, since Spark stores no empty lists."""
    if rows:
        state.put(rows)
    else:
        state.clear()


def ledger_stream(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each event id once; ids are forgotten once the watermark has passed them."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])


def latency_stream(requests: DataFrame, ts: str = "ts", delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Per route and tumbling window, once the watermark has passed it: n, median, p95, max, errors, left, by the ranks of ``route_latency``.

    Requests are counted by distinct latency first, so state holds a row for each latency of an open window; ranks are read off the counts when it closes.
    """
    mine = [F.count("*").alias("c"), F.count_if(F.col("status") >= 500).alias("errors"), F.count_if(F.col("status") == 499).alias("left")]
    counts = requests.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("window"), "route", "ms").agg(*mine)
    sums = [F.sum(c).alias(c) for c in ("errors", "left")]
    shut = counts.groupBy("window", "route").agg(F.sum("c").alias("n"), F.max("ms").alias("max"), F.array_sort(F.collect_list(F.struct("ms", "c"))).alias("_by"), *sums)

    def at(q: float) -> Column:
        place = F.least(F.col("n") - 1, F.floor(q * F.col("n")))
        none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("ms"))

        def step(a: Column, x: Column) -> Column:
            upto = a["upto"] + x["c"]
            return F.struct(upto.alias("upto"), F.coalesce(a["ms"], F.when(upto > place, x["ms"].cast("long"))).alias("ms"))

        return F.aggregate("_by", none, step)["ms"]

    return shut.select("window", "route", "n", at(0.5).alias("median"), at(0.95).alias("p95"), "max", "errors", "left")


def lifetime_stream(touches: DataFrame, ts: str = "ts", delay: str = "1 hour", idle: str = "1 hour") -> DataFrame:
    """A document's life as a session that ends ``idle`` after its last touch."""
    return touches.withWatermark(ts, delay).groupBy(F.session_window(ts, idle), "doc_id").agg(F.count("*").alias("touches"))


class _Meter(StatefulProcessor):
    """Digests counted per account and month; a map state that holds at most ``limit`` of each month, and how many each month holds. A month is forgotten once the one after the next has begun."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        month, size = StructField("month", StringType()), StructType([StructField("n", LongType())])
        self.counted = handle.getMapState("counted", StructType([month, StructField("digest", StringType())]), size)
        self.sizes = handle.getMapState("sizes", StructType([month]), size)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            frame = frame.sort_values(["us", "event_id"])
            months = pd.to_datetime(frame["us"], unit="us", utc=True).dt.strftime("%Y-%m")
            out, sizes = [], {m: n for (m,), (n,) in self.sizes.iterator()}
            for month, digest in zip(months, frame["digest"], strict=True):
                known = self.counted.containsKey((month, digest))
                ok = known or sizes.get(month, 0) < self.limit
                if ok and not known:
                    self.counted.updateValue((month, digest), (1,))
                    sizes[month] = sizes.get(month, 0) + 1
                    self.sizes.updateValue((month,), (sizes[month],))
                out.append(ok)
            self.forget(sorted(sizes)[:-2])
            yield pd.DataFrame({"account": frame["account"], "event_id": frame["event_id"], "admitted": out})

    def forget(self, months: list[str]) -> None:
        if months:
            for k in [k for k in self.counted.keys() if k[0] in months]:
                self.counted.removeKey(tuple(k))
            for m in months:
                self.sizes.removeKey((m,))

    def close(self) -> None:
        pass


def meter_stream(opens: DataFrame, limit: int) -> DataFrame:
    """Opens (account, digest, event_id, us) with ``admitted``, as ``meter_accounts`` in batch when they arrive in order, at most a month late."""
    schema = StructType([StructField("account", LongType()), StructField("event_id", LongType()), StructField("admitted", BooleanType())])
    return opens.groupBy("account").transformWithStateInPandas(_Meter(limit), schema, "Append", "None")


class _Admission(StatefulProcessor):
    """Start times of a key's admitted requests within the window: at most ``limit``."""

    def __init__(self, limit: int, span_us: int):
        self.limit, self.span = limit, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        times = [t[0] for t in self.times.get()]
        for frame in rows:
            frame, out = frame.sort_values(["us", "request"]), []
            for us in frame["us"]:
                times = [t for t in times if t > us - self.span]
                ok = len(times) < self.limit
                if ok:
                    times.append(int(us))
                out.append(ok)
            yield pd.DataFrame({"key": frame["key"], "request": frame["request"], "admitted": out})
        put(self.times, [(t,) for t in times])

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limit: int, window_s: float) -> DataFrame:
    """Requests (key, request, us) with ``admitted``, as ``admit`` in batch when they arrive in order."""
    schema = StructType([StructField("key", LongType()), StructField("request", LongType()), StructField("admitted", BooleanType())])
    return requests.groupBy("key").transformWithStateInPandas(_Admission(limit, int(window_s * 1_000_000)), schema, "Append", "None")


class _Steps(StatefulProcessor):
    """A document's steps done and undone, as rows (step, entry, value, replaces)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = StructType([StructField("step", LongType()), StructField("entry", LongType()), StructField("value", StringType()), StructField("replaces", LongType())])
        self.kept = {name: handle.getListState(name, row) for name in ("done", "undone")}

    def handleInputRows(self, key, rows, timerValues):
        history = History()
        for step in self.steps("undone"):
            history.undone.append(step)
        for step in self.steps("done"):
            history.push(step)
        log = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, action, entries, *more in zip(*(log[c] for c in ("seq", "action", "entries", "value", "replaces", "folds")), strict=True):
            ids = [] if entries is None else [int(i) for i in entries]
            value, replaces, folds = (None if pd.isna(x) else x for x in more)
            out += [(key[0], seq, *change) for change in history.apply(action, ids, value, None if replaces is None else int(replaces), folds)]
        for name, steps in (("done", history.done), ("undone", history.undone)):
            put(self.kept[name], [(i, int(e), v, r) for i, step in enumerate(steps) for e, v, r in step])
        yield pd.DataFrame(out, columns=["doc_id", "seq", "entry", "value", "change"])

    def steps(self, name: str) -> list[list[tuple]]:
        found: dict[int, list] = {}
        for step, *entry in self.kept[name].get():
            found.setdefault(step, []).append(tuple(entry))
        return [found[i] for i in sorted(found)]

    def close(self) -> None:
        pass


def history_stream(actions: DataFrame) -> DataFrame:
    """(doc_id, seq, entry, value, change) of actions as ``replay_history`` takes them, that arrive in order: 1 for each entry that an action brought into effect, -1 for each it took out. Added up they are ``replay_history``."""
    schema = StructType([StructField("doc_id", LongType()), StructField("seq", LongType()), StructField("entry", LongType()), StructField("value", StringType()), StructField("change", LongType())])
    return with_revisions(actions).groupBy("doc_id").transformWithStateInPandas(_Steps(), schema, "Append", "None")


def upsert_paid(target: str, buckets: int = 1024):
    """A ``foreachBatch`` function that folds applied events (account, paid_until, paid_read_at) into a :class:`BucketTable` at ``target``.

    The newest reading per account wins. A batch reads and rewrites only the buckets of its accounts, and counts once it is committed; one that was committed before changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        def newest(rows: DataFrame) -> DataFrame:
            return rows.groupBy("account").agg(F.max_by("paid_until", "paid_read_at").alias("paid_until"), F.max("paid_read_at").alias("paid_read_at"))

        BucketTable(batch.sparkSession, target, "account", buckets).merge(number, batch.select("account", "paid_until", "paid_read_at"), newest)

    return fold
