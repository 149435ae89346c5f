"""Request logs, rate limits, queues and expiry."""

from __future__ import annotations

import heapq
import ipaddress
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.running import running
from ..workspace import Workspace

LINE = r"^(\S+) (DEBUG|INFO|WARN|ERROR) (\S+) (\S+) (\S+)(?: (.*))?$"


def parse_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log lines (file, n, line) as (ts, level, outcome, module, event, fields, trace), and the rejects.

    ``time level outcome module event k=v ...``; lines that do not start like one follow the line before, as its trace. A trace
    without a line before is rejected.
    """
    starts = F.col("line").rlike(LINE)
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_head", F.max(F.when(starts, F.col("n"))).over(w))
    heads = marked.where(F.col("_head") == F.col("n"))
    part = lambda i: F.regexp_extract("line", LINE, i)
    parsed = heads.select("file", "n", part(1).alias("ts"), part(2).alias("level"), part(3).alias("outcome"), part(4).alias("module"), part(5).alias("event"), F.map_filter(F.str_to_map(part(6), F.lit(" "), F.lit("=")), lambda k, v: v.isNotNull()).alias("fields"))
    traces = marked.where(F.col("_head") < F.col("n")).groupBy("file", F.col("_head").alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("_t"))
    traces = traces.select("file", "n", F.transform("_t", lambda x: x["line"]).alias("trace"))
    return parsed.join(traces, ["file", "n"], "left"), marked.where("_head is null").select("file", "n", "line")


def check_events(log: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Log rows whose event is not in the catalogue (event, outcome, level), or whose outcome or level is not its usual one; ``problem`` says which."""
    c = catalogue.select("event", F.col("outcome").alias("_outcome"), F.col("level").alias("_level"))
    problem = F.when(F.col("_level").isNull(), "unknown_event").when(F.col("outcome") != F.col("_outcome"), "other_outcome").when(F.col("level") != F.col("_level"), "unusual_level")
    return log.join(c, "event", "left").withColumn("problem", problem).where("problem is not null").drop("_outcome", "_level")


def request_tallies(rows: DataFrame) -> DataFrame:
    """Counters (request, tallies: map) added up per request and name."""
    return rows.select("request", F.explode("tallies").alias("name", "n")).groupBy("request", "name").agg(F.sum("n").alias("n"))


def route_latency(requests: DataFrame, window_s: int | None = None) -> DataFrame:
    """Per route (and tumbling window of start ``w``, if asked): n, median, p95, max by nearest rank, server errors (5xx), callers who left (499).

    Ranks come from running counts over distinct latencies, so no route's latencies are collected into one row.
    """
    key = ["route"]
    if window_s:
        requests = requests.withColumn("w", F.floor(F.col("us") / (window_s * 1_000_000)) * window_s)
        key.append("w")
    counts = requests.groupBy(*key, "ms").agg(F.count("*").alias("c"))
    run = Window.partitionBy(*key).orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy(*key)))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(q * F.col("n"))), F.col("ms")))
    latency = ranked.groupBy(*key).agg(F.max("n").alias("n"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("ms").alias("max"))
    states = requests.groupBy(*key).agg(F.count_if(F.col("status") >= 500).alias("errors"), F.count_if(F.col("status") == 499).alias("left"))
    return latency.join(states, key)


FOLDER = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{22}(?![A-Za-z0-9_-])"


def scrub_log(lines: DataFrame, col: str = "line") -> DataFrame:
    """``lines`` with document folders (22 characters of a path) replaced, and how many."""
    return lines.withColumn("scrubbed", F.regexp_replace(col, FOLDER, "<document>")).withColumn("replaced", F.regexp_count(F.col(col), F.lit(FOLDER)))


def cold_tasks(tasks: DataFrame) -> DataFrame:
    """``tasks`` (worker, started, task) with ``cold``: the first of its worker."""
    return tasks.withColumn("cold", F.row_number().over(Window.partitionBy("worker").orderBy("started", "task")) == 1)


def admit(requests: DataFrame, limit: int, window_s: float) -> DataFrame:
    """``requests`` (key, request, us) with ``admitted``: fewer than ``limit`` admitted in the last window; a start exactly a window old no longer counts.

    Refused requests do not count, so an answer may depend on those before. It does not where no more than ``limit`` requests, this one included, fall in a window: such a
    calm request is admitted. Only busy stretches are walked. One begins at a request that is not calm, with all of a window before it calm: what counts then is
    known, the requests of that window. Buckets of a key's time, each with the little before and after that its rows may need, tell calm from busy, so
    a hot key is spread over its buckets and stretches. A stretch that never calms down is walked in one task, with at most ``limit`` times in memory.
    """
    span, size = int(window_s * 1_000_000), 64 * int(window_s * 1_000_000)
    work = Workspace(requests.sparkSession, "admit")
    r = requests.select(*[F.col(c).cast("long").alias(c) for c in ("key", "request", "us")])
    own = F.floor(F.col("us") / size)
    into = F.col("us") - own * size
    buckets = F.array(own, F.when(into >= size - 2 * span, own + 1), F.when(into < span, own - 1))
    r = r.withColumn("bucket", own).withColumn("_b", F.explode(F.filter(buckets, lambda b: b.isNotNull())))
    seen = Window.partitionBy("key", "_b").orderBy("us")
    order = Window.partitionBy("key", "_b").orderBy("us", "request")
    r = r.withColumn("busy", F.count("*").over(seen.rangeBetween(-(span - 1), 0)) > limit)
    r = r.withColumn("_last", F.max(F.when(F.col("busy"), F.col("us"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    after_busy = F.coalesce(F.col("_last") > F.col("us") - span, F.lit(False))
    begin = F.when(F.col("busy") & ~after_busy, F.struct("us", "request"))
    r = r.withColumn("begin", begin).withColumn("next", F.min("begin").over(order.rowsBetween(1, Window.unboundedFollowing)))
    r = work.write(r.where("_b = bucket").select("key", "request", "us", "bucket", "busy", "begin", (F.col("busy") | after_busy).alias("on"), F.when(F.col("next.us") - span < F.col("us"), F.col("next")).alias("next")), "marked")
    r = running(r, "key", "bucket", ["us", "request"], F.col("begin"), "max", "stretch")
    part = lambda of, asked: F.struct(of.alias("stretch"), asked.alias("asked"))
    parts = F.array(F.when(F.col("on"), part(F.col("stretch"), F.col("busy"))), F.when(F.col("next").isNotNull(), part(F.col("next"), F.lit(False))))
    r = work.write(r.select("key", "request", "us", "busy", F.filter(parts, lambda x: x.isNotNull()).alias("parts")), "stretches")
    walked = r.select("key", "request", "us", F.explode("parts").alias("p")).select("key", "p.stretch.*", F.col("us").alias("at"), F.col("request").alias("id"), "p.asked")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = object(), deque()
        for batch in batches:
            key, first, request, at, ids, asked = (batch.column(c).to_pylist() for c in ("key", "us", "request", "at", "id", "asked"))
            out = []
            for stretch, us in zip(zip(key, first, request, strict=True), at, strict=True):
                if stretch != now:
                    now, times = stretch, deque()
                while times and times[0] <= us - span:
                    times.popleft()
                ok = len(times) < limit
                if ok:
                    times.append(us)
                out.append(ok)
            told = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((key, ids, at, out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["key", "request", "us", "admitted"])
            yield told.filter(pa.array(asked, pa.bool_()))

    # Streamed in order: only the times of one window are held, however long a stretch is.
    dealt = walked.repartition("key", "us", "request").sortWithinPartitions("key", "us", "request", "at", "id")
    busy = dealt.mapInArrow(walk, "key long, request long, us long, admitted boolean")
    return r.where("not busy").select("key", "request", "us", F.lit(True).alias("admitted")).unionByName(busy)


@F.pandas_udf(StringType())
def _block(s: pd.Series) -> pd.Series:
    def of(text: str) -> str:
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return text
        if address.version == 6 and address.ipv4_mapped:
            return str(address.ipv4_mapped)
        return str(address) if address.version == 4 else str(ipaddress.ip_network((int(address) >> 64 << 64, 64)))

    return s.map(of, na_action="ignore")


def with_address_block(requests: DataFrame, col: str = "address") -> DataFrame:
    """Adds ``key``, what a request counts against: an IPv4 address as it is, a mapped one unwrapped, an IPv6 address's /64, anything else unchanged. Each distinct address is read once."""
    blocks = requests.select(col).distinct().withColumn("key", _block(F.col(col)))
    return requests.join(blocks, col, "left")


def request_rate(requests: DataFrame, window_s: int) -> DataFrame:
    """``requests`` with ``rate``: the key's requests in the window that ends with this one, its start exclusive."""
    w = Window.partitionBy("key").orderBy("us").rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return requests.withColumn("rate", F.count("*").over(w))


def concurrency(jobs: DataFrame, at_work: int, waiting: int, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Per key of jobs (key, started, ended): jobs, the most in line at once, and how many were refused because ``at_work`` + ``waiting`` were in line.

    A refused job never joins the line, so an answer depends on those before, but not across a start at which all jobs begun before have ended, refused ones
    included: the line is empty. A key's log is cut there, by running maxima over buckets of its time, and the pieces are walked side by side in order of start
    (then end), streamed, holding only the ends of those in line. Ends come before starts at the same time.
    """
    work = Workspace(jobs.sparkSession, "concurrency")
    j = jobs.select(*[F.col(c).cast("long").alias(c) for c in ("key", "started", "ended")]).withColumn("bucket", F.floor(F.col("started") / bucket_us))
    j = work.write(running(j, "key", "bucket", ["started", "ended"], F.col("ended"), "max", "_busy_until", -1), "ends")
    empty = F.coalesce(F.col("_busy_until") <= F.col("started"), F.lit(True))
    j = running(j, "key", "bucket", ["started", "ended"], F.when(empty, F.col("started")), "max", "piece")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, told = object(), [], [0, 0, 0]
        for batch in batches:
            done = []
            for *piece, started, ended in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "started", "ended")), strict=True):
                if piece != now:
                    if told[0]:
                        done.append((now[0], *told))
                    now, line, told = piece, [], [0, 0, 0]
                while line and line[0] <= started:
                    heapq.heappop(line)
                told[0] += 1
                if len(line) < at_work + waiting:
                    heapq.heappush(line, ended)
                    told[1] = max(told[1], len(line))
                else:
                    told[2] += 1
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], schema)
        if told[0]:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (now[0], *told), strict=True))], schema)

    names = ["key", "jobs", "peak", "over"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    dealt = j.select("key", "piece", "started", "ended").repartition("key", "piece").sortWithinPartitions("key", "piece", "started", "ended")
    pieces = dealt.mapInArrow(walk, "key long, jobs long, peak long, over long")
    return pieces.groupBy("key").agg(F.sum("jobs").alias("jobs"), F.max("peak").alias("peak"), F.sum("over").alias("over"))


def lifetimes(touches: DataFrame, idle_s: int = 3600) -> DataFrame:
    """Lives of documents (doc_id, us): a touch more than ``idle_s`` after the last begins a new one."""
    w = Window.partitionBy("doc_id").orderBy("us")
    new = F.when(F.lag("us").over(w).isNull() | (F.col("us") - F.lag("us").over(w) > idle_s * 1_000_000), 1).otherwise(0)
    runs = touches.withColumn("_new", new).withColumn("life", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "life").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("touches"))


def expired(touches: DataFrame, now_us: int, idle_s: int = 3600) -> DataFrame:
    """Documents last touched more than ``idle_s`` before ``now_us``."""
    return touches.groupBy("doc_id").agg(F.max("us").alias("last_us")).where(F.col("last_us") < now_us - idle_s * 1_000_000)


def held(attempts: DataFrame, hold_s: int = 600) -> DataFrame:
    """``attempts`` (source, us, attempt, outcome: ok, failed, no_answer) with ``held``: whether the source was on hold when tried.

    A failure holds its source for ``hold_s``; one with no answer holds every source, until any answer. The hold over every source is
    a running fact of all attempts. It is told cell by cell of one second: within a cell by a window, and what was before by a window
    over the cells' own last facts, a slice of ``hold_s`` and the one before at a time, since holds are no longer.
    """
    span = hold_s * 1_000_000
    own = Window.partitionBy("source").orderBy("us", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    cell = F.floor(F.col("us") / 1_000_000)
    quiet, answer = F.when(F.col("outcome") == "no_answer", F.col("us")), F.when(~F.col("outcome").eqNullSafe("no_answer"), F.col("us"))
    a = attempts.withColumn("_own", F.max(F.when(F.col("outcome") == "failed", F.col("us"))).over(own)).withColumn("_cell", cell)

    cells = a.groupBy("_cell").agg(F.max(quiet).alias("q"), F.max(answer).alias("r"))
    slice_of = F.floor(F.col("_cell") / hold_s)
    seen = cells.withColumn("_slice", F.explode(F.array(slice_of, slice_of + 1)))
    before = Window.partitionBy("_slice").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("_q", F.max("q").over(before)).withColumn("_r", F.max("r").over(before)).where(F.col("_slice") == slice_of).select("_cell", "_q", "_r")

    within = Window.partitionBy("_cell").orderBy("us", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, earlier: F.greatest(F.max(c).over(within), F.col(earlier))
    both = a.join(seen, "_cell", "left").withColumn("_quiet", last(quiet, "_q")).withColumn("_answer", last(answer, "_r"))
    everywhere = F.col("_quiet").isNotNull() & (F.col("us") < F.col("_quiet") + span) & ~F.coalesce(F.col("_answer") > F.col("_quiet"), F.lit(False))
    mine = F.coalesce(F.col("us") < F.col("_own") + span, F.lit(False))
    return both.withColumn("held", everywhere | mine).drop("_cell", "_q", "_r", "_quiet", "_answer", "_own")
