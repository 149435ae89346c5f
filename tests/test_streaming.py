"""Streams give what the batch gives on the same rows."""

import math
import random

from pyspark.sql import functions as F

from foliomill.operators import edits, logs, usage
from foliomill.sources import derive
from foliomill.sources.buckets import BucketTable
from foliomill.streaming import ledgers

DATA = "/root/testdata/sf0.001"


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def stream_of(spark, df, folder):
    df.coalesce(1).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).parquet(str(folder))


def test_ledger(spark, tmp_path):
    e = derive.billing_events(derive.table(spark, DATA, "events")).withColumn("ts", F.timestamp_micros("created"))
    got = drained(spark, ledgers.ledger_stream(stream_of(spark, e, tmp_path / "e"), delay="40 days"), "ledger")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in usage.ledger(e).collect())


def test_metering(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    o = derive.opens(derive.table(spark, DATA, "events"))
    got = drained(spark, ledgers.meter_stream(stream_of(spark, o, tmp_path / "o"), 3), "metered")
    want = usage.meter_accounts(o, 3)
    assert {(r.event_id, r.admitted) for r in got.collect()} == {(r.event_id, r.admitted) for r in want.collect()}


def test_admission(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = derive.requests(derive.table(spark, DATA, "events"))
    got = drained(spark, ledgers.admit_stream(stream_of(spark, r, tmp_path / "r"), 2, 86400 * 3), "admitted")
    want = logs.admit(r, 2, 86400 * 3)
    assert {(x.request, x.admitted) for x in got.collect()} == {(x.request, x.admitted) for x in want.collect()}


def test_history(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "doc_id long, seq long, action string, entries array<long>, value string, replaces long, folds boolean"
    log = history_log(random.Random(5), 400)
    df = spark.createDataFrame(log, kind)
    for part in ("seq < 150", "seq >= 150 and seq < 151", "seq >= 151"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "h"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "h"))
        q = ledgers.history_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    got = {(r.doc_id, r.entry, r.value): r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id", "entry", "value").agg(F.sum("change").alias("n")).where("n <> 0").collect()}
    batch = {tuple(r) for r in edits.replay_history(df).collect()}
    assert batch == set(walked(log)) and any(r[3] is not None for r in batch)
    assert got == dict.fromkeys((r[:3] for r in batch), 1)


def history_log(draw, n):
    log = []
    for seq in range(n):
        action = draw.choice(["add", "add", "undo", "undo", "redo", "remove", "revise", "revise"])
        entries = {"add": [seq, 1000 + seq], "remove": [draw.randrange(seq + 1), draw.randrange(1000, 1001 + seq)], "revise": [seq]}.get(action)
        before = [x[3][0] for x in log[-6:] if x[0] == seq % 3 and x[3]]
        log.append((seq % 3, seq, action, entries, f"v{seq}", draw.choice(before) if before and action == "revise" else None, draw.random() < 0.7 if action == "revise" else None))
    return log


def walked(log):
    """The entries in effect, by walking all steps at every action."""
    state = {}
    for doc, _, action, ids, value, replaces, folds in log:
        done, undone = state.get(doc, ([], []))
        if action == "add":
            done, undone = [*done, [(i, value, None) for i in ids]], []
        elif action == "revise":
            over = done[-1][0] if folds and done and len(done[-1]) == 1 and done[-1][0][0] == replaces else None
            done, undone = [*(done[:-1] if over else done), [(ids[0], value, over[2] if over else replaces)]], []
        elif action == "undo" and done:
            done, undone = done[:-1], [*undone, done[-1]]
        elif action == "redo" and undone:
            done, undone = [*done, undone[-1]], undone[:-1]
        elif action == "remove" and any(x[0] in ids for s in done for x in s):
            done, undone = [s for s in ([e for e in s if e[0] not in ids] for s in done) if s], []
        state[doc] = done, undone
    return [(doc, *e) for doc, (done, _) in state.items() for s in done for e in s]


def test_latency_and_lifetimes(spark, tmp_path):
    """Windows that the watermark has passed equal the batch's."""
    r = derive.requests(derive.table(spark, DATA, "events")).withColumn("ts", F.timestamp_micros("us"))
    got = drained(spark, ledgers.latency_stream(stream_of(spark, r, tmp_path / "r"), delay="1 second", window="1 day"), "latency")
    got = {(x.route, x.w): x for x in got.withColumn("w", F.unix_timestamp("window.start")).collect()}
    want = {(x.route, x.w): x for x in logs.route_latency(r, 86400).collect()}
    last = max(w for _, w in want)
    assert got and set(got) == {k for k in want if k[1] < last}
    for k, x in got.items():
        assert [x[c] for c in ("n", "median", "p95", "max", "errors", "left")] == [want[k][c] for c in ("n", "median", "p95", "max", "errors", "left")]

    t = derive.table(spark, DATA, "events").select(F.col("user_id").alias("doc_id"), F.expr("unix_micros(ts::timestamp)").alias("us"), F.col("ts").cast("timestamp").alias("ts"))
    lives = drained(spark, ledgers.lifetime_stream(stream_of(spark, t, tmp_path / "t"), delay="1 second"), "lives")
    sessions = {(x.doc_id, x.a, x.touches) for x in lives.select("doc_id", F.expr("unix_micros(session_window.start)").alias("a"), "touches").collect()}
    all_ = {(x.doc_id, x.first_us, x.touches) for x in logs.lifetimes(t).collect()}
    assert sessions and sessions <= all_ and len(all_) - len(sessions) <= t.select("doc_id").distinct().count()


PAID = "account long, paid_until long, paid_read_at long"


def test_paid_state_is_replayable(spark, tmp_path):
    applied = usage.apply_events(usage.ledger(derive.billing_events(derive.table(spark, DATA, "events")))).where("outcome = 'applied'")
    target = str(tmp_path / "paid")
    fold = ledgers.upsert_paid(target, buckets=16)
    for number, part in enumerate(("arrival % 2 = 0", "arrival % 2 = 1", "arrival % 2 = 1")):
        fold(applied.where(part), min(number, 1))
    got = {(r.account, r.paid_until) for r in BucketTable(spark, target, "account", 16).read(PAID).collect()}
    assert got == {(r.account, r.paid_until) for r in usage.paid_state(applied).collect()}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    target = str(tmp_path / "paid")
    fold, t = ledgers.upsert_paid(target, buckets=64), BucketTable(spark, target, "account", 64)
    made = lambda df, until, at: df.select(F.col("id").alias("account"), F.lit(until).cast("long").alias("paid_until"), F.lit(at).cast("long").alias("paid_read_at"))
    fold(made(spark.range(1_000_000), 1, 1), 0)
    few = made(spark.createDataFrame([(k * 99_991,) for k in range(10)], "id long"), 2, 2)
    fold(few, 1)
    assert 1 <= len(list((tmp_path / "paid/batch=1").glob("bucket=*"))) <= 10
    assert t.read(PAID).count() == 1_000_000 and t.read(PAID).where("paid_until = 2").count() == 10
    # a batch that broke off before its commit is not read, and is written over
    made(spark.range(5), 9, 9).withColumn("bucket", t.bucket()).write.partitionBy("bucket").parquet(f"{target}/batch=2")
    assert t.read(PAID).where("paid_until = 9").count() == 0
    fold(made(spark.createDataFrame([(3,)], "id long"), 0, 0), 2)
    assert t.read(PAID).count() == 1_000_000 and t.read(PAID).where("paid_until = 2").count() == 10 and t.read(PAID, 0).where("paid_until = 2").count() == 0
    t.forget(1)
    assert t.commits() == [2] and t.read(PAID).where("paid_until = 2").count() == 10
