"""Streams give the rows of the batch operators."""

import json
import random

from conftest import SF
from pyspark.sql import functions as F

from stmtspark.plans import accounts_queries as Q
from stmtspark.streaming import events as E


def attempts(spark):
    rows = [(i, i % 3, i * 20_000_000, i % 7 == 0, i % 11 == 0) for i in range(120)]
    return spark.createDataFrame(rows, "event_id long, user_id long, t long, ok boolean, expired boolean")


def test_lockouts_stream_equals_batch(spark, tmp_path):
    df = attempts(spark)
    for k in range(3):
        df.filter((F.col("event_id") >= k * 40) & (F.col("event_id") < k * 40 + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = E.fold_stream(stream, ["user_id"], E.lockout_step, E.LOCK_START, E.LOCK_ADDED, E.LOCK_STATE)
    q = out.writeStream.format("memory").queryName("locked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("locked").select("event_id", "result", "failed").collect())
    want = sorted(tuple(r) for r in E.lockouts(df).select("event_id", "result", "failed").collect())
    assert got == want and {r[1] for r in want} >= {"ok", "lock", "locked", "failed", "expired"}


def in_batches(spark, df, folder, parts=2):
    """``df`` as a stream of ``parts`` micro-batches in event_id order."""
    n = -(-df.count() // parts)
    for k in range(parts):
        df.filter((F.col("event_id") >= k * n) & (F.col("event_id") < (k + 1) * n)).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def rows_of(out, name, folder):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return out.sparkSession.table(name)


def test_credit_and_claim_streams_equal_batch(spark, tmp_path):
    n = 90
    uploads = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.col("id").alias("t"), (F.col("id") % 7).alias("pages"), (F.col("id") % 4 != 0).alias("ok"), F.lit(60).cast("long").alias("page_limit"), F.lit(False).alias("staff"))
    claims = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 11).cast("string").alias("order_id"), F.col("id").alias("t"), F.when(F.col("id") % 2 == 0, "order.paid").otherwise("payment.failed").alias("kind"))
    cases = [
        (uploads, ["user_id"], E.credit_step, E.CREDIT_START, E.CREDIT_ADDED, E.CREDIT_STATE, None),
        (claims, ["order_id"], E.claim_step, E.CLAIM_START, E.CLAIM_ADDED, E.CLAIM_STATE, 3_600_000),
    ]
    for k, (df, keys, step, start, added, state, idle) in enumerate(cases):
        folder = tmp_path / str(k)
        got = rows_of(E.fold_stream(in_batches(spark, df, folder), keys, step, start, added, state, idle), f"case{k}", folder)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.fold(df, keys, step, start, added).collect()))


def test_sessions_stream_equals_batch(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id") * 600 + F.floor(F.col("id") / 20) * 20_000).alias("ts"))
    late = spark.range(60, 61).select(F.col("id").alias("event_id"), F.lit(9).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(10_000_000)).alias("ts"))
    got = rows_of(E.sessionize(in_batches(spark, df.union(late), tmp_path), watermark="1 minute"), "sessions", tmp_path)
    key = lambda t: sorted(map(tuple, t.filter("user_id < 9").select("user_id", "started", "ended", "events").collect()))
    assert key(got) == key(E.sessionize(df)) and len(key(got)) == 6


def test_statements_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "statement_id string, n int")
    df.write.parquet(str(tmp_path / "in"))
    q = E.stream_statements(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b: b.groupBy("statement_id").count(), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_partitioning_does_not_matter(spark):
    df = attempts(spark)
    a = sorted(map(tuple, E.lockouts(df).collect()))
    b = sorted(map(tuple, E.lockouts(df.repartition(7)).collect()))
    assert a == b


def sign_ins(spark, n=600):
    """Events of many numbers that come and go: each number's last event is long before the log's end."""
    rng, rows = random.Random(12), []
    for i in range(n):
        mobile = i * 40 // n  # numbers follow one another
        kind = rng.choice(["send", "send", "verify", "verify", "password", "register"])
        purpose = "login" if kind == "password" else "register" if kind == "register" else rng.choice(["login", "register"])
        rows.append((i, f"9{mobile:09d}", kind, purpose, (i + 60) * 60 * E.SECOND, rng.random() < 0.6))
    known = spark.createDataFrame([(f"9{m:09d}",) for m in range(0, 40, 2)] + [(None,)], "mobile string")
    return spark.createDataFrame(rows, "event_id long, mobile string, kind string, purpose string, t long, ok boolean"), known


def test_sign_in_stream_equals_batch_and_state_is_bounded(spark, tmp_path):
    own = spark.newSession()
    for key, value in {**Q.STATE_STORE, "spark.sql.shuffle.partitions": "2"}.items():
        own.conf.set(key, value)
    df, known = sign_ins(own)
    want = {r["event_id"]: r["result"] for r in E.sign_in(df, known).collect()}
    assert set(want.values()) >= {"sent", "wait", "undelivered", "unregistered", "registered", "failed", "ok", "expired", "verified", "unverified", "created"}
    arriving = E.with_accounts(in_batches(own, df, tmp_path, parts=4), known)
    out = E.fold_expiring(arriving, ["mobile"], E.sign_in_step, E.SIGN_START, E.SIGN_ADDED, E.SIGN_STATE, E.sign_in_end)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r["event_id"]: r["result"] for r in own.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
    # numbers that ended long ago have no state but for accounts made and failures counted
    kept = E.sign_in(df, known).groupBy("mobile").agg(F.max(F.col("result") == "created").alias("made"), F.max_by("failed", "event_id").alias("failed")).filter("made OR failed > 0").count()
    rows = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if json.loads(p.json)["stateOperators"]]
    assert rows and rows[-1] < 3 * (kept + 12)  # a value and its timer for each number


def test_verified_mark_has_its_own_clock():
    step = lambda s, kind, purpose, minute, ok=True: E.sign_in_step(s, {"known": False, "kind": kind, "purpose": purpose, "t": minute * 60 * E.SECOND, "ok": ok})
    s, got = step(E.SIGN_START, "send", "register", 0)
    s, got = step(s, "verify", "register", 4)
    assert got == {"result": "verified", "failed": 0, "marked": True}
    assert step(s, "register", "register", 19)[1]["result"] == "created" and step(s, "register", "register", 20)[1]["result"] == "verification_expired"
    again, got = step(s, "send", "register", 5)
    assert got["result"] == "sent" and step(again, "register", "register", 6)[1]["result"] == "unverified"
    lost, got = step(s, "send", "register", 5, ok=False)
    assert got["result"] == "undelivered" and step(lost, "verify", "register", 6)[1]["result"] == "expired"


def test_login_codes_outlive_wrong_guesses_but_lock_the_account():
    known = lambda s, kind, minute, ok=True: E.sign_in_step(s, {"known": True, "kind": kind, "purpose": "login", "t": int(minute * 60 * E.SECOND), "ok": ok})
    s, _ = known(E.SIGN_START, "send", 0)
    results = []
    for minute, kind, ok in [(1, "verify", False), (1.1, "password", False), (1.2, "verify", False), (1.3, "send", True), (1.4, "verify", True), (4.3, "verify", True), (4.4, "verify", True)]:
        s, got = known(s, kind, minute, ok)
        results.append(got["result"])
    assert results == ["failed", "failed", "lock", "locked", "locked", "ok", "expired"]


def test_settled_orders_survive_replays(spark, tmp_path):
    orders = spark.createDataFrame([(f"P{i}", f"U{i % 3}", "starter" if i % 4 else "odd", 100, "created" if i % 5 else "amount_mismatch") for i in range(20)], "order_id string, user_id string, plan string, amount long, status string")
    users, plans = spark.createDataFrame([("U0",), ("U1",)], "id string"), spark.createDataFrame([("starter",)], "plan string")
    events = spark.range(120).select(
        F.col("id").alias("event_id"), F.col("id").alias("t"), F.when(F.col("id") % 3 == 0, "payment.failed").when(F.col("id") % 3 == 1, "order.paid").otherwise("payment.captured").alias("kind"),
        F.concat(F.lit("P"), (F.col("id") * 7 % 23).cast("string")).alias("order_id"), F.when(F.col("id") % 11 == 0, 1).otherwise(100).cast("long").alias("amount"), F.concat(F.lit("pay"), "id").alias("payment_id"), F.when(F.col("id") % 2 == 0, "declined").alias("failure"),
    )
    columns = ["order_id", "status", "payment_id", "paid_t", "last_failure", "last_failed_t"]
    want = sorted(map(tuple, E.settle_payments(orders, events, users, plans).select(*columns).collect()))
    stream = in_batches(spark, events, tmp_path, parts=4)
    for run in range(2):  # the second run forgets what it has read and gets every event again
        E.settle_stream(orders, stream, users, plans, str(tmp_path / "changes"), str(tmp_path / f"cp{run}")).trigger(availableNow=True).start().awaitTermination(240)
        assert sorted(map(tuple, E.settled_orders(orders, str(tmp_path / "changes")).select(*columns).collect())) == want
    assert {r[1] for r in want} >= {"fulfilled", "needs_review", "amount_mismatch"}


def test_arriving_parts_are_written_by_all_tasks(spark, tmp_path):
    """Each part comes as one micro-batch in the order of t, from as many files as there are tasks, and an empty part shifts nothing."""
    from stmtspark.plans import accounts_queries as Q

    got: list[list[int]] = []
    t = spark.createDataFrame([(i,) for i in (*range(10), *range(90, 100))], "t long").repartition(4)
    see = lambda batch, _: got.append(sorted(r["t"] for r in batch.collect()))
    Q._arriving(spark, t, str(tmp_path), lambda arriving: arriving.writeStream.foreachBatch(see).option("checkpointLocation", f"{tmp_path}/state"))
    assert [g for g in got if g] == [list(range(10)), list(range(90, 100))]
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 3
