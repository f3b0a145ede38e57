"""Event-log operators: sessions, lockouts, code throttling, payments, plans and page credit.

Rules that look at the whole past of a key are step functions over its events in (ts, event_id)
order.  In batch they run over rows partitioned and sorted by key, so a task holds one state and one
Arrow batch, however long a key's log is; on a stream the same step runs with keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

SECOND = 1_000_000
# Lockout, code and plan rules.
MAX_FAILURES, LOCK = 3, 180 * SECOND
COOLDOWN, SEND_WINDOW, MAX_SENDS, CODE_TTL, MAX_GUESSES, MARK_TTL = 120 * SECOND, 3600 * SECOND, 5, 300 * SECOND, 5, 900 * SECOND
PLAN_DAYS, FREE_PAGES = 365, 100
CLAIMS = ["payment.captured", "order.paid"]

Step = Callable[[tuple, dict], tuple[tuple, dict]]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def sessionize(activity: DataFrame, gap: str = "60 minutes", watermark: str | None = None) -> DataFrame:
    """(user_id, started, ended, events): requests of a user no more than ``gap`` apart; works on streams."""
    t = activity.withWatermark("ts", watermark) if watermark else activity
    return t.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("ended")).select("user_id", F.col("w.start").alias("started"), "ended", "events")


def fold(df: DataFrame, keys: list[str], step: Step, start: tuple, added: str) -> DataFrame:
    """``df`` with the columns of ``added``: ``step`` over each key's rows in (t, event_id) order.

    ``step`` takes the state and a row as a dict, and gives the new state and the added values.
    """
    added_type = StructType.fromDDL(added)
    names = [f.name for f in added_type.fields]
    schema = StructType([*df.schema.fields, *added_type.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, start
        for batch in batches:
            out: list[list] = [[] for _ in names]
            columns = list(batch.columns)
            for values in batch.itertuples(index=False, name=None):
                row = dict(zip(columns, values, strict=True))
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, start
                state, got = step(state, row)
                for o, n in zip(out, names, strict=True):
                    o.append(got[n])
            yield batch.assign(**{n: pd.Series(o, index=batch.index, dtype=object) for n, o in zip(names, out, strict=True)})

    return df.repartition(*keys).sortWithinPartitions(*keys, "t", "event_id").mapInPandas(run, schema)


def fold_stream(df: DataFrame, keys: list[str], step: Step, start: tuple, added: str, state: str, idle_ms: int | None = None) -> DataFrame:
    """``fold`` on a stream: the state of a key is kept between micro-batches, rows in order within one.

    With ``idle_ms`` a key that gets no row for so long loses its state and begins anew; choose a time
    after which the rule's own windows have passed.
    """
    added_type = StructType.fromDDL(added)
    names = [f.name for f in added_type.fields]
    schema = StructType([*df.schema.fields, *added_type.fields])

    def run(_: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = tuple(held.get) if held.exists else start
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["t", "event_id"], ignore_index=True)
        out: list[list] = [[] for _ in names]
        columns = list(rows.columns)
        for values in rows.itertuples(index=False, name=None):
            now, got = step(now, dict(zip(columns, values, strict=True)))
            for o, n in zip(out, names, strict=True):
                o.append(got[n])
        held.update(now)
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield rows.assign(**{n: pd.Series(o, dtype=object) for n, o in zip(names, out, strict=True)})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, schema, StructType.fromDDL(state), "append", timeout)


def fold_expiring(df: DataFrame, keys: list[str], step: Step, start: tuple, added: str, state: str, expires: Callable[[tuple], int | None], delay: str = "10 minutes") -> DataFrame:
    """``fold`` on a stream, with a timer in event time for each key.

    ``expires`` gives the microsecond from which on a state says no more than ``start`` does, or null for one
    that must be kept; when the watermark (``delay`` behind the latest t) has passed it, the key's state goes.  Rows
    that come later than the watermark are left out.  The session needs the RocksDB state store:
    spark.sql.streaming.stateStore.providerClass names
    org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    added_type = StructType.fromDDL(added)
    names = [f.name for f in added_type.fields]
    columns = [f.name for f in df.schema.fields]
    state_type = StructType.fromDDL(state)

    class Fold(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", state_type)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now = tuple(self.held.get()) if self.held.exists() else start
            t = pd.concat(list(rows), ignore_index=True).sort_values(["t", "event_id"], ignore_index=True)
            out: list[list] = [[] for _ in names]
            for values in t[columns].itertuples(index=False, name=None):
                now, got = step(now, dict(zip(columns, values, strict=True)))
                for o, n in zip(out, names, strict=True):
                    o.append(got[n])
            self.held.update(now)
            self._wake(now)
            yield t[columns].assign(**{n: pd.Series(o, dtype=object) for n, o in zip(names, out, strict=True)})

        def _wake(self, now: tuple) -> None:
            """One timer for each key, at the end of its state."""
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            end = expires(now)
            if end is not None:
                self.handle.registerTimer(-(-end // 1000) + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.held.clear()
            return iter(())

        def close(self) -> None:
            pass

    timed = df.withColumn("_at", F.timestamp_micros("t")).withWatermark("_at", delay)
    schema = StructType([*df.schema.fields, *added_type.fields])
    return timed.groupBy(*keys).transformWithStateInPandas(Fold(), schema, "Append", "EventTime")


# --- lockouts: t, ok, expired -> result ------------------------------------------------------

LOCK_START, LOCK_STATE, LOCK_ADDED = (0, -1), "failed int, lock_until long", "result string, failed int"


def lockout_step(state: tuple, e: dict) -> tuple[tuple, dict]:
    """Three failures in a row lock for three minutes; refused attempts and expired codes do not count."""
    failed, until = state
    if until >= 0 and (until - e["t"]) // SECOND > 0:
        return state, {"result": "locked", "failed": failed}
    if e["expired"]:
        return state, {"result": "expired", "failed": failed}
    if e["ok"]:
        return (0, -1), {"result": "ok", "failed": 0}
    if failed + 1 >= MAX_FAILURES:
        return (0, int(e["t"]) + LOCK), {"result": "lock", "failed": 0}
    return (failed + 1, -1), {"result": "failed", "failed": failed + 1}


def lockout_end(state: tuple) -> int | None:
    """Failures are kept; a lock can go once it is over."""
    return None if state[0] else max(state[1], 0)


def lockouts(attempts: DataFrame) -> DataFrame:
    """``attempts`` (event_id, user_id, t, ok, expired) with result and the failures counted so far."""
    return fold(attempts, ["user_id"], lockout_step, LOCK_START, LOCK_ADDED)


# --- code sends: t, delivered -> result -------------------------------------------------------

SEND_START, SEND_STATE, SEND_ADDED = (-1, -1, 0), "last_sent long, window_start long, sends int", "result string, sends int"


def send_step(state: tuple, e: dict) -> tuple[tuple, dict]:
    """Two minutes between sends, five sends in a fixed hour; a failed delivery is given back."""
    last, start, sends = state
    t = int(e["t"])
    if last >= 0 and (last + COOLDOWN - t) // SECOND > 0:
        return state, {"result": "wait", "sends": sends}
    if start < 0 or t - start >= SEND_WINDOW:
        start, sends = t, 0
    if sends >= MAX_SENDS:
        return state, {"result": "too_many", "sends": sends}
    if not e["delivered"]:
        return (-1, start, sends), {"result": "undelivered", "sends": sends}
    return (t, start, sends + 1), {"result": "sent", "sends": sends + 1}


def send_end(state: tuple) -> int | None:
    """After the hour and the pause a number begins anew."""
    last, start, _ = state
    return max(last + COOLDOWN, start + SEND_WINDOW)


def otp_throttle(requests: DataFrame) -> DataFrame:
    """``requests`` (event_id, mobile, purpose, t, delivered) with result and sends in the window."""
    return fold(requests, ["mobile", "purpose"], send_step, SEND_START, SEND_ADDED)


# --- code checks: purpose, kind (send/verify), t, ok -> result --------------------------------

CODE_START, CODE_STATE, CODE_ADDED = (-1, 0), "expires long, guesses int", "result string"


def verify_step(state: tuple, e: dict) -> tuple[tuple, dict]:
    """The latest code holds for five minutes and works once; one for signing up dies at the fifth wrong guess.

    Wrong guesses at a sign-in code are the account's failures (``sign_in_step``), so they leave the code as it is.
    """
    expires, guesses = state
    t = int(e["t"])
    if e["kind"] == "send":
        return (t + CODE_TTL, 0), {"result": "sent"}
    if expires < 0 or expires <= t:
        return state, {"result": "expired"}
    if e["ok"]:
        return (-1, guesses), {"result": "verified"}
    if e["purpose"] != "register":
        return state, {"result": "wrong"}
    if guesses + 1 >= MAX_GUESSES:
        return (-1, guesses + 1), {"result": "burnt"}
    return (expires, guesses + 1), {"result": "wrong"}


def otp_verify(events: DataFrame) -> DataFrame:
    """``events`` (event_id, mobile, purpose, kind, t, ok), sends and guesses together, with result."""
    return fold(events, ["mobile", "purpose"], verify_step, CODE_START, CODE_ADDED)


# --- signing in and up: known, kind, purpose, t, ok -> result ----------------------------------

#: joined: an account made by the log itself; mark: when the number was verified; -1 is never.
SIGN_STATE = (
    "joined boolean, failed int, lock_until long, login_expires long, login_last long, login_start long, login_sends int, "
    "expires long, last long, start long, sends int, guesses int, mark long"
)
SIGN_START = (False, 0, -1, -1, -1, -1, 0, -1, -1, -1, 0, 0, -1)
SIGN_ADDED = "result string, failed int, marked boolean"


def sign_in_step(state: tuple, e: dict) -> tuple[tuple, dict]:
    """One number's account, its sign-in code and its sign-up code, by five kinds of events.

    send (purpose, ok: delivered) asks for a code: to sign in an account must be there and not locked, to sign
    up none may be.  verify (purpose, ok: the right code): a wrong sign-in code counts as a failure of the account
    like a wrong password; the fifth wrong sign-up code ends that code, the right one marks the number as
    verified.  password (ok).  register makes an account of a number whose mark is 15 minutes old at most.
    A new code takes the mark away, and a code that could not be delivered is withdrawn, as is its send.
    """
    joined, failed, until, *codes = state
    login, signup, (guesses, mark) = tuple(codes[:4]), tuple(codes[4:8]), codes[8:]
    t, kind, register = int(e["t"]), e["kind"], e["purpose"] == "register"
    account = bool(e["known"]) or joined
    result = None
    if kind == "register" or (register and kind in ("send", "verify")):
        result = "registered" if account else None
    elif not account:
        result = "unregistered"
    elif until >= 0 and (until - t) // SECOND > 0:
        result = "locked"
    if result is None and kind == "send":
        expires, last, start, sends = signup if register else login
        (last, start, sends), got = send_step((last, start, sends), {"t": t, "delivered": e["ok"]})
        result = got["result"]
        if result in ("sent", "undelivered"):
            own = (t + CODE_TTL if result == "sent" else -1, last, start, sends)
            if register:
                signup, guesses, mark = own, 0, -1
            else:
                login = own
    elif result is None and kind == "register":
        result = "unverified" if mark < 0 else "verification_expired" if t - mark > MARK_TTL else "created"
        if result == "created":
            joined, signup, guesses, mark = True, (-1, -1, -1, 0), 0, -1
    elif result is None and kind == "verify" and register:
        (expires, guesses), got = verify_step((signup[0], guesses), {"kind": kind, "purpose": "register", "t": t, "ok": e["ok"]})
        signup, result = (expires, *signup[1:]), got["result"]
        mark = t if result == "verified" else mark
    elif result is None:
        live = kind == "password" or login[0] > t
        (failed, until), got = lockout_step((failed, until), {"t": t, "expired": not live, "ok": e["ok"]})
        result = got["result"]
        if result == "ok" and kind == "verify":
            login = (-1, *login[1:])
    return (joined, failed, until, *login, *signup, guesses, mark), {"result": result, "failed": failed, "marked": 0 <= mark and t - mark <= MARK_TTL}


def sign_in_end(state: tuple) -> int | None:
    """Accounts made here and counted failures are kept; codes, pauses, marks and locks go an hour after the last send."""
    joined, failed, until, _, login_last, login_start, _, _, last, start, _, _, mark = state
    if joined or failed:
        return None
    return max(0, until, login_last + SEND_WINDOW, login_start + SEND_WINDOW, last + SEND_WINDOW, start + SEND_WINDOW, mark + MARK_TTL)


def with_accounts(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """``events`` with known: whether the mobile is one of ``accounts`` (mobile); works on streams."""
    known = accounts.filter("mobile IS NOT NULL").select("mobile").distinct().withColumn("_known", F.lit(True))
    return events.join(known, "mobile", "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def sign_in(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """``events`` (event_id, mobile, kind, purpose, t, ok) of valid numbers with known, result, failed and marked."""
    return fold(with_accounts(events, accounts), ["mobile"], sign_in_step, SIGN_START, SIGN_ADDED)


def valid_code(sends: DataFrame, verifies: DataFrame) -> DataFrame:
    """``verifies`` with sent_t and in_time: the as-of join of each guess with the latest send before it."""
    both = sends.select("mobile", "purpose", "t", "event_id", F.lit(0).alias("side")).union(verifies.select("mobile", "purpose", "t", "event_id", F.lit(1)))
    own = Window.partitionBy("mobile", "purpose").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = both.withColumn("sent_t", F.last(F.when(F.col("side") == 0, F.col("t")), ignorenulls=True).over(own)).filter("side = 1")
    return t.select("event_id", "mobile", "purpose", "t", "sent_t", F.coalesce(F.col("sent_t") + CODE_TTL > F.col("t"), F.lit(False)).alias("in_time"))


# --- payments ---------------------------------------------------------------------------------


def fulfil_payments(orders: DataFrame, events: DataFrame, users: DataFrame, plans: DataFrame) -> DataFrame:
    """Every claim with its outcome: the first event of a created order wins it.

    ``orders``: order_id, user_id, plan, amount, status; ``events``: event_id, t, kind, order_id, amount.
    """
    own = Window.partitionBy("order_id").orderBy("t", "event_id")
    claims = events.filter(F.col("kind").isin(CLAIMS)).withColumn("n", F.row_number().over(own))
    o = orders.select("order_id", "user_id", "plan", F.col("amount").alias("due"), F.col("status").alias("was"))
    t = claims.join(o, "order_id", "left")
    t = t.join(users.select(F.col("id").alias("user_id"), F.lit(True).alias("known_user")), "user_id", "left").join(F.broadcast(plans.select("plan", F.lit(True).alias("known_plan"))), "plan", "left")
    status = (
        F.when(F.col("was").isNull(), "unknown_order")
        .when((F.col("was") != "created") | (F.col("n") > 1), "already_fulfilled")
        .when(F.col("amount").isNotNull() & (F.col("amount") != F.col("due")), "amount_mismatch")
        .when(F.col("known_plan").isNull() | F.col("known_user").isNull(), "needs_review")
        .otherwise("fulfilled")
    )
    return t.select("event_id", "order_id", "user_id", "t", status.alias("outcome"))


CLAIM_START, CLAIM_STATE, CLAIM_ADDED = (False,), "claimed boolean", "wins boolean"


def claim_step(state: tuple, e: dict) -> tuple[tuple, dict]:
    """The first claim of an order wins it; other kinds of events claim nothing."""
    claim = e["kind"] in CLAIMS
    return (state[0] or claim,), {"wins": claim and not state[0]}


def settle_payments(orders: DataFrame, events: DataFrame, users: DataFrame, plans: DataFrame) -> DataFrame:
    """Orders after all events: status, payment_id and paid_t of the winning claim, and the last failure before it.

    ``events`` as for ``fulfil_payments``, with payment_id and failure (a text or null).  A failed payment
    leaves a created order as it is, so that it can be paid later.
    """
    won = fulfil_payments(orders, events, users, plans).filter("outcome NOT IN ('unknown_order', 'already_fulfilled')")
    won = won.join(events.select("event_id", "payment_id"), "event_id").select("order_id", F.col("outcome").alias("_status"), F.col("payment_id").alias("_payment_id"), F.col("t").alias("_paid_t"), F.col("event_id").alias("_paid_by"))
    t = orders.join(won, "order_id", "left")
    failed = events.filter("kind = 'payment.failed'").select("order_id", F.struct("t", "event_id").alias("_at"), F.coalesce("failure", F.lit("Payment failed")).alias("_why"))
    open_then = (F.col("status") == "created") & (F.col("_paid_t").isNull() | (F.col("_at") < F.struct(F.col("_paid_t").alias("t"), F.col("_paid_by").alias("event_id"))))
    last = t.select("order_id", "status", "_paid_t", "_paid_by").join(failed, "order_id").filter(open_then).groupBy("order_id").agg(F.max_by("_why", "_at").alias("last_failure"), F.max("_at.t").alias("last_failed_t"))
    kept = [c for c in orders.columns if c not in ("status", "payment_id", "paid_t", "last_failure", "last_failed_t")]
    return t.join(last, "order_id", "left").select(*kept, F.coalesce("_status", "status").alias("status"), F.col("_payment_id").alias("payment_id"), F.col("_paid_t").alias("paid_t"), "last_failure", "last_failed_t")


SETTLED = "order_id string, status string, payment_id string, paid_t long, last_failure string, last_failed_t long"


def settled_orders(orders: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """``orders`` with the changes that ``settle_stream`` has written under ``path`` (by batches under ``before``)."""
    spark = orders.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    changes = spark.read.schema(SETTLED + ", batch long").parquet(path) if there else spark.createDataFrame([], SETTLED + ", batch long")
    if before is not None:
        changes = changes.filter(F.col("batch") < before)
    last = changes.groupBy("order_id").agg(F.max_by(F.struct(*[F.col(c).alias(f"_{c}") for c in ("status", "payment_id", "paid_t", "last_failure", "last_failed_t")]), "batch").alias("_c"))
    t = orders.join(last, "order_id", "left")
    kept = [c for c in orders.columns if c not in ("status", "payment_id", "paid_t", "last_failure", "last_failed_t")]
    return t.select(*kept, F.coalesce("_c._status", "status").alias("status"), *[F.col(f"_c._{c}").alias(c) for c in ("payment_id", "paid_t", "last_failure", "last_failed_t")])


def settle_stream(orders: DataFrame, events: DataFrame, users: DataFrame, plans: DataFrame, path: str, checkpoint: str):
    """Settle payments as their events arrive: each micro-batch writes the orders that it changes.

    A batch starts from the changes of the batches before it and writes to a folder of its own number, so a batch
    that runs again gives the same orders, and an event that comes again finds its order settled.
    """

    def write(batch: DataFrame, number: int) -> None:
        touched = batch.select("order_id").filter("order_id IS NOT NULL").distinct()
        now = settled_orders(orders.join(touched, "order_id", "left_semi"), path, number)
        done = settle_payments(now.drop("payment_id", "paid_t", "last_failure", "last_failed_t"), batch, users, plans)
        old = now.select("order_id", F.col("payment_id").alias("_p"), F.col("paid_t").alias("_t"), F.col("last_failure").alias("_f"), F.col("last_failed_t").alias("_ft"))
        done = done.join(old, "order_id").select("order_id", "status", F.coalesce("payment_id", "_p").alias("payment_id"), F.coalesce("paid_t", "_t").alias("paid_t"), F.coalesce("last_failure", "_f").alias("last_failure"), F.coalesce("last_failed_t", "_ft").alias("last_failed_t"))
        done.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def plan_ledger(fulfilled: DataFrame, now_t: int) -> DataFrame:
    """(user_id, purchases, page_limit, expires_t, active): purchases that follow before the last expires add up."""
    year = PLAN_DAYS * 86400 * SECOND
    own = Window.partitionBy("user_id").orderBy("t", "order_id")
    new = F.coalesce(F.col("t") - F.lag("t").over(own) >= year, F.lit(True)).cast("int")
    t = fulfilled.withColumn("new", new)
    t = t.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = t.groupBy("user_id", "island").agg(F.count("*").alias("purchases"), F.sum("pages").alias("pages"), (F.max("t") + year).alias("expires_t"))
    last = runs.groupBy("user_id").agg(F.max_by(F.struct("purchases", "pages", "expires_t"), "island").alias("r"))
    active = F.col("r.expires_t") > now_t
    return last.select("user_id", F.col("r.purchases").alias("purchases"), (FREE_PAGES + F.when(active, F.col("r.pages")).otherwise(0)).alias("page_limit"), F.col("r.expires_t").alias("expires_t"), active.alias("active"))


# --- page credit ------------------------------------------------------------------------------

CREDIT_START, CREDIT_STATE, CREDIT_ADDED = (0,), "used long", "result string, used long"


def credit_step(state: tuple, e: dict) -> tuple[tuple, dict]:
    """An upload must fit the pages that are left; only good conversions are charged; staff is never refused."""
    used, left = state[0], int(e["page_limit"]) - state[0]
    if not e["staff"] and left <= 0:
        return state, {"result": "PAGE_LIMIT_REACHED", "used": used}
    if not e["staff"] and e["pages"] > left:
        return state, {"result": "INSUFFICIENT_PAGES", "used": used}
    if not e["ok"]:
        return state, {"result": "failed", "used": used}
    return (used + int(e["pages"]),), {"result": "charged", "used": used + int(e["pages"])}


def credit_gate(uploads: DataFrame) -> DataFrame:
    """``uploads`` (event_id, user_id, t, pages, ok, page_limit, staff) with result and pages used."""
    return fold(uploads, ["user_id"], credit_step, CREDIT_START, CREDIT_ADDED)


# --- statements as they arrive ----------------------------------------------------------------


def stream_statements(cells: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Parse the statements of each micro-batch with the batch plan; a statement arrives as one unit.

    A batch's folder is named by its number and overwritten, so a repeated batch writes no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
