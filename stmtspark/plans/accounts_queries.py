"""Queries of the account, payment and event operators.

The account tables are derived from the driver's tables by SQL that both engines run, so the oracles
share the derivation and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stmtspark.functions import cells as C
from stmtspark.operators import accounts, routing
from stmtspark.plans import layout_queries
from stmtspark.plans.fixtures import table
from stmtspark.sources import tables as sources
from stmtspark.streaming import events as E

USERS = """SELECT 'U' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE '9' || lpad(CAST(c_custkey AS STRING), 9, '0') END AS mobile,
  CASE WHEN c_custkey % 50 = 1 THEN 'admin' WHEN c_custkey % 50 = 2 THEN 'salesperson' WHEN c_custkey % 50 = 4 THEN 'super_admin' WHEN c_custkey % 3 = 0 THEN NULL ELSE 'user' END AS role,
  c_custkey % 50 = 5 AS is_super_admin, c_custkey % 50 = 6 AS is_admin, c_custkey % 240 AS pages_used,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 600 ELSE 100 END AS page_limit,
  CAST('2024-01-01' AS DATE) + CAST(c_custkey % 300 AS INT) AS created_at FROM customer"""
STATEMENTS = """SELECT 'D' || o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'gone' || o_custkey ELSE 'U' || o_custkey END AS user_id,
  'file' || o_orderkey || '.pdf' AS filename, CASE WHEN o_orderkey % 2 = 0 THEN 'hdfc' ELSE 'pnb' END AS bank, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'success' END AS status,
  o_orderkey % 40 AS row_count, 1 + o_orderkey % 7 AS page_count, CASE WHEN o_orderkey % 23 = 0 THEN 'Stamped ' || o_custkey END AS owner_name, CASE WHEN o_orderkey % 23 = 0 THEN '8' || lpad(CAST(o_custkey AS STRING), 9, '0') END AS owner_mobile,
  CASE WHEN o_orderkey % 23 = 0 THEN true END AS owner_deleted,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 10 = 0 THEN 'open' ELSE 'resolved' END END AS issue_status, CASE WHEN o_orderkey % 15 = 0 THEN 'N' || o_orderkey END AS issue_number,
  CAST(o_orderdate AS DATE) AS created_at FROM orders"""
MESSAGES = """SELECT 'M' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'contactus' WHEN event_id % 3 = 1 THEN 'demo' END AS source,
  CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN NULL ELSE '9' || lpad(CAST(user_id AS STRING), 9, '0') END AS phone,
  CASE WHEN event_id % 4 = 0 THEN 'closed' WHEN event_id % 4 = 1 THEN NULL ELSE 'open' END AS status, CASE WHEN event_id % 5 = 0 THEN 'U2' ELSE 'U52' END AS salesperson_id, CAST(ts AS DATE) AS created_at FROM events"""
PAYMENTS = """SELECT 'P' || o_orderkey AS order_id, 'U' || o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'starter' ELSE 'growth' END AS plan, CASE WHEN o_orderkey % 2 = 0 THEN 500 ELSE 2000 END AS pages,
  CASE WHEN o_orderkey % 2 = 0 THEN 99900 ELSE 249900 END AS base_paise, CASE WHEN o_orderkey % 2 = 0 THEN 17982 ELSE 44982 END AS gst_paise, CASE WHEN o_orderkey % 2 = 0 THEN 117882 ELSE 294882 END AS amount,
  CASE o_orderkey % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'amount_mismatch' ELSE 'fulfilled' END AS status, CAST(o_orderdate AS DATE) AS created_at FROM orders"""
WITH = f"WITH users AS ({USERS}), statements AS ({STATEMENTS}), messages AS ({MESSAGES}), payments AS ({PAYMENTS})"
ROLE = "CASE WHEN role IN ('super_admin', 'admin', 'salesperson', 'user') THEN role WHEN coalesce(is_super_admin, false) THEN 'super_admin' WHEN coalesce(is_admin, false) THEN 'admin' ELSE 'user' END"
HIDDEN = "(coalesce(role, '') = 'super_admin' OR coalesce(is_super_admin, false))"


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("customer", "orders", "events"):
        if f"FROM {name}" in sql:
            return spark.sql(sql.replace(f"FROM {name}", "FROM {given}"), given=table(spark, sf_dir, name))
    raise ValueError(sql)


def users(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, USERS)


def statements(spark: SparkSession, d: str) -> DataFrame:
    issue = F.when(F.col("issue_status").isNotNull(), F.struct(F.col("issue_number").alias("number"), F.concat(F.lit("title "), "id").alias("title"), F.col("issue_status").alias("status"), F.col("created_at").alias("created_at")))
    return derived(spark, d, STATEMENTS).withColumn("issue", issue).drop("issue_number", "issue_status")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, MESSAGES)


def payments(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, PAYMENTS)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, event_type, value and t: microseconds, the log made 720 times denser."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.floor(E.micros(F.col("ts")) / 720).cast("long").alias("t"))


EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 720 AS t FROM events)"


def _folded(base: str, key: str, first: str, step: str, state: str, out: str) -> str:
    """A recursive query that carries the state from row to row of a key."""
    return f"""WITH RECURSIVE {EVENTS}, base AS ({base}), e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, event_id) AS rn FROM base),
f AS (SELECT e.*, {first} FROM e WHERE rn = 1
  UNION ALL SELECT e.*, {step} FROM f s JOIN e ON {' AND '.join(f'e.{k.strip()} = s.{k.strip()}' for k in key.split(','))} AND e.rn = s.rn + 1)
SELECT {out} FROM f"""


def r_attempts(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.col("event_type").isin("error", "purchase", "signup")
    return _events(spark, d).filter(kinds).select("event_id", "user_id", "t", (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") == "signup").alias("expired"))


ATTEMPTS = "SELECT event_id, user_id, t, event_type = 'purchase' AS ok, event_type = 'signup' AS expired FROM ev WHERE event_type IN ('error', 'purchase', 'signup')"


def _lock_result(failed: str, until: str) -> tuple[str, str, str, str]:
    locked = f"({until} >= 0 AND ({until} - e.t) // 1000000 > 0)"
    case = lambda a, b, c, x, y: f"CASE WHEN {locked} THEN {a} WHEN e.expired THEN {b} WHEN e.ok THEN {c} WHEN {failed} + 1 >= 3 THEN {x} ELSE {y} END"
    return case("'locked'", "'expired'", "'ok'", "'lock'", "'failed'"), case(failed, failed, "0", "0", f"{failed} + 1"), case(until, until, "-1", "e.t + 180000000", "-1"), ""


def _lockout_oracle() -> str:
    first, step = _lock_result("0", "(-1)::BIGINT"), _lock_result("s.failed", "s.until")
    sel = lambda x: f"{x[0]} AS result, ({x[1]})::INT AS failed, ({x[2]})::BIGINT AS until"
    return _folded(ATTEMPTS, "user_id", sel(first), sel(step), "", "event_id, user_id, t, ok, expired, result, failed")


def r_requests(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter(F.col("event_type").isin("signup", "click")).select("event_id", F.col("user_id").cast("string").alias("mobile"), F.when(F.col("event_type") == "signup", "register").otherwise("login").alias("purpose"), "t", (F.col("event_id") % 9 != 0).alias("delivered"))


REQUESTS = "SELECT event_id, CAST(user_id AS STRING) AS mobile, CASE WHEN event_type = 'signup' THEN 'register' ELSE 'login' END AS purpose, t, event_id % 9 <> 0 AS delivered FROM ev WHERE event_type IN ('signup', 'click')"


def _throttle_oracle() -> str:
    def sel(last: str, start: str, sends: str) -> str:
        wait = f"({last} >= 0 AND ({last} + 120000000 - e.t) // 1000000 > 0)"
        fresh = f"({start} < 0 OR e.t - {start} >= 3600000000)"
        now = f"(CASE WHEN {fresh} THEN 0 ELSE {sends} END)"
        case = lambda a, b, c, x: f"CASE WHEN {wait} THEN {a} WHEN {now} >= 5 THEN {b} WHEN NOT e.delivered THEN {c} ELSE {x} END"
        begun = f"CASE WHEN {fresh} THEN e.t ELSE {start} END"
        return f"{case(repr('wait'), repr('too_many'), repr('undelivered'), repr('sent'))} AS result, ({case(sends, sends, now, now + ' + 1')})::INT AS sends, ({case(last, last, '-1', 'e.t')})::BIGINT AS last_sent, ({case(start, start, begun, begun)})::BIGINT AS window_start"

    # a refused send in a window that would restart keeps the old window: with no sends it can't be refused
    return _folded(REQUESTS, "mobile, purpose", sel("(-1)::BIGINT", "(-1)::BIGINT", "0"), sel("s.last_sent", "s.window_start", "s.sends"), "", "event_id, mobile, purpose, t, delivered, result, sends")


def r_codes(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    purpose = F.when(F.col("user_id") % 2 == 0, "login").otherwise("register")
    return e.filter(F.col("event_type").isin("signup", "error", "purchase")).select("event_id", F.col("user_id").cast("string").alias("mobile"), purpose.alias("purpose"), F.when(F.col("event_type") == "signup", "send").otherwise("verify").alias("kind"), "t", (F.col("event_type") == "purchase").alias("ok"))


CODES = "SELECT event_id, CAST(user_id AS STRING) AS mobile, CASE WHEN user_id % 2 = 0 THEN 'login' ELSE 'register' END AS purpose, CASE WHEN event_type = 'signup' THEN 'send' ELSE 'verify' END AS kind, t, event_type = 'purchase' AS ok FROM ev WHERE event_type IN ('signup', 'error', 'purchase')"


def _verify_oracle() -> str:
    def sel(expires: str, guesses: str) -> str:
        case = lambda a, b, c, x, y: f"CASE WHEN e.kind = 'send' THEN {a} WHEN {expires} < 0 OR {expires} <= e.t THEN {b} WHEN e.ok THEN {c} WHEN e.purpose = 'register' AND {guesses} + 1 >= 5 THEN {x} ELSE {y} END"
        return f"{case(repr('sent'), repr('expired'), repr('verified'), repr('burnt'), repr('wrong'))} AS result, ({case('e.t + 300000000', expires, '-1', '-1', expires)})::BIGINT AS expires, ({case('0', guesses, guesses, guesses + ' + 1', guesses + ' + 1')})::INT AS guesses"

    return _folded(CODES, "mobile, purpose", sel("(-1)::BIGINT", "0"), sel("s.expires", "s.guesses"), "", "event_id, mobile, purpose, kind, t, ok, result")


def r_sign_ins(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Five kinds of events of valid numbers, four times denser; a third of the numbers have no account yet."""
    r, k = F.col("event_id") % 10, F.col("event_id")
    kind = F.when(r < 2, "send").when(r == 7, "password").when(r == 8, "register").otherwise("verify")
    purpose = F.when(r.isin(0, 2, 3, 7), "login").otherwise("register")
    ok = F.when(r < 2, k % 9 != 0).when(r < 4, k % 3 == 0).when(r < 7, F.floor(k / 10) % 7 == 0).when(r == 9, F.col("event_type") != "error").otherwise(F.col("event_type") == "purchase")
    mobile = F.concat(F.lit("9"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    e = _events(spark, d).select("event_id", mobile.alias("mobile"), kind.alias("kind"), purpose.alias("purpose"), F.floor(F.col("t") / 4).cast("long").alias("t"), ok.alias("ok"))
    return e.filter(C.valid_mobile(F.col("mobile"))), users(spark, d).filter("pages_used % 3 <> 0").select("mobile")


SIGN_INS = """SELECT event_id, '9' || lpad(user_id::VARCHAR, 9, '0') AS mobile, CASE WHEN event_id % 10 < 2 THEN 'send' WHEN event_id % 10 = 7 THEN 'password' WHEN event_id % 10 = 8 THEN 'register' ELSE 'verify' END AS kind,
  CASE WHEN event_id % 10 IN (0, 2, 3, 7) THEN 'login' ELSE 'register' END AS purpose, t // 4 AS t,
  CASE WHEN event_id % 10 < 2 THEN event_id % 9 <> 0 WHEN event_id % 10 < 4 THEN event_id % 3 = 0 WHEN event_id % 10 < 7 THEN (event_id // 10) % 7 = 0 WHEN event_id % 10 = 9 THEN event_type <> 'error' ELSE event_type = 'purchase' END AS ok FROM ev"""


def _sign_in_oracle(where: str = "true") -> str:
    """The rules in SQL: what is true before each event, its outcome, and what that leaves."""
    held = ["joined", "failed", "until", "le", "ll", "ls", "ln", "re", "rl", "rs", "rn", "guesses", "mark"]
    login, register = "purpose = 'login'", "purpose = 'register'"
    stored = "result IN ('sent', 'undelivered')"
    after = {
        "joined": "joined OR result = 'created'",
        "failed": "CASE WHEN result IN ('ok', 'lock') THEN 0 WHEN result = 'failed' THEN failed + 1 ELSE failed END",
        "until": "CASE WHEN result = 'lock' THEN t + 180000000 WHEN result IN ('ok', 'failed') THEN -1 ELSE until END",
        "le": f"CASE WHEN {login} AND result = 'sent' THEN t + 300000000 WHEN {login} AND (result = 'undelivered' OR kind = 'verify' AND result = 'ok') THEN -1 ELSE le END",
        "re": f"CASE WHEN {register} AND result = 'sent' THEN t + 300000000 WHEN {register} AND result IN ('undelivered', 'verified', 'burnt', 'created') THEN -1 ELSE re END",
        "guesses": f"CASE WHEN {register} AND {stored} OR result = 'created' THEN 0 WHEN result IN ('wrong', 'burnt') THEN guesses + 1 ELSE guesses END",
        "mark": f"CASE WHEN {register} AND {stored} OR result = 'created' THEN -1 WHEN result = 'verified' THEN t ELSE mark END",
    }
    for side, own in (("l", login), ("r", register)):
        made = " WHEN result = 'created' THEN {}" if side == "r" else ""
        after |= {
            f"{side}l": f"CASE WHEN {own} AND result = 'sent' THEN t WHEN {own} AND result = 'undelivered' THEN -1{made.format(-1)} ELSE {side}l END",
            f"{side}s": f"CASE WHEN {own} AND {stored} AND fresh THEN t{made.format(-1)} ELSE {side}s END",
            f"{side}n": f"CASE WHEN {own} AND {stored} THEN used + (result = 'sent')::INT{made.format(0)} ELSE {side}n END",
        }
    kinds = {"joined": "BOOLEAN", "failed": "INT", "guesses": "INT", "ln": "INT", "rn": "INT"}
    start = {"joined": "false", "failed": "0", "guesses": "0", "ln": "0", "rn": "0"}
    event = ["event_id", "mobile", "kind", "purpose", "t", "ok", "known", "nth"]
    return f"""WITH RECURSIVE {WITH.removeprefix('WITH ')}, {EVENTS}, base AS ({SIGN_INS}),
 e AS (SELECT b.*, b.mobile IN (SELECT mobile FROM users WHERE pages_used % 3 <> 0 AND mobile IS NOT NULL) AS known, row_number() OVER (PARTITION BY mobile ORDER BY t, event_id) AS nth FROM base b),
 f AS (SELECT NULL::BIGINT AS event_id, mobile, '' AS kind, '' AS purpose, 0::BIGINT AS t, false AS ok, false AS known, 0::BIGINT AS nth, '' AS result, {', '.join(f"{start.get(h, '-1')}::{kinds.get(h, 'BIGINT')} AS {h}" for h in held)} FROM (SELECT DISTINCT mobile FROM e)
  UNION ALL SELECT {', '.join(event)}, result, {', '.join(f"({after[h]})::{kinds.get(h, 'BIGINT')}" for h in held)} FROM (
   SELECT *, CASE WHEN {register} AND account THEN 'registered' WHEN {login} AND NOT account THEN 'unregistered' WHEN {login} AND locked THEN 'locked'
     WHEN kind = 'send' THEN CASE WHEN waits THEN 'wait' WHEN used >= 5 THEN 'too_many' WHEN NOT ok THEN 'undelivered' ELSE 'sent' END
     WHEN kind = 'register' THEN CASE WHEN mark < 0 THEN 'unverified' WHEN t - mark > 900000000 THEN 'verification_expired' ELSE 'created' END
     WHEN kind = 'verify' AND NOT live THEN 'expired' WHEN kind = 'verify' AND {register} THEN CASE WHEN ok THEN 'verified' WHEN guesses + 1 >= 5 THEN 'burnt' ELSE 'wrong' END
     WHEN ok THEN 'ok' WHEN failed + 1 >= 3 THEN 'lock' ELSE 'failed' END AS result FROM (
    SELECT *, CASE WHEN fresh THEN 0 ELSE sends END AS used FROM (
     SELECT {', '.join(f"e.{c}" for c in event)}, {', '.join(f"s.{h}" for h in held)}, e.known OR s.joined AS account, s.until >= 0 AND (s.until - e.t) // 1000000 > 0 AS locked,
      CASE WHEN e.{login} THEN s.le ELSE s.re END > e.t AS live, CASE WHEN e.{login} THEN s.ln ELSE s.rn END AS sends,
      CASE WHEN e.{login} THEN s.ls ELSE s.rs END < 0 OR e.t - CASE WHEN e.{login} THEN s.ls ELSE s.rs END >= 3600000000 AS fresh,
      CASE WHEN e.{login} THEN s.ll ELSE s.rl END >= 0 AND (CASE WHEN e.{login} THEN s.ll ELSE s.rl END + 120000000 - e.t) // 1000000 > 0 AS waits
     FROM f s JOIN e ON e.mobile = s.mobile AND e.nth = s.nth + 1))))
 SELECT event_id, mobile, kind, purpose, t, ok, known, result, failed, mark >= 0 AND t - mark <= 900000000 AS marked FROM f WHERE nth > 0 AND {where}"""


def e4_sign_in(spark: SparkSession, d: str) -> DataFrame:
    """Sign-in and sign-up together: codes, passwords, lockouts, marks and new accounts of each number."""
    return E.sign_in(*r_sign_ins(spark, d))


def e3_guarded_sends(spark: SparkSession, d: str) -> DataFrame:
    """Codes asked for, as accounts, locks, pauses and the hour allow."""
    return e4_sign_in(spark, d).filter("kind = 'send'")


#: The state store that timers in event time need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _arriving(spark: SparkSession, t: DataFrame, folder: str, start: Callable[[DataFrame], DataStreamWriter], parts: int = 3) -> None:
    """``t`` as a stream of ``parts`` micro-batches in the order of t: the files of one part, written by all tasks, then the query of ``start`` on them."""
    low, high = t.agg(F.min("t"), F.max("t")).first()
    step = ((high or 0) - (low or 0)) // parts + 1
    for k in range(parts):
        t.filter((F.col("t") - (low or 0)) >= k * step).filter((F.col("t") - (low or 0)) < (k + 1) * step).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(t.schema).parquet(f"{folder}/in")).trigger(availableNow=True).start().awaitTermination()


def e4_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same events as they arrive, in three batches, with state that expires in event time."""
    own = spark.newSession()  # settings of its own
    own.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in STATE_STORE.items():
        own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    folder = sources.scratch_folder(spark)
    t, accounts_ = r_sign_ins(own, d)
    fold = lambda arriving: E.fold_expiring(E.with_accounts(arriving, accounts_), ["mobile"], E.sign_in_step, E.SIGN_START, E.SIGN_ADDED, E.SIGN_STATE, E.sign_in_end)
    _arriving(own, t, folder, lambda arriving: fold(arriving).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append"))
    return spark.read.parquet(f"{folder}/out").select("event_id", "mobile", "kind", "purpose", "t", "ok", "known", "result", "failed", "marked")


def e5_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders after payment events that arrive in three batches."""
    orders = payments(spark, d).withColumn("status", F.when(F.col("status") == "fulfilled", "created").otherwise(F.col("status"))).select("order_id", "user_id", "plan", "amount", "status")
    plans = spark.createDataFrame([("starter",)], "plan string")
    folder = sources.scratch_folder(spark)
    _arriving(spark, _webhooks(spark, d).filter("NOT rejected"), folder, lambda arriving: E.settle_stream(orders, arriving, users(spark, d), plans, f"{folder}/changes", f"{folder}/state"))
    return E.settled_orders(orders, f"{folder}/changes").select("order_id", "status", "payment_id", "paid_t", "last_failure", "last_failed_t")


def r_uploads(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter("event_type = 'view'").select("event_id", "user_id", "t", F.ceil("value").cast("long").alias("pages"), (F.col("event_id") % 6 != 0).alias("ok"), F.lit(100).cast("long").alias("page_limit"), (F.col("user_id") % 20 == 0).alias("staff"))


UPLOADS = "SELECT event_id, user_id, t, ceil(value)::BIGINT AS pages, event_id % 6 <> 0 AS ok, 100::BIGINT AS page_limit, user_id % 20 = 0 AS staff FROM ev WHERE event_type = 'view'"


def _credit_oracle() -> str:
    def sel(used: str) -> str:
        case = lambda a, b, c, x: f"CASE WHEN NOT e.staff AND e.page_limit - {used} <= 0 THEN {a} WHEN NOT e.staff AND e.pages > e.page_limit - {used} THEN {b} WHEN NOT e.ok THEN {c} ELSE {x} END"
        return f"{case(repr('PAGE_LIMIT_REACHED'), repr('INSUFFICIENT_PAGES'), repr('failed'), repr('charged'))} AS result, ({case(used, used, used, used + ' + e.pages')})::BIGINT AS used"

    return _folded(UPLOADS, "user_id", sel("0"), sel("s.used"), "", "event_id, user_id, t, pages, ok, page_limit, staff, result, used")


def e1_sessionize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    out = E.sessionize(t)
    return out.select("user_id", E.micros(F.col("started")).alias("started"), E.micros(F.col("ended")).alias("ended"), "events")


def _webhooks(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    order = F.concat(F.lit("P"), F.floor(F.col("event_id") / 2).cast("string"))
    kind = F.when(F.col("event_type") == "purchase", "payment.captured").when(F.col("event_type") == "click", "order.paid").when(F.col("event_type") == "error", "payment.failed").otherwise("other")
    amount = F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 2 == 0, 117882).otherwise(294882)
    why = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("declined "), "event_id")).otherwise("")
    paid = F.format_string('{"event":"%s","payload":{"payment":{"entity":{"id":"pay%d","order_id":"%s","amount":%d,"error_description":"%s"}}}}', kind, F.col("event_id"), order, amount, why)
    plain = F.format_string('{"event":"%s","payload":{"order":{"entity":{"id":"%s","amount_paid":%d}}}}', kind, order, amount)
    body = F.when(F.col("event_id") % 31 == 0, "not json").when(F.col("event_type") == "click", plain).otherwise(paid)
    return sources.parse_webhook_events(e.select("event_id", "t", body.alias("body")))


def e5_fulfil(spark: SparkSession, d: str) -> DataFrame:
    orders = payments(spark, d).withColumn("status", F.when(F.col("status") == "fulfilled", "created").otherwise(F.col("status")))
    plans = spark.createDataFrame([("starter",)], "plan string")
    events = _webhooks(spark, d).filter("NOT rejected").select("event_id", "t", "kind", "order_id", "amount")
    return E.fulfil_payments(orders, events, users(spark, d), plans)


def e5_settled(spark: SparkSession, d: str) -> DataFrame:
    """Orders after all payment events, with the last failure while they were open."""
    orders = payments(spark, d).withColumn("status", F.when(F.col("status") == "fulfilled", "created").otherwise(F.col("status"))).select("order_id", "user_id", "plan", "amount", "status")
    plans = spark.createDataFrame([("starter",)], "plan string")
    return E.settle_payments(orders, _webhooks(spark, d).filter("NOT rejected"), users(spark, d), plans).select("order_id", "status", "payment_id", "paid_t", "last_failure", "last_failed_t")


def e6_plans(spark: SparkSession, d: str) -> DataFrame:
    paid = payments(spark, d).filter("status = 'fulfilled'").select("user_id", "order_id", "pages", E.micros(F.col("created_at")).alias("t"))
    return E.plan_ledger(paid, 930_000_000_000_000)


def r13_updates(spark: SparkSession, d: str) -> DataFrame:
    """Eight events in a row touch one issue: edits, notes, resolutions, and notes that reopen."""
    resolved = F.when(F.col("issue.status") == "resolved", F.lit(5).cast("long"))
    issues = statements(spark, d).filter("issue IS NOT NULL").select(F.col("id").alias("issue_id"), F.col("issue.title").alias("title"), F.lit("").alias("note"), F.col("issue.status").alias("status"), F.lit(0).cast("long").alias("updated_at"), resolved.alias("resolved_at"))
    kind = F.col("event_type")
    up = _events(spark, d).select("event_id", F.concat(F.lit("D"), (F.floor(F.col("event_id") / 8) * 5).cast("string")).alias("issue_id"), F.col("t").alias("ts"), F.when(kind == "click", F.concat(F.lit("new "), "event_id")).alias("title"), F.when(kind.isin("view", "error"), F.concat(F.lit("note "), "event_id")).alias("note"), F.when(kind.isin("signup", "error"), "open").when(kind == "purchase", "resolved").alias("status"))
    return accounts.apply_issue_updates(issues, up)


def c24_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures as sent: right for three payments in four, in upper case for one, made over other text or missing."""
    text = F.concat_ws("|", "order_id", "user_id")
    right, k = C.hmac_sha256("secret-key", text), F.substring("order_id", 2, 12).cast("long") % 8
    sent = F.when(k == 3, F.upper(right)).when(k == 5, C.hmac_sha256("secret-key", F.concat(text, F.lit(" ")))).when(k == 7, F.lit(None).cast("string")).otherwise(right)
    return payments(spark, d).select("order_id", right.alias("signature"), C.verify_signature("secret-key", text, sent).alias("valid"))


def c23_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Messages with a spare e-mail column and blanks in both."""
    t = messages(spark, d).withColumn("email", F.when(F.length("id") % 2 == 0, F.concat(F.lit(" m@"), "id", F.lit(".org "))).when(F.col("status").isNull(), " "))
    return sources.normalise_contact(t).select("id", "email", "phone", "source")


def c19_passwords(spark: SparkSession, d: str) -> DataFrame:
    """Passwords of uploaded files: the known ones win over the digits of the name."""
    name = F.concat(F.lit("/in 99/"), F.when(F.col("row_count") == 3, "special_123456.pdf").when(F.col("row_count") == 4, "plain.pdf").otherwise(F.concat(F.lit("stmt_"), F.lpad(F.substring("id", 2, 12), 8, "0"), F.lit(".pdf"))))
    return statements(spark, d).select("id", C.known_password(name, {"special_123456.pdf": "open sesame"}).alias("password"))


def s6_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Users written as a table of an older shape and read under the declared schema."""
    folder = sources.scratch_folder(spark)
    users(spark, d).select("id", "name", "mobile", "role", "is_admin", F.col("pages_used").cast("long").alias("pages_used")).write.parquet(f"{folder}/users")
    t = sources.read_accounts(spark, folder, "users")
    return t.select("id", "mobile", accounts.role().alias("role"), "pages_used", F.coalesce("page_limit", F.lit(100)).cast("long").alias("page_limit"))


def r12_numbers(spark: SparkSession, d: str) -> DataFrame:
    log = _events(spark, d).filter("event_type = 'error'").select("event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"), F.col("t").alias("ts"))
    return accounts.issue_numbers(log, users(spark, d))


def r11_stamp(spark: SparkSession, d: str) -> DataFrame:
    gone = users(spark, d).filter("pages_used % 6 = 1").select("id", "name", "mobile")
    return accounts.stamp_deleted_owner(statements(spark, d), gone).select("id", "user_id", "owner_name", "owner_mobile", "owner_deleted")


def valid_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = r_codes(spark, d)
    return E.valid_code(codes.filter("kind = 'send'"), codes.filter("kind = 'verify'"))


Query = Callable[[SparkSession, str], DataFrame]
def f17_files(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded files routed by what the probes find: passwords, scans, text that can't be read, page credit, layout."""
    k = F.col("o_orderkey")
    sid = k.cast("string").alias("statement_id")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    blocks = o.select(sid, F.lit(1).alias("page"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), (k % 2).cast("int").alias("block_type"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (k % 600).cast("double").alias("x1"), F.lit(800.0).alias("y1"))
    text = F.concat(F.repeat(F.lit("word "), F.when(k % 3 == 0, 5).otherwise(60)), F.repeat(F.lit("\x01"), (k % 31).cast("int")))
    scans = routing.is_scanned(blocks, o.select(sid, text.alias("text")))
    layout = routing.classify_layout(routing.best_grid_table(layout_queries.grid_cells(spark, d))).select("statement_id", "category")
    left = users(spark, d).select(F.col("id").alias("user_id"), (F.coalesce("page_limit", F.lit(100)) - F.col("pages_used")).alias("remaining"))
    name = F.when(k % 10 == 0, "plain.pdf").otherwise(F.concat(F.lit("stmt_"), F.lpad(k.cast("string"), 8, "0"), F.lit(".pdf")))
    password = C.known_password(name, {})
    files = o.select(sid, F.concat(F.lit("U"), "o_custkey").alias("user_id"), (k % 5 == 0).alias("encrypted"), password.alias("password"), (k % 25 != 0).alias("password_ok"), (1 + k % 40).alias("pages"), routing.has_undecodable_text(text).alias("undecodable"))
    flags = files.join(left, "user_id", "left").join(scans, "statement_id", "left").join(layout, "statement_id", "left")
    return routing.route_statements(flags.withColumn("remaining", F.coalesce("remaining", F.lit(0)))).select("statement_id", "status")


QUERIES: dict[str, Query] = {
    "f17_routed_files": f17_files,
    "r1_statement_counts": lambda s, d: accounts.statement_counts(statements(s, d)),
    "r2_platform_stats": lambda s, d: accounts.platform_stats(users(s, d), statements(s, d), messages(s, d)),
    "r3_free_usage_topk": lambda s, d: accounts.free_usage_topk(users(s, d)),
    "r4_user_directory": lambda s, d: accounts.user_directory(users(s, d), statements(s, d), messages(s, d), "7"),
    "r5_statement_directory": lambda s, d: accounts.statement_directory(statements(s, d), users(s, d), "hdfc"),
    "r6_user_statements": lambda s, d: accounts.user_statements(statements(s, d), "U7"),
    "r7_message_inbox": lambda s, d: accounts.message_inbox(messages(s, d), "salesperson", "U2").select("id", "source", "phone", "status", "created_at"),
    "r8_payment_ledger": lambda s, d: accounts.payment_ledger(payments(s, d)),
    "r9_revenue": lambda s, d: accounts.revenue(payments(s, d)),
    "r10_issue_queue": lambda s, d: accounts.issue_queue(statements(s, d), users(s, d)),
    "r11_stamp_deleted_owner": r11_stamp,
    "r12_issue_numbers": r12_numbers,
    "r13_issue_updates": r13_updates,
    "e1_sessionize": e1_sessionize,
    "e2_lockouts": lambda s, d: E.lockouts(r_attempts(s, d)),
    "e3_otp_throttle": lambda s, d: E.otp_throttle(r_requests(s, d)),
    "e4_otp_verify": lambda s, d: E.otp_verify(r_codes(s, d)),
    "e4_valid_code_asof": valid_codes,
    "e4_sign_in": e4_sign_in,
    "e3_guarded_sends": e3_guarded_sends,
    "e4_stream_sign_in": e4_stream,
    "e5_stream_settled": e5_stream,
    "e5_fulfil_payments": e5_fulfil,
    "e5_settled_payments": e5_settled,
    "e6_plan_ledger": e6_plans,
    "e7_credit_gate": lambda s, d: E.credit_gate(r_uploads(s, d)),
    "s7_webhook_events": lambda s, d: _webhooks(s, d).select("event_id", "kind", "order_id", "payment_id", "amount", "rejected"),
    "c20_user_roles": lambda s, d: users(s, d).select("id", accounts.role().alias("role")),
    "c21_gst": lambda s, d: payments(s, d).select("order_id", C.gst_breakup(F.col("base_paise") + F.length("order_id")).alias("g")).select("order_id", "g.gst_paise", "g.total_paise"),
    "c24_signatures": c24_signatures,
    "c23_contacts": c23_contacts,
    "c19_known_passwords": c19_passwords,
    "s6_read_accounts": s6_accounts,
}
_KEY = [bytes(b ^ x for b in b"secret-key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
_HMAC = f"sha256(unhex('{_KEY[1]}') || unhex(sha256(unhex('{_KEY[0]}') || encode(order_id || '|' || user_id))))"
_RANKED = "row_number() OVER (ORDER BY created_at DESC, order_id) AS place"
ORACLES: dict[str, str] = {
    "f17_routed_files": f"""{WITH}, g AS ({layout_queries.ORACLES["f10_best_grid_table"]}),
 f AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 60 END AS words, o_orderkey % 31 AS bad FROM orders)
 SELECT k::VARCHAR AS statement_id, CASE WHEN k % 10 = 0 THEN 'PASSWORD_REQUIRED' WHEN k % 25 = 0 THEN 'WRONG_PASSWORD' WHEN words * 5 - (bad = 0)::INT + bad < 100 AND k % 2 = 1 AND k % 600 >= 300 THEN 'SCANNED'
  WHEN words * 5 + bad >= 200 AND bad / (words * 4 + bad) >= 0.1 THEN 'UNREADABLE' WHEN coalesce(coalesce(page_limit, 100) - pages_used, 0) <= 0 THEN 'PAGE_LIMIT_REACHED' WHEN 1 + k % 40 > coalesce(page_limit, 100) - pages_used THEN 'INSUFFICIENT_PAGES'
  ELSE coalesce(category, 'NO_TABLE') END AS status
 FROM f LEFT JOIN users u ON u.id = 'U' || o_custkey LEFT JOIN g ON g.statement_id = k::VARCHAR""",
    "r1_statement_counts": f"{WITH} SELECT user_id, count(*) AS statement_count FROM statements WHERE user_id IS NOT NULL GROUP BY 1",
    "r2_platform_stats": f"""{WITH} SELECT (SELECT count(*) FROM users WHERE NOT {HIDDEN}) AS users, (SELECT count(*) FROM users WHERE {ROLE} IN ('admin', 'super_admin')) AS admins,
 count(*) AS statements, sum(row_count)::BIGINT AS rows, count(*) FILTER (issue_status = 'open') AS open_issues,
 (SELECT count(*) FROM messages m WHERE NOT EXISTS (SELECT 1 FROM users u WHERE {HIDDEN} AND u.mobile = m.phone)) AS messages,
 (SELECT count(*) FROM messages m WHERE coalesce(status, 'open') <> 'closed' AND NOT EXISTS (SELECT 1 FROM users u WHERE {HIDDEN} AND u.mobile = m.phone)) AS open_messages
 FROM statements s WHERE NOT EXISTS (SELECT 1 FROM users u WHERE {HIDDEN} AND u.id = s.user_id)""",
    "r3_free_usage_topk": f"{WITH} SELECT id, name, pages_used FROM users WHERE {ROLE} = 'user' AND pages_used > 0 AND coalesce(page_limit, 100) = 100 ORDER BY pages_used DESC, id LIMIT 5",
    "r4_user_directory": f"""{WITH} SELECT id, name, mobile, {ROLE} AS role, CASE WHEN {ROLE} <> 'user' THEN 'staff' WHEN coalesce(page_limit, 100) > 100 THEN 'paid' ELSE 'free' END AS type,
 (SELECT count(*) FROM statements s WHERE s.user_id = u.id) AS statement_count, (SELECT count(*) FROM statements s WHERE s.user_id = u.id AND issue_status = 'open') AS open_issues,
 (SELECT count(*) FROM messages m WHERE m.phone = u.mobile AND coalesce(m.status, 'open') <> 'closed') AS open_messages, greatest(coalesce(page_limit, 100) - pages_used, 0) AS pages_left, created_at::VARCHAR AS created_at
 FROM users u WHERE contains(lower(name), '7') OR contains(coalesce(mobile, ''), '7')""",
    "r5_statement_directory": f"""{WITH} SELECT s.id, s.user_id, filename, bank, coalesce(status, 'success') AS status, coalesce(u.name, owner_name, '') AS owner, coalesce(u.mobile, owner_mobile, '') AS owner_phone,
 u.id IS NULL AND (coalesce(owner_deleted, false) OR s.user_id IS NULL) AS is_owner_deleted, s.created_at::VARCHAR AS created_at
 FROM statements s LEFT JOIN (SELECT *, {ROLE} AS r FROM users) u ON u.id = s.user_id WHERE coalesce(u.r, 'user') = 'user' AND bank = 'hdfc'""",
    "r6_user_statements": f"{WITH} SELECT id, filename, bank, coalesce(status, 'success') AS status, coalesce(issue_status, '') AS issue_status, created_at::VARCHAR AS created_at FROM statements WHERE user_id = 'U7'",
    "r7_message_inbox": f"{WITH} SELECT id, source, phone, status, created_at::VARCHAR AS created_at FROM messages WHERE source IS DISTINCT FROM 'contactus' AND salesperson_id = 'U2'",
    "r8_payment_ledger": f"{WITH} SELECT order_id, user_id, status, base_paise / 100 AS base, gst_paise / 100 AS gst, amount / 100 AS total, status IN ('needs_review', 'amount_mismatch', 'signature_failed') AS needs_attention, created_at::VARCHAR AS created_at FROM (SELECT *, {_RANKED} FROM payments) WHERE place <= 500",
    "r9_revenue": f"{WITH} SELECT (SELECT sum(amount) / 100 FROM payments WHERE status = 'fulfilled') AS revenue, count(*) FILTER (status IN ('needs_review', 'amount_mismatch')) AS attention FROM (SELECT *, {_RANKED} FROM payments) WHERE place <= 500",
    "r10_issue_queue": f"""{WITH} SELECT s.id, s.user_id, coalesce(u.name, owner_name, '') AS owner, coalesce(issue_number, '#' || place) AS number, 'title ' || s.id AS title, issue_status AS status, s.created_at::VARCHAR AS opened_at
 FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(user_id, '') ORDER BY created_at, id) AS place FROM statements WHERE issue_status IS NOT NULL) s LEFT JOIN users u ON u.id = s.user_id""",
    "r11_stamp_deleted_owner": f"{WITH} SELECT s.id, s.user_id, coalesce(u.name, owner_name) AS owner_name, coalesce(u.mobile, owner_mobile) AS owner_mobile, CASE WHEN u.id IS NOT NULL THEN true ELSE owner_deleted END AS owner_deleted FROM statements s LEFT JOIN (SELECT * FROM users WHERE pages_used % 6 = 1) u ON u.id = s.user_id",
    "r12_issue_numbers": f"{WITH}, {EVENTS} SELECT event_id, 'U' || user_id AS user_id, coalesce(right(mobile, 3), '000') || row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS number FROM ev e LEFT JOIN users u ON u.id = 'U' || e.user_id WHERE event_type = 'error'",
    "r13_issue_updates": f"""{WITH}, {EVENTS}, up AS (SELECT 'D' || (event_id // 8 * 5) AS issue_id, event_id, t, event_type AS k FROM ev),
 q AS (SELECT issue_id, t, event_id, k, row_number() OVER (PARTITION BY issue_id, k IN ('signup', 'error', 'purchase') ORDER BY t DESC, event_id DESC) AS decided,
  row_number() OVER (PARTITION BY issue_id, k = 'click' ORDER BY t DESC, event_id DESC) AS named, row_number() OVER (PARTITION BY issue_id, k IN ('view', 'error') ORDER BY t DESC, event_id DESC) AS noted FROM up)
 SELECT s.id AS issue_id, coalesce((SELECT 'new ' || event_id FROM q WHERE q.issue_id = s.id AND k = 'click' AND named = 1), 'title ' || s.id) AS title,
  coalesce((SELECT 'note ' || event_id FROM q WHERE q.issue_id = s.id AND k IN ('view', 'error') AND noted = 1), '') AS note,
  CASE d.k WHEN 'purchase' THEN 'resolved' WHEN 'signup' THEN 'open' WHEN 'error' THEN 'open' ELSE issue_status END AS status,
  coalesce((SELECT max(t) FROM up WHERE up.issue_id = s.id AND k IN ('click', 'view', 'error')), 0) AS updated_at,
  CASE WHEN d.k = 'purchase' THEN d.t WHEN d.k IS NULL AND issue_status = 'resolved' THEN 5 END AS resolved_at,
  (SELECT max(t) FROM up WHERE up.issue_id = s.id AND k = 'error') AS reopened_at
 FROM statements s LEFT JOIN (SELECT * FROM q WHERE decided = 1 AND k IN ('signup', 'error', 'purchase')) d ON d.issue_id = s.id WHERE issue_status IS NOT NULL""",
    "c24_signatures": f"""{WITH}, s AS (SELECT order_id, {_HMAC} AS signature FROM payments) SELECT order_id, signature, substr(order_id, 2)::BIGINT % 8 NOT IN (5, 7) AS valid FROM s""",
    "c23_contacts": f"""{WITH}, m AS (SELECT id, CASE WHEN length(id) % 2 = 0 THEN 'm@' || id || '.org' END AS email, nullif(trim(phone), '') AS phone, coalesce(source, 'contact') AS source FROM messages) SELECT * FROM m WHERE email IS NOT NULL OR phone IS NOT NULL""",
    "c19_known_passwords": f"{WITH} SELECT id, CASE row_count WHEN 3 THEN 'open sesame' WHEN 4 THEN NULL ELSE lpad(substr(id, 2), 8, '0') END AS password FROM statements",
    "s6_read_accounts": f"{WITH} SELECT id, mobile, CASE WHEN role IS NOT NULL THEN role WHEN is_admin THEN 'admin' ELSE 'user' END AS role, pages_used, 100 AS page_limit FROM users",
    "e1_sessionize": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000, true)::INT AS n FROM events),
 s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS events FROM s GROUP BY user_id, k""",
    "e2_lockouts": _lockout_oracle(),
    "e3_otp_throttle": _throttle_oracle(),
    "e4_otp_verify": _verify_oracle(),
    "e4_sign_in": _sign_in_oracle(),
    "e4_stream_sign_in": _sign_in_oracle(),
    "e3_guarded_sends": _sign_in_oracle("kind = 'send'"),
    "e4_valid_code_asof": f"WITH {EVENTS}, c AS ({CODES}) SELECT v.event_id, v.mobile, v.purpose, v.t, s.t AS sent_t, coalesce(s.t + 300000000 > v.t, false) AS in_time FROM c v LEFT JOIN LATERAL (SELECT t FROM c x WHERE x.kind = 'send' AND x.mobile = v.mobile AND (x.t, x.event_id) <= (v.t, v.event_id) ORDER BY x.t DESC, x.event_id DESC LIMIT 1) s ON true WHERE v.kind = 'verify'",
    "e5_fulfil_payments": f"""{WITH}, {EVENTS}, w AS (SELECT event_id, t, 'P' || (event_id // 2) AS order_id, CASE event_type WHEN 'purchase' THEN 'payment.captured' WHEN 'click' THEN 'order.paid' ELSE 'x' END AS kind, CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 117882 ELSE 294882 END AS amount FROM ev WHERE event_id % 31 <> 0),
 c AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY t, event_id) AS n FROM w WHERE kind <> 'x')
 SELECT c.event_id, c.order_id, p.user_id, c.t, CASE WHEN p.order_id IS NULL THEN 'unknown_order' WHEN p.status NOT IN ('created', 'fulfilled') OR n > 1 THEN 'already_fulfilled' WHEN c.amount <> p.amount THEN 'amount_mismatch' WHEN p.plan <> 'starter' OR u.id IS NULL THEN 'needs_review' ELSE 'fulfilled' END AS outcome
 FROM c LEFT JOIN payments p ON p.order_id = c.order_id LEFT JOIN users u ON u.id = p.user_id""",
    "e5_settled_payments": f"""{WITH}, {EVENTS}, w AS (SELECT event_id, t, 'P' || (event_id // 2) AS order_id, event_type AS k, CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 117882 ELSE 294882 END AS amount FROM ev WHERE event_id % 31 <> 0),
 o AS (SELECT order_id, user_id, plan, amount AS due, CASE WHEN status = 'fulfilled' THEN 'created' ELSE status END AS was FROM payments),
 c AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY t, event_id) AS n FROM w WHERE k IN ('purchase', 'click')),
 a AS (SELECT o.*, c.event_id, c.t, c.k, CASE WHEN c.event_id IS NULL THEN was WHEN c.amount <> due THEN 'amount_mismatch' WHEN plan <> 'starter' OR u.id IS NULL THEN 'needs_review' ELSE 'fulfilled' END AS status FROM o LEFT JOIN c ON c.order_id = o.order_id AND n = 1 AND was = 'created' LEFT JOIN users u ON u.id = o.user_id),
 f AS (SELECT a.order_id, last(CASE WHEN w.event_id % 4 = 0 THEN 'declined ' || w.event_id ELSE 'Payment failed' END ORDER BY w.t, w.event_id) AS why, max(w.t) AS t FROM a JOIN w ON w.order_id = a.order_id AND w.k = 'error' AND was = 'created' AND (a.event_id IS NULL OR (w.t, w.event_id) < (a.t, a.event_id)) GROUP BY 1)
 SELECT a.order_id, a.status, CASE WHEN k = 'purchase' THEN 'pay' || event_id END AS payment_id, a.t AS paid_t, f.why AS last_failure, f.t AS last_failed_t FROM a LEFT JOIN f USING (order_id)""",
    "e6_plan_ledger": f"""{WITH}, p AS (SELECT user_id, order_id, pages, epoch_us(created_at::TIMESTAMP) AS t FROM payments WHERE status = 'fulfilled'),
 g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, order_id) >= 31536000000000, true)::INT AS n FROM p),
 i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, order_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
 r AS (SELECT user_id, k, count(*) AS purchases, sum(pages)::BIGINT AS pages, max(t) + 31536000000000 AS e FROM i GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS z FROM r)
 SELECT user_id, purchases, 100 + CASE WHEN e > 930000000000000 THEN pages ELSE 0 END AS page_limit, e AS expires_t, e > 930000000000000 AS active FROM l WHERE z = 1""",
    "e7_credit_gate": _credit_oracle(),
    "s7_webhook_events": f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 31 <> 0 THEN CASE event_type WHEN 'purchase' THEN 'payment.captured' WHEN 'click' THEN 'order.paid' WHEN 'error' THEN 'payment.failed' ELSE 'other' END END AS kind,
 CASE WHEN event_id % 31 <> 0 THEN 'P' || (event_id // 2) END AS order_id, CASE WHEN event_id % 31 <> 0 AND event_type <> 'click' THEN 'pay' || event_id END AS payment_id,
 CASE WHEN event_id % 31 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 117882 ELSE 294882 END END AS amount, event_id % 31 = 0 AS rejected FROM ev""",
    "c20_user_roles": f"{WITH} SELECT id, {ROLE} AS role FROM users",
    "c21_gst": f"{WITH} SELECT order_id, round_even((base_paise + length(order_id)) * 0.18, 0)::BIGINT AS gst_paise, base_paise + length(order_id) + round_even((base_paise + length(order_id)) * 0.18, 0)::BIGINT AS total_paise FROM payments",
}
ORACLES["e5_stream_settled"] = ORACLES["e5_settled_payments"]
