"""Account, payment and issue reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtspark.functions import cells as C

FREE_PAGES = 100
ATTENTION = ["needs_review", "amount_mismatch", "signature_failed"]


def is_super_admin() -> Column:
    return (F.coalesce("role", F.lit("")) == "super_admin") | F.coalesce("is_super_admin", F.lit(False))


def role() -> Column:
    return C.user_role(F.col("role"), F.coalesce("is_super_admin", F.lit(False)), F.coalesce("is_admin", F.lit(False)))


def statement_counts(statements: DataFrame) -> DataFrame:
    return statements.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("statement_count"))


def platform_stats(users: DataFrame, statements: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of totals that leave the super admins' own data out; rows without an owner count."""
    hidden = users.filter(is_super_admin())
    own = users.filter(~is_super_admin()).agg(F.count("*").alias("users"), F.lit(1).alias("k"))
    admins = users.agg(F.count_if(role().isin("admin", "super_admin")).alias("admins"), F.lit(1).alias("k"))
    st = statements.join(hidden.select(F.col("id").alias("user_id")), "user_id", "left_anti").agg(F.count("*").alias("statements"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.count_if(F.col("issue.status") == "open").alias("open_issues"), F.lit(1).alias("k"))
    ms = messages.join(hidden.select(F.col("mobile").alias("phone")), "phone", "left_anti").agg(F.count("*").alias("messages"), F.count_if(F.coalesce("status", F.lit("open")) != "closed").alias("open_messages"), F.lit(1).alias("k"))
    # each side is one row
    return own.join(admins, "k").join(st, "k").join(ms, "k").drop("k")


def free_usage_topk(users: DataFrame, k: int = 5) -> DataFrame:
    return users.filter((role() == "user") & (F.coalesce("pages_used", F.lit(0)) > 0) & (F.coalesce("page_limit", F.lit(FREE_PAGES)) == FREE_PAGES)).select("id", "name", "pages_used").orderBy(F.desc("pages_used"), "id").limit(k)


def user_directory(users: DataFrame, statements: DataFrame, messages: DataFrame, query: str = "") -> DataFrame:
    """Users with counts of their statements, open issues and open messages, newest first."""
    own = statements.filter("user_id IS NOT NULL").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("statement_count"), F.count_if(F.col("issue.status") == "open").alias("open_issues"))
    asked = messages.filter("coalesce(phone, '') <> ''").groupBy(F.col("phone").alias("mobile")).agg(F.count_if(F.coalesce("status", F.lit("open")) != "closed").alias("open_messages"))
    kind = F.when(role() != "user", "staff").when(F.coalesce("page_limit", F.lit(FREE_PAGES)) > FREE_PAGES, "paid").otherwise("free")
    found = users.filter(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(query.lower())) | F.contains(F.coalesce("mobile", F.lit("")), F.lit(query))) if query else users
    left = F.greatest(F.coalesce("page_limit", F.lit(FREE_PAGES)) - F.coalesce("pages_used", F.lit(0)), F.lit(0))
    out = found.join(own, "id", "left").join(asked, "mobile", "left")
    return out.select("id", "name", "mobile", role().alias("role"), kind.alias("type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("statement_count", "open_issues", "open_messages")], left.alias("pages_left"), "created_at").orderBy(F.desc_nulls_last("created_at"), "id")


def statement_directory(statements: DataFrame, users: DataFrame, query: str = "") -> DataFrame:
    """Statements with their owners, staff's left out; owners that are gone show what was stamped."""
    owners = users.select(F.col("id").alias("user_id"), F.col("name").alias("u_name"), F.col("mobile").alias("u_mobile"), role().alias("u_role"), F.lit(True).alias("known"))
    # null owners match nothing and would meet in one task: they pass beside the join
    some = statements.filter("user_id IS NOT NULL").join(owners, "user_id", "left")
    none = statements.filter("user_id IS NULL").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("u_name", "string"), ("u_mobile", "string"), ("u_role", "string"), ("known", "boolean"))])
    t = some.unionByName(none).filter(F.coalesce("u_role", F.lit("user")) == "user")
    out = t.select("id", "user_id", "filename", "bank", F.coalesce("status", F.lit("success")).alias("status"), F.coalesce("u_name", "owner_name", F.lit("")).alias("owner"), F.coalesce("u_mobile", "owner_mobile", F.lit("")).alias("owner_phone"), (F.col("known").isNull() & (F.coalesce("owner_deleted", F.lit(False)) | F.col("user_id").isNull())).alias("is_owner_deleted"), "created_at")
    if query:
        low = query.lower()
        out = out.filter(F.contains(F.lower(F.concat_ws("\n", "filename", "bank", "owner", "owner_phone")), F.lit(low)))
    return out.orderBy(F.desc_nulls_last("created_at"), "id")


def user_statements(statements: DataFrame, user_id: str) -> DataFrame:
    return statements.filter(F.col("user_id") == user_id).select("id", "filename", "bank", F.coalesce("status", F.lit("success")).alias("status"), F.coalesce("issue.status", F.lit("")).alias("issue_status"), "created_at").orderBy(F.desc("created_at"), "id")


def message_inbox(messages: DataFrame, viewer: str, staff_id: str | None = None) -> DataFrame:
    """Messages that a role sees, newest first."""
    from_contact = F.col("source").eqNullSafe("contactus")
    seen = {"super_admin": F.lit(True), "admin": from_contact, "salesperson": ~from_contact & F.col("salesperson_id").eqNullSafe(F.lit(staff_id))}[viewer]
    return messages.filter(seen).orderBy(F.desc("created_at"), "id")


def payment_ledger(payments: DataFrame, status: str | None = None, limit: int = 500) -> DataFrame:
    """The newest payments in rupees, those that need attention first."""
    t = payments.filter(F.col("status") == status) if status else payments
    newest = t.orderBy(F.desc("created_at"), "order_id").limit(limit)
    flag = F.coalesce(F.col("status").isin(ATTENTION), F.lit(False))
    return newest.select("order_id", "user_id", "status", (F.col("base_paise") / 100).alias("base"), (F.col("gst_paise") / 100).alias("gst"), (F.col("amount") / 100).alias("total"), flag.alias("needs_attention"), "created_at").orderBy(F.desc("needs_attention"), F.desc("created_at"), "order_id")


def revenue(payments: DataFrame) -> DataFrame:
    total = payments.filter("status = 'fulfilled'").agg((F.coalesce(F.sum("amount"), F.lit(0)) / 100).alias("revenue"), F.lit(1).alias("k"))
    listed = payment_ledger(payments).agg(F.count_if("needs_attention").alias("attention"), F.lit(1).alias("k"))
    return total.join(listed, "k").drop("k")


def _issue_places(issues: DataFrame) -> DataFrame:
    """``issues`` with place: the running count of the owner's issues, owner-less ones as one owner.

    Counted within days and over days, so that no owner's issues, nor those without owner, meet in one task.
    """
    day = issues.withColumn("_uid", F.coalesce("user_id", F.lit(""))).withColumn("_day", F.to_date("issue.created_at"))
    inner = Window.partitionBy("_uid", "_day").orderBy("issue.created_at", "id")
    counts = day.groupBy("_uid", "_day").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_uid").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_uid", F.col("_day").alias("_on"), F.coalesce(before, F.lit(0)).alias("_before"))
    t = day.withColumn("_nth", F.row_number().over(inner))
    t = t.join(counts.withColumnRenamed("_uid", "_u"), (F.col("_uid") == F.col("_u")) & F.col("_day").eqNullSafe(F.col("_on")))
    return t.withColumn("place", F.col("_before") + F.col("_nth")).drop("_uid", "_day", "_u", "_on", "_before", "_nth")


def _with_owner(t: DataFrame, owners: DataFrame) -> DataFrame:
    """``t`` left-joined with ``owners`` on user_id; rows without owner take no part in the exchange."""
    rest = t.filter("user_id IS NULL")
    for f in owners.schema.fields:
        if f.name != "user_id":
            rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
    return t.filter("user_id IS NOT NULL").join(owners, "user_id", "left").unionByName(rest)


def issue_queue(statements: DataFrame, users: DataFrame) -> DataFrame:
    """Issues with owner and number, open ones first, newest first; unnumbered ones get their place per owner."""
    t = _issue_places(statements.filter("issue IS NOT NULL"))
    t = _with_owner(t, users.select(F.col("id").alias("user_id"), F.col("name").alias("u_name")))
    out = t.select("id", "user_id", F.coalesce("u_name", "owner_name", F.lit("")).alias("owner"), F.coalesce("issue.number", F.concat(F.lit("#"), F.col("place").cast("string"))).alias("number"), F.col("issue.title").alias("title"), F.col("issue.status").alias("status"), F.col("issue.created_at").alias("opened_at"))
    return out.orderBy((F.col("status") == "open").desc(), F.desc("opened_at"), "id")


def stamp_deleted_owner(statements: DataFrame, deleted: DataFrame) -> DataFrame:
    """Statements of deleted users keep their name and mobile."""
    t = _with_owner(statements, deleted.select(F.col("id").alias("user_id"), F.col("name").alias("d_name"), F.col("mobile").alias("d_mobile"), F.lit(True).alias("gone")))
    new = {"owner_name": F.coalesce("d_name", "owner_name"), "owner_mobile": F.coalesce("d_mobile", "owner_mobile"), "owner_deleted": F.coalesce("gone", "owner_deleted")}
    return t.select(*[new[c].alias(c) if c in new else F.col(c) for c in statements.columns])


def issue_numbers(events: DataFrame, users: DataFrame) -> DataFrame:
    """(event_id, user_id, number): last three digits of the mobile and the user's running count."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    digits = C.digits_only(F.coalesce("mobile", F.lit("")))
    last = F.when(F.length(digits) >= 3, F.substring(digits, -3, 3)).otherwise("000")
    t = events.withColumn("n", F.row_number().over(own)).join(users.select(F.col("id").alias("user_id"), "mobile"), "user_id", "left")
    return t.select("event_id", "user_id", F.concat(last, F.col("n").cast("string")).alias("number"))


def apply_issue_updates(issues: DataFrame, updates: DataFrame) -> DataFrame:
    """Issues after all updates (issue_id, event_id, ts, title, note, status), in order of ts and event_id.

    An edit has a title (160 characters) or a note (2000) and moves updated_at.  A status moves the
    resolution: "resolved" sets resolved_at, "open" clears it; an edit that opens the issue again also sets
    reopened_at.  What no update names stays as it is.
    """
    at = F.struct("ts", "event_id")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    edit = F.col("title").isNotNull() | F.col("note").isNotNull()
    one = updates.groupBy("issue_id").agg(
        latest("title").alias("_title"), latest("note").alias("_note"), latest("status").alias("_status"),
        F.max_by("ts", F.when(F.col("status").isNotNull(), at)).alias("_decided"), F.max(F.when(edit, F.col("ts"))).alias("_edited"), F.max(F.when(edit & (F.col("status") == "open"), F.col("ts"))).alias("_reopened"),
    )
    t = issues.join(one, "issue_id", "left")
    old = lambda c: F.col(c) if c in issues.columns else F.lit(None).cast(updates.schema["ts"].dataType)
    new = {
        "title": F.substring(F.coalesce("_title", "title"), 1, 160),
        "note": F.substring(F.coalesce("_note", "note"), 1, 2000),
        "status": F.coalesce("_status", "status"),
        "updated_at": F.coalesce(F.col("_edited"), old("updated_at")),
        "resolved_at": F.when(F.col("_status") == "resolved", F.col("_decided")).when(F.col("_status").isNull(), old("resolved_at")),
        "reopened_at": F.coalesce(F.col("_reopened"), old("reopened_at")),
    }
    names = [*issues.columns, *(c for c in ("updated_at", "resolved_at", "reopened_at") if c not in issues.columns)]
    return t.select(*[new[c].alias(c) if c in new else F.col(c) for c in names])
