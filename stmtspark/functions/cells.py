"""Scalar and row-level column functions for statement cells.

All are built-in Spark expressions.  ASCII digits and white space count; letters are Unicode's.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtspark.functions import fixed

MONEY = "decimal(18,2)"
_ABBREVIATED = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_FULL = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def any_of(words: list[str]) -> str:
    """A pattern that matches any of the words as they are."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def contains_any(low: Column, words: list[str]) -> Column:
    """Whether any of the words occurs: a plain search for each, many times cheaper than one alternation."""
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


_SPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.btrim(c, F.lit(_SPACE))


def let(value: Column, body) -> Column:
    """``body`` of ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _months(names: list[str]) -> Column:
    return F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, f"{i + 1:02d}")])


_NUMERIC = r"^(\d{1,2})([/.\-])(\d{1,2})\2"
_NAMED = r"^(\d{1,2})([\-\s])([A-Za-z]{3,9})\2(\d{4}|\d{2})$"


def _iso(t: Column) -> Column:
    """The date text as year-month-day; years of two digits from 70 on are of the last century."""
    year = F.regexp_extract(t, _NAMED, 4)
    full = F.when(F.length(year) == 4, year).when(year >= "70", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    month = let(F.lower(F.regexp_extract(t, _NAMED, 3)), lambda m: F.coalesce(F.element_at(_months(_ABBREVIATED), m), F.when(F.length(year) == 4, F.element_at(_months(_FULL), m))))
    return (
        F.when(t.rlike(_NUMERIC + r"\d{4}$"), F.regexp_replace(t, _NUMERIC + r"(\d{4})$", "$4-$3-$1"))
        .when(t.rlike(_NUMERIC + r"[7-9]\d$"), F.regexp_replace(t, _NUMERIC + r"(\d{2})$", "19$4-$3-$1"))
        .when(t.rlike(_NUMERIC + r"\d{2}$"), F.regexp_replace(t, _NUMERIC + r"(\d{2})$", "20$4-$3-$1"))
        .when(t.rlike(_NAMED), F.concat(full, F.lit("-"), month, F.lit("-"), F.regexp_extract(t, _NAMED, 1)))
    )


#: What a whole cell must look like to be a date; other cells take no further test.
_DATE_SHAPE = r"^\d{1,2}(?:[/.\-]\d{1,2}[/.\-]|[\-\s][A-Za-z]{3,9}[\-\s])\d{2,4}$"


def _date(t: Column) -> Column:
    """The date of a stripped text of the right shape."""
    return let(_iso(t).try_cast("date"), lambda d: F.when(d < F.lit("1970-01-01").cast("date"), d + F.expr("INTERVAL 100 YEARS")).otherwise(d).cast("date"))


def parse_date(c: Column) -> Column:
    """The date of a whole cell, day first; null where it is none.  Years before 1970 are a century later."""
    return let(strip(c), lambda t: F.when(t.rlike(_DATE_SHAPE), _date(t)))


def parse_date_leading(c: Column) -> Column:
    """The date of the whole cell, else of the text before its first space."""

    def read(t: Column) -> Column:
        head = let(F.substring_index(t, " ", 1), lambda h: F.when(h.rlike(_DATE_SHAPE), _date(h)))
        return F.when(t.rlike(r"^\d"), F.coalesce(F.when(t.rlike(_DATE_SHAPE), _date(t)), F.when(F.instr(t, " ") > 0, head)))

    return let(strip(c), read)


_MONEY = r"(?i)^\s*(-)?\s*(?:(?:INR|RS|₹)\.?\s*)?(\d{1,3}(?:,\d{2,3})*(?:\.\d+)?|\d+(?:\.\d+)?)\s*(\(?\s*(?:DR|CR)\s*\)?\.?)?\s*$"


def parse_money(c: Column) -> Column:
    """struct<value, sign>: magnitude and DR, CR or null; value is null where the cell is no money."""
    none = F.struct(F.lit(None).cast(MONEY).alias("value"), F.lit(None).cast("string").alias("sign"))

    def read(g: Column) -> Column:
        minus, number, mark = (F.get(g, F.lit(i)) for i in range(3))
        bare = ~number.rlike("[.,]") & (mark == "")
        identifier = bare & number.rlike(r"^(?:\d{10,}|0\d+)$")
        sign = F.when(F.contains(F.lower(mark), F.lit("d")), "DR").when(mark != "", "CR").when(minus == "-", "DR")
        value = F.when(~identifier, F.replace(number, F.lit(","), F.lit("")).try_cast(MONEY))
        return let(value, lambda v: F.struct(v.alias("value"), F.when(v.isNotNull(), sign).alias("sign")))

    # one look at the whole pattern for most cells; its three groups only where it matches
    groups = F.split(F.regexp_replace(c, _MONEY, "$1;$2;$3"), ";")
    return F.when(c.rlike(_MONEY), let(groups, read)).otherwise(none)


def is_money(c: Column) -> Column:
    return F.coalesce(c.rlike(_MONEY) & parse_money(c)["value"].isNotNull(), F.lit(False))


def signed_balance(c: Column) -> Column:
    return let(parse_money(c), lambda m: F.when(m["sign"] == "DR", -m["value"]).otherwise(m["value"]).cast(MONEY))


def clean(c: Column) -> Column:
    """Null and "nan" to "", white space collapsed, cut at the first boilerplate text."""
    cut = f"(?is)(?:{any_of(fixed.BOILERPLATE)}).*$"
    return let(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), lambda t: F.when(F.lower(t) == "nan", "").when(F.length(t) < min(map(len, fixed.BOILERPLATE)), t).otherwise(strip(F.regexp_replace(t, cut, ""))))


def cleaned(t: DataFrame, raw: str, into: str) -> DataFrame:
    """``t`` with ``clean`` of a column, as plain columns."""
    cut = f"(?is)(?:{any_of(fixed.BOILERPLATE)}).*$"
    t = t.withColumn("_flat", strip(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")))
    t = t.withColumn("_low", F.lower("_flat"))
    marked = (F.length("_flat") >= min(map(len, fixed.BOILERPLATE))) & contains_any(F.col("_low"), fixed.BOILERPLATE)
    return t.withColumn(into, F.when(F.col("_low") == "nan", "").when(marked, strip(F.regexp_replace("_flat", cut, ""))).otherwise(F.col("_flat"))).drop("_flat", "_low")


def raw_clean(c: Column) -> Column:
    """Null and "nan" to "", carriage returns to line feeds, ends trimmed."""
    t = strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def guess_reference(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, f"({fixed.REFERENCE})", 1), F.lit(""))


def is_ref_token(c: Column) -> Column:
    return c.rlike(fixed.REF_TOKEN)


def is_noise(low: Column, header_keywords: Column | None = None) -> Column:
    noise = contains_any(low, fixed.NOISE)
    return noise if header_keywords is None else noise | has_all(low, header_keywords)


def has_all(low: Column, words: Column) -> Column:
    """All of a non-empty array of words occur."""
    return F.coalesce((F.size(words) > 0) & F.forall(words, lambda k: F.contains(low, k)), F.lit(False))


def is_footer_start(low: Column) -> Column:
    return contains_any(low, fixed.FOOTERS)


def is_opening(low: Column) -> Column:
    return low.rlike(r"opening balance|brought forward|\bb/?f\b")


_MONTH_FIRST = r"^([A-Za-z]{3,9}) ?(\d{1,2}), (\d{4})$"


def row_date(c: Column) -> Column:
    """ISO dates, day-first dates, then month-first dates such as "September30, 2025"."""

    def read(t: Column) -> Column:
        month = let(F.lower(F.regexp_extract(t, _MONTH_FIRST, 1)), lambda m: F.coalesce(F.element_at(_months(_FULL), m), F.element_at(_months(_ABBREVIATED), m)))
        first = F.when(t.rlike(_MONTH_FIRST), F.concat(F.regexp_extract(t, _MONTH_FIRST, 3), F.lit("-"), month, F.lit("-"), F.regexp_extract(t, _MONTH_FIRST, 2)).try_cast("date"))
        return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")), parse_date_leading(t), first)

    return let(strip(c), read)


def leading_date(c: Column) -> Column:
    """struct<date, rest>: the date text that starts a cell and what follows; date is "" without one."""
    found = F.regexp_extract(c, fixed.LEADING_DATE, 1)
    rest = F.regexp_replace(F.regexp_replace(c, fixed.LEADING_DATE, ""), r"^\s+", "")
    return F.struct(found.alias("date"), rest.alias("rest"))


def amount_flag(c: Column) -> Column:
    """struct<number, flag>: number as printed and "dr" or "cr"; both "" without a mark."""
    return F.struct(F.regexp_extract(c, fixed.AMOUNT_FLAG, 1).alias("number"), F.lower(F.regexp_extract(c, fixed.AMOUNT_FLAG, 2)).alias("flag"))


def norm_header_word(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]", ""), "s$", "")


def format_cell(c: Column) -> Column:
    return F.coalesce(c.cast(MONEY).cast("string"), F.lit(""))


def undecodable_ratio(text: Column) -> Column:
    """Share of characters other than white space that are control or private or unassigned code points."""
    seen = F.regexp_replace(text, r"[\s\x1c-\x1f]+", "")
    bad = F.regexp_replace(seen, r"[^\p{Co}\p{Cn}\x00-\x1f]", "")
    return F.when(F.length(seen) > 0, F.char_length(bad) / F.char_length(seen)).otherwise(0.0)


def password_hint(file_name: Column) -> Column:
    """The first run of six digits or more in the base name, or null."""
    return F.nullif(F.regexp_extract(F.regexp_extract(file_name, r"([^/]*)$", 1), r"(\d{6,})", 1), F.lit(""))


def user_role(role: Column, is_super_admin: Column, is_admin: Column) -> Column:
    return F.when(role.isin(fixed.ROLES), role).when(is_super_admin, "super_admin").when(is_admin, "admin").otherwise("user")


def gst_breakup(base_paise: Column, percent: float = 18) -> Column:
    """struct<gst_paise, total_paise>, rounded half to even."""
    gst = F.bround(base_paise.cast("decimal(20,4)") * F.lit(percent).cast("decimal(6,2)") / 100, 0).cast("long")
    return F.struct(gst.alias("gst_paise"), (base_paise + gst).cast("long").alias("total_paise"))


def days_left(expires_at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(expires_at) - F.unix_timestamp(now)) / 86400)).cast("long")


def hmac_sha256(key: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a text column under a key known to the driver."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in raw).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def verify_signature(key: str, message: Column, signature: Column) -> Column:
    """Whether a signature is that of the message, in either case of hex; false for a null one."""
    return F.coalesce(hmac_sha256(key, message) == F.lower(F.trim(signature)), F.lit(False))


def known_password(file_name: Column, known: dict[str, str]) -> Column:
    """The password known for a base name, else the digits in it; null without either."""
    base = F.regexp_extract(file_name, r"([^/]*)$", 1)
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(pairs, base), password_hint(file_name))


def valid_mobile(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{10}$"), F.lit(False))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


# --- row-level functions over array<string> -------------------------------------------------


def split_money_cells(cells: Column) -> Column:
    """A cell of two or more amounts becomes several cells."""

    def parts(c: Column) -> Column:
        own = let(F.split(strip(c), r"\s+"), lambda w: F.when((F.size(w) >= 2) & F.forall(w, is_money), w))
        return F.when(c.rlike(r"\d\S*\s+\S*\d"), F.coalesce(own, F.array(c))).otherwise(F.array(c))

    return F.flatten(F.transform(cells, parts))


def facts(cells: Column) -> Column:
    """array<struct<i, text, date, value, sign>>: what each cell says, to be worked out once."""

    def fact(c: Column, i: Column) -> Column:
        lead = lambda m: let(parse_date_leading(c), lambda d: F.struct(i.alias("i"), c.alias("text"), d.alias("lead"), F.when(d.isNotNull(), parse_date(c)).alias("date"), m["value"].alias("value"), m["sign"].alias("sign")))
        return let(parse_money(c), lead)

    return F.transform(cells, fact)


def parsed_cells(t: DataFrame, text: str = "text") -> DataFrame:
    """``t``, one row for each cell, with lead, date, value and sign: the same as ``facts`` gives, in plain columns.

    Each step is a projection of its own, so that all of it runs as generated code and nothing is worked out twice.
    """
    month = lambda names: "CASE _month " + " ".join(f"WHEN '{n}' THEN '{i + 1:02d}'" for i, n in enumerate(names)) + " END"
    kept = t.columns
    t = t.withColumn("_s", strip(F.col(text)))
    t = t.selectExpr("*", f"_s RLIKE r'{_DATE_SHAPE}' AS _whole", "CASE WHEN _s RLIKE r'^\\d[^ ]* ' THEN substring_index(_s, ' ', 1) END AS _head")
    t = t.selectExpr("*", f"CASE WHEN _whole THEN _s WHEN _head RLIKE r'{_DATE_SHAPE}' THEN _head END AS _cand", f"CASE WHEN {text} RLIKE r'{_MONEY}' THEN split(regexp_replace({text}, r'{_MONEY}', '$1;$2;$3'), ';') END AS _money")
    t = t.selectExpr("*", "split(_cand, r'[/.\\-\\s]') AS _part", "regexp_replace(_cand, '[A-Za-z0-9]+', '') AS _marks", "_money[0] AS _minus", "_money[1] AS _number", "_money[2] AS _sign")
    t = t.selectExpr("*", "_part[0] AS _day", "lower(_part[1]) AS _month", "_part[2] AS _year")
    t = t.selectExpr(
        "*",
        "CASE length(_year) WHEN 4 THEN _year WHEN 2 THEN concat(CASE WHEN _year >= '70' THEN '19' ELSE '20' END, _year) END AS _y",
        "CASE WHEN substring(_marks, 1, 1) <> substring(_marks, 2, 1) THEN NULL WHEN _month < 'a' THEN CASE WHEN _marks RLIKE r'^[/.\\-]' THEN _month END "
        f"WHEN _marks RLIKE r'^[\\-\\s]' THEN coalesce({month(_ABBREVIATED)}, CASE WHEN length(_year) = 4 THEN {month(_FULL)} END) END AS _m",
        r"CASE WHEN NOT (_sign = '' AND _number RLIKE r'^(?:\d{10,}|0\d+)$') THEN try_cast(replace(_number, ',', '') AS decimal(18,2)) END AS value",
    )
    t = t.selectExpr("*", "CASE WHEN _y IS NOT NULL AND _m IS NOT NULL THEN try_cast(concat(_y, '-', _m, '-', _day) AS date) END AS _d")
    t = t.selectExpr("*", "CASE WHEN _d < DATE'1970-01-01' THEN cast(_d + INTERVAL 100 YEARS AS date) ELSE _d END AS lead")
    sign = "CASE WHEN value IS NULL THEN NULL WHEN contains(lower(_sign), 'd') THEN 'DR' WHEN _sign <> '' THEN 'CR' WHEN _minus = '-' THEN 'DR' END"
    return t.selectExpr(*kept, "lead", "CASE WHEN _whole THEN lead END AS date", "value", f"{sign} AS sign")


def dated_cells(t: DataFrame, text: str, into: str) -> DataFrame:
    """``t`` with ``row_date`` of a text column, as plain columns."""
    kept = [c for c in t.columns if c != into]
    months = lambda names: "CASE _name " + " ".join(f"WHEN '{n}' THEN '{i + 1:02d}'" for i, n in enumerate(names)) + " END"
    t = parsed_cells(t.withColumn("_text", strip(F.col(text))), "_text").drop("date", "value", "sign")
    t = t.selectExpr("*", f"CASE WHEN _text RLIKE r'{_MONTH_FIRST}' THEN split(regexp_replace(_text, r'{_MONTH_FIRST}', '$1;$2;$3'), ';') END AS _parts").selectExpr("*", "lower(_parts[0]) AS _name")
    first = f"try_cast(concat(_parts[2], '-', coalesce({months(_FULL)}, {months(_ABBREVIATED)}), '-', _parts[1]) AS date)"
    day = f"CASE WHEN _text RLIKE r'^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_cast(_text AS date) END"
    return t.selectExpr(*kept, f"coalesce({day}, lead, {first}) AS {into}")


def cell_token(t: DataFrame, text: str = "text") -> DataFrame:
    """Parsed cells with token: what a cell says wherever it stands, or null."""
    own = strip(F.col(text))
    plain = F.when(own.rlike(r"^[A-Za-z0-9/\-]{8,}$") & own.rlike(r"\d"), F.concat(F.lit("R:"), own))
    return t.withColumn("token", F.when(F.col("lead").isNotNull(), F.concat(F.lit("D:"), F.col("lead").cast("string"))).when(F.col("value").isNotNull(), F.concat(F.lit("M:"), F.col("value").cast("string"))).otherwise(plain))


def first_date(facts: Column) -> Column:
    """The first cell with a leading date, or null."""
    return F.get(F.filter(facts, lambda f: f["lead"].isNotNull()), F.lit(0))


def last_balance(facts: Column) -> Column:
    """The right-most marked amount, else the right-most amount, or null."""
    marked = F.filter(facts, lambda f: f["value"].isNotNull() & f["sign"].isNotNull())
    plain = F.filter(facts, lambda f: f["value"].isNotNull())
    return F.coalesce(F.get(marked, F.size(marked) - 1), F.get(plain, F.size(plain) - 1))


def signed(fact: Column) -> Column:
    return F.when(fact["sign"] == "DR", -fact["value"]).otherwise(fact["value"]).cast(MONEY)


def row_reference(facts: Column, balance_i: Column, find_tokens: Column) -> Column:
    """A cell of ten digits or more, else (if asked for) a reference token, else a reference in the row."""
    other = F.filter(facts, lambda f: F.coalesce(f["i"] != balance_i, F.lit(True)))
    long = F.get(F.filter(other, lambda f: f["text"].rlike(r"^\d{10,}$")), F.lit(0))["text"]
    token = F.when(find_tokens, F.trim(F.get(F.filter(other, lambda f: is_ref_token(F.trim(f["text"]))), F.lit(0))["text"]))
    return F.coalesce(long, token, guess_reference(F.array_join(F.transform(facts, lambda f: f["text"]), " ")))


def row_description(facts: Column, date_i: Column, balance_i: Column, reference: Column, drop_codes: Column) -> Column:
    """Text cells in order: no date, amount, balance, reference or (if asked for) code cell."""

    def keep(f: Column) -> Column:
        t = f["text"]
        code = drop_codes & t.rlike(r"\d") & ~t.rlike(r"(?:^|\s)[^\d\s]+(?:\s|$)")
        return t.rlike(r"[\p{L}\p{N}]") & F.coalesce(f["i"] != date_i, F.lit(True)) & F.coalesce(f["i"] != balance_i, F.lit(True)) & f["date"].isNull() & f["value"].isNull() & F.coalesce(t != reference, F.lit(True)) & ~code

    return strip(F.array_join(F.transform(F.filter(facts, keep), lambda f: f["text"]), " "))


def classify_amount(facts: Column, balance_i: Column, debit_i: Column, credit_i: Column) -> Column:
    """struct<debit, credit> from the right-most amount that is no balance and its place among the columns."""
    money = F.filter(facts, lambda f: F.coalesce(f["value"] != 0, F.lit(False)) & F.coalesce(f["i"] != balance_i, F.lit(True)))
    last = F.get(money, F.size(money) - 1)
    credit = F.coalesce(last["i"] >= credit_i, F.lit(False))
    return F.struct(F.when(~credit & debit_i.isNotNull(), last["value"]).alias("debit"), F.when(credit, last["value"]).alias("credit"))


def build_colmap(cells: Column) -> Column:
    """struct<debit, credit, balance>: the first header cell of each role."""

    def first(words: list[str]) -> Column:
        pattern = "|".join(rf"\b{w}\b" if len(w) <= 2 else w for w in words)
        hits = F.filter(F.transform(cells, lambda c, i: F.struct(i.alias("i"), F.lower(c).rlike(pattern).alias("hit"))), lambda x: x["hit"])
        return F.get(hits, F.lit(0))["i"]

    return F.struct(*[first(words).alias(role) for role, words in fixed.ROLE_KEYWORDS.items()])


def row_text(cells: Column, newline: str = "") -> Column:
    """Cells without line feeds, collapsed, joined by one space."""
    own = F.transform(cells, lambda c: strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", newline), r"\s+", " ")))
    return F.array_join(F.filter(own, lambda c: c != ""), " ")


def split_header_row(cells: Column) -> Column:
    """Later lines of a header cell move to the next empty cells; without one they stay in the cell.

    A fold over (cell, line): the state is the row so far and the first place still free to look at.
    """
    def jobs(trimmed: Column) -> Column:
        parts = F.flatten(F.transform(trimmed, lambda c, i: F.transform(F.filter(F.transform(F.split(c, "\n"), lambda p: strip(p)), lambda p: p != ""), lambda p, k: F.struct(i.alias("i"), k.alias("k"), p.alias("part")))))
        return F.filter(parts, lambda j: F.contains(F.get(trimmed, j["i"]), F.lit("\n")))

    def put(row: Column, at: Column, text: Column) -> Column:
        return F.transform(row, lambda c, i: F.when(i == at, text).otherwise(c))

    def step(state: Column, job: Column) -> Column:
        row = state["row"]
        begin = F.when(job["k"] == 0, job["i"] + 1).otherwise(state["next"])
        spot = F.get(F.filter(F.transform(row, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: (x["i"] >= begin) & (x["c"] == "")), F.lit(0))["i"]
        first = F.struct(put(row, job["i"], job["part"]).alias("row"), (job["i"] + 1).alias("next"))
        moved = F.struct(put(row, spot, job["part"]).alias("row"), (spot + 1).alias("next"))
        kept = F.struct(put(row, job["i"], strip(F.concat_ws(" ", F.get(row, job["i"]), job["part"]))).alias("row"), F.size(row).alias("next"))
        return F.when(job["k"] == 0, first).when(spot.isNotNull(), moved).otherwise(kept)

    folded = lambda trimmed: F.aggregate(jobs(trimmed), F.struct(trimmed.alias("row"), F.lit(0).alias("next")), step, lambda s: s["row"])
    # a row without line feeds has nothing to move; one with a null cell takes the fold as any other
    single = lambda trimmed: F.forall(trimmed, lambda c: c.isNotNull() & ~F.contains(c, F.lit("\n")))
    return let(F.transform(cells, lambda c: strip(c)), lambda trimmed: F.when(single(trimmed), trimmed).otherwise(folded(trimmed)))


def split_merged_headers(headers: Column) -> Column:
    """ "Withdrawals Deposits" before UNKNOWN becomes two names; so does UNKNOWN before "ChqNo Withdrawal"."""

    def is_pair(c: Column, pairs: list[tuple[str, str]]) -> Column:
        wanted = [F.array(*[F.lit(w) for w in sorted(p)]) for p in pairs]
        fits = lambda words: reduce(or_, [words == w for w in wanted])
        return let(F.split(strip(c), r"\s+"), lambda own: (F.size(own) == 2) & let(F.array_sort(F.transform(own, norm_header_word)), fits))

    unknown = lambda c: F.upper(strip(F.coalesce(c, F.lit("")))) == "UNKNOWN"
    word = lambda c, i: F.get(F.split(strip(c), r"\s+"), F.lit(i))

    # each round looks at its neighbours, so the row that it reads is worked out once and not once for each look
    def opposite(row: Column) -> Column:
        def after(c: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(row, i - 1))
            taken = unknown(c) & F.coalesce(is_pair(before, fixed.OPPOSITE_HEADERS), F.lit(False))
            gives = F.coalesce(unknown(F.get(row, i + 1)), F.lit(False)) & is_pair(c, fixed.OPPOSITE_HEADERS)
            return F.when(gives, word(c, 0)).when(taken, word(before, 1)).otherwise(c)

        return F.transform(row, after)

    def wrong(row: Column) -> Column:
        def after(c: Column, i: Column) -> Column:
            later = F.get(row, i + 1)
            taken = unknown(c) & F.coalesce(is_pair(later, fixed.WRONG_HEADERS), F.lit(False))
            gives = F.coalesce(unknown(F.when(i > 0, F.get(row, i - 1))) & (i > 0), F.lit(False)) & is_pair(c, fixed.WRONG_HEADERS)
            return F.when(taken, word(later, 0)).when(gives, word(c, 1)).otherwise(c)

        return F.transform(row, after)

    # both rounds change cells beside an unknown one only
    return let(headers, lambda row: F.when(F.exists(row, unknown), let(opposite(row), wrong)).otherwise(row))


def clean_entry_row(cells: Column) -> Column:
    one = lambda c: F.when(c.rlike(r"\s\s|[^\S ]"), F.regexp_replace(c, r"\s+", " ")).otherwise(F.coalesce(c, F.lit("")))
    return F.transform(cells, lambda c: strip(one(c)))


def looks_like_header(cells: Column) -> Column:
    """Mostly words, a date word and one more header group, no leading date, no summary text."""
    group = lambda low, words: low.rlike("|".join(rf"\b\Q{w}\E" + (r"\b" if len(w) <= 2 else "") for w in words)).cast("int")

    def fits(low: Column) -> Column:
        digits, letters = F.length(F.regexp_replace(low, r"\P{Nd}", "")), F.length(F.regexp_replace(low, r"\P{L}", ""))
        groups = sum((group(low, g) for g in fixed.HEADER_GROUPS), F.lit(0))
        return (letters > 0) & (digits <= letters) & (group(low, ("date",)) == 1) & (groups >= 2) & ~low.rlike(any_of(fixed.SUMMARY_MARKERS))

    # most rows hold no "date" and take no further look
    low = F.lower(F.array_join(cells, " "))
    return F.coalesce(F.when(F.contains(low, F.lit("date")), let(low, fits) & ~F.get(cells, F.lit(0)).rlike(fixed.LEADING_DATE)), F.lit(False))


def row_tokens(cells: Column) -> Column:
    """Distinct date, amount and reference tokens of a row, wherever they stand."""
    flat = split_money_cells(F.flatten(F.transform(cells, lambda c: F.split(F.coalesce(c, F.lit("")), "\n"))))

    def token(c: Column) -> Column:
        return let(F.struct(strip(c).alias("t"), parse_date_leading(c).alias("d"), parse_money(c)["value"].alias("v")), lambda x: named(x["t"], x["d"], x["v"]))

    def named(t: Column, d: Column, v: Column) -> Column:
        return F.when(d.isNotNull(), F.concat(F.lit("D:"), d.cast("string"))).when(v.isNotNull(), F.concat(F.lit("M:"), v.cast("string"))).when(t.rlike(r"^[A-Za-z0-9/\-]{8,}$") & t.rlike(r"\d"), F.concat(F.lit("R:"), t))

    return F.array_distinct(F.filter(F.transform(flat, token), lambda t: t.isNotNull()))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1))


def is_header_echo(low: Column, header_words: Column) -> Column:
    """Words only, and all of them header words."""
    own = words_of(low)
    return (F.size(own) > 0) & ~low.rlike(r"\d") & (F.size(F.array_except(own, header_words)) == 0)
