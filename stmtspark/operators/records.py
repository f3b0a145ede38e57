"""Labelled rows to records with dynamic headers, and the repair of their columns.

``rows``: statement_id, seq, cells, label.  ``headers``: statement_id, headers.  ``records``:
statement_id, seq, rec (map of header to text), headers.  All steps group by statement_id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stmtspark.functions import cells as C
from stmtspark.functions import fixed


def _by() -> WindowSpec:
    return Window.partitionBy("statement_id")


def _whole() -> WindowSpec:
    """All rows of a statement, sorted by seq as the running windows need them, so that rows are sorted once for all."""
    return _by().orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


DEFAULT_HEADERS = ["Date", "Particulars", "Cheque No", "Debit", "Credit", "Balance", "Remarks"]


def classify_rows(rows: DataFrame, model) -> DataFrame:
    """``rows`` with the label of a model; each distinct row text is scored once.

    ``model`` is a fitted pipeline whose ``transform`` gives label for text, or a function without arguments that a
    worker calls once to load its model: it returns a function from an array of texts to an array of label numbers
    (places in ``fixed.LABELS``), or to an array of one score for each label.  A number that is no label gives null.
    """
    text = rows.withColumn("text", C.row_text(F.col("cells")))
    texts = text.select("text").distinct()
    scored = model.transform(texts).select("text", "label") if hasattr(model, "transform") else predict_labels(texts, model)
    return text.drop("label").join(scored, "text").drop("text")


def predict_labels(texts: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 512) -> DataFrame:
    """``texts`` (text) with the label that a loaded model gives, ``batch_size`` texts at a time."""

    def loaded() -> Callable[[np.ndarray], np.ndarray]:
        model = load()

        def predict(batch: np.ndarray) -> np.ndarray:
            out = np.asarray(model(batch))
            return (out.argmax(axis=1) if out.ndim == 2 else out).astype(np.int64)

        return predict

    number = predict_batch_udf(loaded, return_type=LongType(), batch_size=batch_size)
    names = F.array(*[F.lit(n) for n in fixed.LABELS])
    return texts.withColumn("_number", number("text")).select(*texts.columns, F.when(F.col("_number") >= 0, F.get(names, F.col("_number").cast("int"))).alias("label"))


def rescue_header(rows: DataFrame) -> DataFrame:
    """In a statement without a header row, the first row that looks like one becomes header-kw."""
    none = ~F.max(F.col("label") == "header").over(_whole())
    first = F.min(F.when(C.looks_like_header(F.col("cells")), F.col("seq"))).over(_whole())
    return rows.withColumn("label", F.when(none & F.coalesce(F.col("seq") == first, F.lit(False)), "header-kw").otherwise(F.col("label")))


def drop_removed(rows: DataFrame) -> DataFrame:
    return rows.filter("label <> 'remove'")


def info_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("label = 'info'")


def with_headers(rows: DataFrame, alternative: DataFrame | None = None) -> DataFrame:
    """``rows`` with the headers of their statement: the first header row, else a fitting alternative, else defaults."""
    own = F.when(F.col("label") == "header", C.split_header_row(F.col("cells"))).otherwise(C.clean_entry_row(F.col("cells")))
    named = F.transform(own, lambda c: C.let(C.strip(c), lambda t: F.when(t == "", "UNKNOWN").otherwise(t)))
    is_head = F.col("label").isin("header", "header-kw")
    t = rows.withColumn("_own", F.when(is_head, C.let(named, C.split_merged_headers)))
    t = t.withColumns({"_own": F.min_by("_own", F.when(is_head, F.col("seq"))).over(_whole()), "_width": F.max(F.size("cells")).over(_whole())})
    default = F.transform(F.sequence(F.lit(1), F.greatest("_width", F.lit(1))), lambda i: F.coalesce(F.get(F.array(*[F.lit(h) for h in DEFAULT_HEADERS]), i - 1), F.concat(F.lit("UNKNOWN_"), i.cast("string"))))
    if alternative is None:
        return t.withColumn("headers", F.coalesce("_own", default)).drop("_own", "_width")
    cleaned = F.transform("_alt", lambda c: F.coalesce(F.nullif(C.strip(F.regexp_replace(c, r"\(\s*\)", "")), F.lit("")), F.lit("UNKNOWN")))
    fits = F.when(F.size("_alt") == F.col("_width"), cleaned)
    t = t.join(alternative.select("statement_id", F.col("headers").alias("_alt")), "statement_id", "left")
    return t.withColumn("headers", F.coalesce("_own", fits, default)).drop("_own", "_width", "_alt")


def resolve_headers(rows: DataFrame, alternative: DataFrame | None = None) -> DataFrame:
    """(statement_id, headers) of each statement."""
    return with_headers(rows, alternative).groupBy("statement_id").agg(F.first("headers").alias("headers"))


def build_records(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One record per entry row; its c-entry rows append their cells to the same columns.

    Without ``headers`` (statement_id, headers) each statement's own are used, in the same partitioning.
    Of columns of one name the last gives the entry's cell.
    """
    t = with_headers(rows) if headers is None else rows.join(headers, "statement_id")
    so_far = _by().orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = t.filter(F.col("label").isin("entry", "c-entry")).withColumn("record", F.sum((F.col("label") == "entry").cast("int")).over(so_far)).filter("record > 0")
    # null, blank and absent cells of a row are "" in an entry and nothing in a continuation; an entry is a record's first row
    kept = kept.withColumn("cells", C.clean_entry_row(F.col("cells")))
    own = Window.partitionBy("statement_id", "record").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = kept.withColumn("more", F.collect_list(F.when(F.col("label") == "c-entry", F.col("cells"))).over(own)).filter("label = 'entry'")
    heads = F.col("headers")

    def text(h: Column) -> Column:
        # the place of the last column of this name
        first = F.coalesce(F.get("cells", (F.size(heads) - F.array_position(F.reverse(heads), h)).cast("int")), F.lit(""))
        more = F.flatten(F.transform("more", lambda p: F.filter(p, lambda c, i: (c != "") & F.coalesce(F.get(heads, i) == h, F.lit(False)))))
        return F.when(F.size("more") == 0, first).otherwise(C.strip(F.array_join(F.concat(F.array(first), more), " ")))

    one = one.withColumn("_names", F.array_distinct(heads))
    # most rows have no continuation and no columns of one name, and give their cells as they stand
    plain = (F.size("more") == 0) & (F.size("_names") == F.size(heads))
    rec = F.map_from_arrays("_names", F.when(plain, F.transform("_names", lambda _, i: F.coalesce(F.get("cells", i), F.lit("")))).otherwise(F.transform("_names", text)))
    return one.select("statement_id", F.col("record").cast("int").alias("seq"), rec.alias("rec"), F.col("_names").alias("headers"))


def _value(key: Column) -> Column:
    return C.strip(F.coalesce(F.element_at("rec", key), F.lit("")))


def _with(rec: Column, changes: list[tuple[Column, Column]]) -> Column:
    """The map with the values of some keys replaced; null keys change nothing."""

    def new(k: Column, v: Column) -> Column:
        out = v
        for key, value in changes:
            out = F.when(k == key, value).otherwise(out)
        return out

    return F.transform_values(rec, new)


def _description_column(headers: Column) -> Column:
    pattern = "|".join(fixed.DESCRIPTION_HEADERS)
    return F.get(F.filter(headers, lambda h: F.lower(h).rlike(pattern)), F.lit(0))


def _before(headers: Column, name: Column) -> Column:
    """The headers to the left of one; none if it is null."""
    return F.slice(headers, F.lit(1), F.greatest(F.coalesce(F.array_position(headers, name), F.lit(0)).cast("int") - 1, F.lit(0)))


def _peeled(cell: Column) -> Column:
    """struct<rest, found>: the date texts that lead a cell, one after the other."""

    def peel(s: Column, _: Column) -> Column:
        hit = F.regexp_extract(s["rest"], fixed.COLLAPSED_DATE, 1)
        rest = F.regexp_replace(F.regexp_replace(s["rest"], fixed.COLLAPSED_DATE, ""), r"^\s+", "")
        return C.let(hit, lambda h: F.when(h == "", s).otherwise(F.struct(rest.alias("rest"), F.concat(s["found"], F.array(h)).alias("found"))))

    # a date takes six characters at least, so the cell's length bounds the number of peels
    steps = F.sequence(F.lit(1), F.greatest(F.floor(F.length(cell) / 6).cast("int"), F.lit(1)))
    return F.aggregate(steps, F.struct(cell.alias("rest"), F.array().cast("array<string>").alias("found")), peel)


def _date_columns(records: DataFrame) -> DataFrame:
    """``records`` with _desc, the description column, and _dates, the date columns to its left."""
    if "_desc" in records.columns:
        return records
    t = records.withColumn("_desc", _description_column(F.col("headers")))
    return t.withColumn("_dates", F.filter(_before(F.col("headers"), F.col("_desc")), _is_date))


def _is_date(h: Column) -> Column:
    return F.contains(F.lower(h), F.lit("date"))


def repair_collapsed_dates(records: DataFrame) -> DataFrame:
    """Several dates in one date cell, with the first date column empty, go to the date columns in order."""
    return _spread_dates(_date_columns(records)).drop("_desc", "_dates")


def _spread_dates(t: DataFrame) -> DataFrame:
    rec, desc, dates = F.col("rec"), F.col("_desc"), F.col("_dates")

    def spread(p: Column) -> Column:
        text = F.concat_ws(" ", F.nullif(p["rest"], F.lit("")), C.strip(F.element_at(rec, desc)))
        new = lambda k, v: F.when(F.array_contains(dates, k), F.coalesce(F.get(p["found"], F.array_position(dates, k).cast("int") - 1), F.lit(""))).when(k == desc, C.strip(text)).otherwise(v)
        return F.when(F.size(p["found"]) >= 2, F.transform_values(rec, new)).otherwise(rec)

    source = F.get(F.filter(F.slice(dates, 2, 1000), lambda h: _value(h) != ""), F.lit(0))
    empty = F.coalesce(_value(F.get(dates, F.lit(0))) == "", F.lit(False))
    fixed_rec = C.let(source, lambda h: F.when(h.isNotNull(), C.let(_value(h), lambda cell: F.when(cell.rlike(fixed.COLLAPSED_DATE), C.let(_peeled(cell), spread)))))
    return t.withColumn("rec", F.coalesce(F.when(empty, fixed_rec), rec))


def relocate_leading_date(records: DataFrame) -> DataFrame:
    """A date that leads the description moves to its empty date column; text after a date moves back."""
    return _relocated(_date_columns(records)).drop("_desc", "_dates")


def _relocated(t: DataFrame) -> DataFrame:
    rec, desc, left = F.col("rec"), F.col("_desc"), F.col("_dates")

    def moved(date: Column, d: Column, x: Column) -> Column:
        to_date = C.let(C.leading_date(x), lambda xl: F.when(xl["date"] != "", _with(rec, [(date, xl["date"]), (desc, xl["rest"])])))
        to_text = C.let(C.leading_date(d), lambda dl: F.when((dl["date"] != "") & dl["rest"].rlike("[A-Za-z]"), _with(rec, [(date, dl["date"]), (desc, C.strip(F.concat_ws(" ", dl["rest"], x)))])))
        # only a text with a digit leads with a date
        return F.when(d == "", F.when(x.rlike("[0-9]"), to_date)).otherwise(F.when(d.rlike("[A-Za-z]"), to_text))

    date = F.coalesce(F.get(left, F.size(left) - 1), F.get(F.filter("headers", _is_date), F.lit(0)))
    pair = lambda h: F.when(h.isNotNull() & (h != desc), C.let(F.struct(_value(h).alias("d"), _value(desc).alias("x")), lambda v: moved(h, v["d"], v["x"])))
    return t.withColumn("rec", F.coalesce(F.when(desc.isNotNull(), C.let(date, pair)), rec))


def repair_dates(records: DataFrame) -> DataFrame:
    """Both repairs of dates in their order, with the description and date columns looked up once."""
    return _relocated(_spread_dates(_date_columns(records))).drop("_desc", "_dates")


def column_statistics(records: DataFrame) -> DataFrame:
    """(statement_id, header, i, dates, blank, filled, flagged) in one pass over the exploded records."""
    cols = records.select("statement_id", "seq", F.posexplode("headers").alias("i", "header"), "rec").withColumn("v", _value(F.col("header"))).drop("rec")
    cols = C.dated_cells(cols, "v", "day").selectExpr("*", f"v RLIKE r'{fixed.AMOUNT_FLAG}' AS marked")
    return cols.groupBy("statement_id", "header").agg(
        F.min("i").alias("i"),
        F.expr("count(day)").alias("dates"),
        F.expr("min(v = '')").alias("blank"),
        F.expr("count_if(v <> '')").alias("filled"),
        F.expr("count_if(marked)").alias("flagged"),
        F.min("seq").alias("least"),
        F.max("seq").alias("most"),
    )


def column_profile(records: DataFrame) -> DataFrame:
    """One row per statement from one pass over the exploded records: date_col, hits, blank headers and the amount column."""
    norm = F.replace(F.lower("header"), F.lit(" "), F.lit(""))
    fits = ~norm.rlike("balance|date") & (F.col("filled") > 0) & (F.col("flagged") * 10 >= F.col("filled") * 6)
    return column_statistics(records).groupBy("statement_id").agg(
        F.max_by("header", F.struct("dates", -F.col("i"))).alias("date_col"),
        F.max("dates").alias("hits"),
        F.collect_set(F.when(F.col("blank"), F.col("header"))).alias("blanks"),
        F.min_by("header", F.when(fits, F.col("i"))).alias("amount"),
        (F.max(norm.rlike("debit|withdrawal")) & F.max(norm.rlike("credit|deposit"))).alias("paired"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


_PROFILE = ("date_col", "hits", "blanks", "amount", "paired", "least", "most")


def _marks(headers: Column) -> Column:
    """One digit for each header: 0 for a blank cell, else 1, with 2 more for a date and 4 more for an amount with a mark."""
    # how a text starts that ``row_date`` can read; amounts and narrations take no further look
    may_date = r"^(?:\d{4}-|\d{1,2}[/.\-\s]|[A-Za-z]{3,9} ?\d{1,2}, \d{4}$)"
    date = lambda v: F.when(v.rlike(may_date) & C.row_date(v).isNotNull(), 2).otherwise(0)
    mark = lambda v: F.when(v.rlike(fixed.AMOUNT_FLAG), 4).otherwise(0)
    return F.array_join(F.transform(headers, lambda h: C.let(_value(h), lambda v: F.when(v == "", "0").otherwise((F.lit(1) + date(v) + mark(v)).cast("string")))), "")


def _profile_of(kinds: Column) -> Column:
    """The profile of a statement from its kinds of rows: struct<headers, marks, n>, one for each that occurs."""

    def statistics(cells: Column) -> Column:
        def one(h: Column) -> Column:
            zero = F.struct(F.lit(None).cast("int").alias("i"), F.lit(0).cast("long").alias("dates"), F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("flagged"))
            count = lambda c, bits: F.when(c["m"].isin(bits), c["n"]).otherwise(0)
            add = lambda s, c: F.struct(F.least(s["i"], c["i"]).alias("i"), (s["dates"] + count(c, ["3", "7"])).alias("dates"), (s["filled"] + count(c, ["1", "3", "5", "7"])).alias("filled"), (s["flagged"] + count(c, ["5", "7"])).alias("flagged"))
            return F.aggregate(F.filter(cells, lambda c: c["h"] == h), zero, add, lambda s: F.struct(h.alias("h"), F.replace(F.lower(h), F.lit(" "), F.lit("")).alias("norm"), s["i"].alias("i"), s["dates"].alias("dates"), s["filled"].alias("filled"), s["flagged"].alias("flagged")))

        return F.transform(F.array_distinct(F.transform(cells, lambda c: c["h"])), one)

    def profile(columns: Column) -> Column:
        fits = lambda c: (c["filled"] > 0) & (c["flagged"] * 10 >= c["filled"] * 6) & ~c["norm"].rlike("balance|date")
        amount = F.array_min(F.transform(F.filter(columns, fits), lambda c: F.struct(c["i"].alias("i"), c["h"].alias("h"))))["h"]
        best = F.array_max(F.transform(columns, lambda c: F.struct(c["dates"].alias("dates"), (-c["i"]).alias("i"), c["h"].alias("h"))))
        named = lambda words: F.exists(columns, lambda c: c["norm"].rlike(words))
        blanks = F.transform(F.filter(columns, lambda c: c["filled"] == 0), lambda c: c["h"])
        return C.let(best, lambda b: F.struct(b["h"].alias("date_col"), b["dates"].alias("hits"), blanks.alias("blanks"), amount.alias("amount"), (named("debit|withdrawal") & named("credit|deposit")).alias("paired")))

    cells = F.flatten(F.transform(kinds, lambda k: F.transform(k["headers"], lambda h, i: F.struct(h.alias("h"), i.alias("i"), F.substring(k["marks"], i + 1, F.lit(1)).alias("m"), k["n"].alias("n")))))
    return C.let(cells, lambda x: C.let(statistics(x), profile))


def _profiled(records: DataFrame) -> DataFrame:
    """``records`` with the profile of their statement.

    Rows of a statement have few kinds: which columns are blank, dates or marked amounts.  The kinds are counted by a window, and
    the first row of a statement works the profile out for all, so records are neither exchanged again nor worked out twice.
    """
    if "date_col" in records.columns:
        return records
    kind = Window.partitionBy("statement_id", "_marks", "headers").orderBy("seq")
    full = (Window.unboundedPreceding, Window.unboundedFollowing)
    t = records.withColumn("_marks", _marks(F.col("headers")))
    t = t.withColumns({"_nth": F.row_number().over(kind), "_n": F.count("*").over(kind.rowsBetween(*full))})
    by_kind = _by().orderBy("_marks", "headers", "seq")
    t = t.withColumns(
        {
            "_kinds": F.collect_list(F.when(F.col("_nth") == 1, F.struct("headers", F.col("_marks").alias("marks"), F.col("_n").alias("n")))).over(by_kind.rowsBetween(*full)),
            "_row": F.row_number().over(by_kind),
            "least": F.min("seq").over(by_kind.rowsBetween(*full)),
            "most": F.max("seq").over(by_kind.rowsBetween(*full)),
        }
    )
    t = t.withColumn("_profile", F.when(F.col("_row") == 1, _profile_of(F.col("_kinds")))).drop("_kinds", "_nth", "_n", "_marks")
    t = t.withColumn("_profile", F.first("_profile").over(_by().orderBy("_row").rowsBetween(*full)))
    return t.select(*records.columns, *[F.col(f"_profile.{n}").alias(n) if n not in ("least", "most") else F.col(n) for n in _PROFILE])


def to_chronological(records: DataFrame) -> DataFrame:
    """Statements whose dated rows step down more than up are reversed; nothing is sorted."""
    return _chronological(_profiled(records)).drop(*_PROFILE)


def _chronological(t: DataFrame) -> DataFrame:
    t = C.dated_cells(t.withColumn("_dated", F.expr("CASE WHEN hits >= 2 THEN element_at(rec, date_col) END")), "_dated", "day").drop("_dated")
    before = F.last("day", ignorenulls=True).over(_by().orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("step", F.when(F.col("day") > before, 1).when(F.col("day") < before, -1).otherwise(0))
    t = t.withColumn("down", F.sum("step").over(_by()) < 0)
    return t.withColumn("seq", F.when(F.col("down"), F.col("most") + F.col("least") - F.col("seq")).otherwise(F.col("seq"))).drop("day", "step", "down")


def _without_blank(t: DataFrame, pattern: str) -> DataFrame:
    gone = F.filter(F.coalesce("blanks", F.array().cast("array<string>")), lambda h: F.lower(h).rlike(pattern))
    t = t.withColumn("gone", gone)
    return t.withColumns({"rec": F.map_filter("rec", lambda k, _: ~F.array_contains("gone", k)), "headers": F.array_except("headers", "gone")}).drop("gone")


def drop_empty_date_columns(records: DataFrame) -> DataFrame:
    return _without_blank(_profiled(records), "date").drop(*_PROFILE)


def drop_empty_optional_columns(records: DataFrame) -> DataFrame:
    return _without_blank(_profiled(records), C.any_of(fixed.OPTIONAL_HEADERS)).drop(*_PROFILE)


def split_amount_dr_cr(records: DataFrame) -> DataFrame:
    """One amount column with marks becomes Debit and Credit, where no such pair is there yet."""
    return _split_amount(_profiled(records)).drop(*_PROFILE)


def _split_amount(t: DataFrame) -> DataFrame:
    t = t.withColumn("amount", F.when(~F.col("paired"), F.col("amount"))).withColumn("flag", C.amount_flag(_value(F.col("amount"))))
    new = F.map_concat(F.map_filter("rec", lambda k, _: ~k.isin("Debit", "Credit") & (k != F.col("amount"))), F.create_map(F.lit("Debit"), F.when(F.col("flag.flag") == "dr", F.col("flag.number")).otherwise(""), F.lit("Credit"), F.when(F.col("flag.flag") == "cr", F.col("flag.number")).otherwise("")))
    heads = F.flatten(F.transform("headers", lambda h: F.when(h == F.col("amount"), F.array(F.lit("Debit"), F.lit("Credit"))).otherwise(F.array(h))))
    return t.withColumns({"rec": F.when(F.col("amount").isNotNull(), new).otherwise(F.col("rec")), "headers": F.when(F.col("amount").isNotNull(), heads).otherwise(F.col("headers"))}).drop("flag")


def stream_records(txns: DataFrame) -> DataFrame:
    """Finished transactions as records: no type, money with two places, nulls as ""."""
    text = {"Date": F.col("date").cast("string"), "Description": F.col("description"), "Reference": F.col("reference"), "Debit": C.format_cell(F.col("debit")), "Credit": C.format_cell(F.col("credit")), "Balance": C.format_cell(F.col("balance"))}
    rec = F.create_map(*[x for k, v in text.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    return txns.select("statement_id", "seq", rec.alias("rec"), F.array(*[F.lit(k) for k in text]).alias("headers"))


def shape_records(records: DataFrame) -> DataFrame:
    """All repairs in their order; the column statistics are taken once, after the dates are in place.

    Dropping blank date and identifier columns changes no other column's statistics.
    """
    t = _chronological(_profiled(repair_dates(records)))
    return _split_amount(_without_blank(t, "date|" + C.any_of(fixed.OPTIONAL_HEADERS))).drop(*_PROFILE)
