"""Statement cells to transactions, with one hash partitioning on statement_id.

Every sequential rule of a statement is a window over (statement_id, seq) or an array function over
the rows of one transaction.  Row flags are worked out once, before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtspark.functions import cells as C
from stmtspark.functions import fixed

PROFILE = T.StructType(
    [
        T.StructField("bank", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("header_keywords", T.ArrayType(T.StringType())),
        T.StructField("debit_col", T.IntegerType()),
        T.StructField("credit_col", T.IntegerType()),
        T.StructField("header_lines", T.IntegerType()),
        *[T.StructField(n, T.BooleanType()) for n in ("explode_newlines", "find_ref_tokens", "no_reference", "narration_around", "drop_code_cells", "serial_col", "glue_hard_wraps")],
    ]
)


def profiles(spark: SparkSession) -> DataFrame:
    """The layout profiles, one row per bank: 13 rows, so a broadcast is safe."""
    rows = []
    for bank, p in fixed.PROFILES.items():
        rows.append(tuple({"bank": bank, "header_lines": 1, **p}.get(f.name, False if isinstance(f.dataType, T.BooleanType) else None) for f in PROFILE.fields))
    return spark.createDataFrame(rows, PROFILE)


def raw_pieces(raw: Column, engine: Column, explode: Column, around: Column) -> Column:
    """Cells of a row before they are cleaned: apart at line feeds or runs of spaces, where the layout needs it."""
    exploded = F.flatten(F.transform(raw, lambda c: F.split(F.coalesce(c, F.lit("")), "\n")))
    spread = F.filter(F.split(C.strip(F.get(raw, F.lit(0))), r"\s{2,}"), lambda c: c != "")
    return F.when(explode & ~around, exploded).when((engine == "linear") & (F.size(raw) == 1) & ~around, spread).otherwise(raw)


_KEY = ["statement_id", "reading"]
_ROW = [*_KEY, "page", "table_no", "row_no"]


#: Transactions that one task takes.  A task sorts its rows some twenty times, 16 KB a transaction in all.
TASK_TRANSACTIONS = 100_000


def dealt(df: DataFrame, expected: int | None = None) -> DataFrame:
    """Rows exchanged once by statement_id; ``expected`` is about how many transactions they hold.

    Without it, or where a few tasks for each core hold them, the engine puts small partitions together by their bytes.  These
    are compressed and say little of what the rows take in a task, so from there on the number of partitions grows with the input.
    """
    spark = df.sparkSession
    if expected is None or expected <= 2 * TASK_TRANSACTIONS * spark.sparkContext.defaultParallelism:
        return df.repartition("statement_id")
    return df.repartition(-(-expected // TASK_TRANSACTIONS), "statement_id")


def row_facts(cells: DataFrame, banks: DataFrame, expected: int | None = None) -> DataFrame:
    """(statement_id, reading, page, table_no, row_no, bank, facts): each row's cells as the parser sees them, and what they say.

    ``reading`` tells apart several readings of one statement: twice the cells' variant (0 if they have none) and
    the banks' rescue (0 if they have none).  The cells are exchanged once by statement_id, then taken apart, cleaned
    and parsed as plain columns, and gathered in the same partitions.
    """
    variant = "cast(variant AS int)" if "variant" in cells.columns else "0"
    rescue = "cast(rescue AS int)" if "rescue" in banks.columns else "0"
    own = F.broadcast(profiles(cells.sparkSession).select("bank", "engine", "narration_around", "explode_newlines", "serial_col"))
    raw = dealt(cells.selectExpr("statement_id", f"{variant} AS variant", "page", "table_no", "row_no", "cells"), expected)
    # the few columns of banks are hashed in each partition, so the cells stay where the exchange has put them
    own = banks.selectExpr("statement_id", f"{rescue} AS rescue", "bank").join(own, "bank").hint("shuffle_hash")
    rows = raw.join(own, "statement_id").withColumn("reading", F.expr("variant * 2 + rescue"))
    t = rows.select(*_ROW, "bank", "serial_col", F.posexplode_outer(raw_pieces(F.col("cells"), F.col("engine"), F.col("explode_newlines"), F.col("narration_around"))).alias("i0", "raw"))
    t = C.cleaned(t, "raw", "c")
    c = F.expr("CASE WHEN serial_col AND i0 = 0 AND c RLIKE r'^[0-9]{1,4}$' THEN '' ELSE c END")
    t = t.select(*_ROW, "bank", "i0", F.posexplode(C.split_money_cells(F.array(c))).alias("i1", "text"))
    one = C.parsed_cells(t).groupBy(*_ROW, "bank").agg(F.expr("sort_array(collect_list(struct(i0, i1, text, lead, date, value, sign))) AS f"))
    return one.selectExpr(*_ROW, "bank", "transform(f, (x, i) -> struct(i, x.text AS text, x.lead AS lead, x.date AS date, x.value AS value, x.sign AS sign)) AS facts")


def _rows(cells: DataFrame, banks: DataFrame, expected: int | None = None) -> DataFrame:
    """Rows with profile, sequence and flags; partitioned by statement_id."""
    rows = row_facts(cells, banks, expected).join(F.broadcast(profiles(cells.sparkSession)), "bank").withColumn("own", F.expr("transform(facts, f -> f.text)"))
    rows = rows.withColumn("joined", C.strip(F.array_join("own", " "))).withColumns({"low": F.expr("lower(joined)"), "d": C.first_date(F.col("facts")), "b": C.last_balance(F.col("facts"))})
    # what the windows carry along: flags and the facts, no texts of whole rows
    rows = rows.select(
        *_ROW, *[f.name for f in PROFILE.fields if f.name not in ("header_keywords", "bank", "serial_col")], "own", "facts",
        F.expr("header_keywords IS NOT NULL AS headed"), F.expr("d.i AS date_i"), F.expr("d.lead AS date"), F.expr("b.i AS bal_i"), C.signed(F.col("b")).alias("bal"),
        F.expr(r"joined RLIKE r'[\p{L}\p{N}]' AS alnum"),
        C.has_all(F.col("low"), F.col("header_keywords")).alias("is_head"),
        (C.is_footer_start(F.col("low")) | F.expr(r"coalesce(d.text RLIKE r'\d{1,2}:\d{2}:\d{2}', false)")).alias("is_footer"),
        C.is_opening(F.col("low")).alias("is_opening"), C.is_noise(F.col("low")).alias("is_noise"),
        F.when(F.col("narration_around"), C.words_of(F.col("low"))).alias("words"), F.expr(r"low RLIKE '[0-9]' AS digits"),
    )
    rows = rows.withColumns(
        {
            "seq": F.row_number().over(_by().orderBy("page", "table_no", "row_no")),
            "leading": F.expr("coalesce(forall(slice(own, 1, coalesce(date_i, 0)), c -> c = '') AND date_i IS NOT NULL, false)"),
            "dated": F.expr("date IS NOT NULL AND bal IS NOT NULL AND coalesce(date_i < bal_i, false)"),
            "rest": F.expr("CASE WHEN engine = 'linear' THEN bal IS NOT NULL OR exists(facts, f -> f.i <> date_i AND (f.value IS NOT NULL OR f.text RLIKE '[A-Za-z]')) END"),
            "colmap0": F.when(F.expr("is_head AND NOT narration_around"), C.build_colmap(F.col("own"))),
        }
    )
    rows = rows.drop("own")
    return rows.withColumns(
        {
            "looks_txn": F.expr("CASE WHEN engine = 'linear' THEN date IS NOT NULL AND leading AND rest WHEN narration_around THEN dated AND leading ELSE dated END"),
            "table_test": F.expr("CASE WHEN engine = 'linear' THEN date IS NOT NULL AND leading ELSE dated END"),
        }
    )


def _by() -> WindowSpec:
    return Window.partitionBy(*_KEY)


def _so_far() -> WindowSpec:
    return _by().orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _mark(facts: Column, bal_i: Column) -> Column:
    """The first cell other than the balance with an amount and a mark, or null."""
    return F.get(F.filter(facts, lambda f: f["value"].isNotNull() & f["sign"].isNotNull() & F.coalesce(f["i"] != bal_i, F.lit(True))), F.lit(0))


def _opening() -> Column:
    """The first balance of an opening row, on every row of the statement."""
    return F.min_by("bal", F.when(F.col("opens") & F.col("bal").isNotNull(), F.col("seq"))).over(_by())


def openings_of(parsed: DataFrame) -> DataFrame:
    """(statement_id, opening) of every parsed statement."""
    return parsed.groupBy("statement_id").agg(F.first("opening", ignorenulls=True).alias("opening"))


def _extend_reference(ref: Column, conts: Column, drop: Column) -> Column:
    """struct<ref, text> after the continuation rows of a layout whose reference column wraps, in order."""

    def row(state: Column, r: Column) -> Column:
        texts = F.filter(F.transform(r["facts"], lambda f: F.struct(C.strip(f["text"]).alias("t"), f["value"].isNotNull().alias("money"))), lambda x: x["t"] != "")
        loose = lambda x: (state["ref"] != "") & ~F.contains(x["t"], F.lit(" ")) & ~x["money"] & x["t"].rlike(r"\d") & ~x["t"].rlike(r"[A-Za-z]{2,}")
        kept = F.transform(F.filter(texts, lambda x: ~loose(x)), lambda x: x["t"])
        solid = F.replace(F.array_join(kept, " "), F.lit(" "), F.lit(""))
        start = F.struct(state["ref"].alias("ref"), kept.alias("cells"))

        def fragment(s: Column, x: Column) -> Column:
            longer = F.concat(s["ref"], x["t"])
            fits = F.contains(solid, longer)
            return F.struct(F.when(fits, longer).otherwise(s["ref"]).alias("ref"), F.when(fits, s["cells"]).otherwise(F.concat(s["cells"], F.array(x["t"]))).alias("cells"))

        done = F.aggregate(F.filter(texts, loose), start, fragment)
        extra = C.row_description(C.facts(done["cells"]), F.lit(None).cast("int"), r["bal_i"], done["ref"], drop)
        return F.struct(done["ref"].alias("ref"), C.strip(F.concat_ws(" ", state["text"], extra)).alias("text"))

    return F.aggregate(conts, F.struct(ref.alias("ref"), F.lit("").alias("text")), row)


def join_fragments(parts: Column, glued: Column | None = None) -> Column:
    """Texts of an array<struct<text, glue>> joined; no space after a glued text or one that ends in "-".

    ``glued`` says whether gluing is on at all (null: every text is followed by a space).
    """
    on = F.lit(False) if glued is None else glued

    def step(s: Column, p: Column) -> Column:
        gap = F.when((s["n"] > 0) & ~s["glue"], " ").otherwise("")
        return F.struct(F.concat(s["out"], gap, p["text"]).alias("out"), (s["n"] + 1).alias("n"), (on & (F.coalesce(p["glue"], F.lit(False)) | p["text"].endswith("-"))).alias("glue"))

    return F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("glue")), step, lambda s: C.strip(s["out"]))


def parsed(cells: DataFrame, banks: DataFrame, glue: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """Transactions of statements of all layouts, before ``finalize``, each row parsed once.

    ``cells`` has statement_id, page, table_no, row_no, cells; ``banks`` has statement_id and bank; ``glue``
    (statement_id, text) has the narration lines that were broken inside a word.  In columnar and linear layouts rows
    after a transaction continue it; in the layouts with narration around, text rows join the next or the last
    amount row.  A statement that does not begin with a transaction has a row more, with bare true: it carries the
    opening balance, so that one pass gives both.  ``expected`` is about how many transactions there are (see ``dealt``).
    """
    rows = _rows(cells, banks, expected)
    head_ok = F.expr("alnum AND is_head AND (NOT narration_around OR NOT (is_footer OR is_opening OR is_noise))")
    rows = rows.withColumn("start", F.when(~F.col("headed"), 0).otherwise(F.min(F.when(head_ok, F.col("seq"))).over(_by())))
    # layouts with narration around see footers, openings and noise before their header too
    rows = rows.withColumn("base", F.expr("alnum AND (narration_around OR coalesce(seq > start, false))"))
    rows = rows.withColumns({"foots": F.expr("base AND is_footer"), "opens": F.expr("base AND NOT is_footer AND is_opening"), "fit": F.expr("base AND NOT is_footer AND NOT is_opening AND NOT is_noise AND (narration_around OR NOT is_head)")})
    # the header row and the fitting rows that follow it, as many as the profile has header lines
    after = F.expr("narration_around AND fit AND coalesce(seq >= start, false) AND headed")
    rows = rows.withColumn("heads", F.coalesce(F.when(after, F.sum(after.cast("int")).over(_so_far()) <= F.col("header_lines")), F.lit(False)))
    rows = rows.withColumns(
        {
            "header_words": F.flatten(F.collect_list(F.when(F.col("heads"), F.col("words"))).over(_by())),
            "colmap": F.first(F.when(F.expr("seq = start"), F.col("colmap0")), ignorenulls=True).over(_by()),
            "table_txn": F.max("table_test").over(Window.partitionBy(*_KEY, "page", "table_no")),
            "opening": _opening(),
            "ref0": F.when(F.col("no_reference"), "").otherwise(C.row_reference(F.col("facts"), F.col("bal_i"), F.col("find_ref_tokens"))),
        }
    )
    echo = F.expr("narration_around AND NOT digits AND coalesce(size(words) > 0 AND size(array_except(words, header_words)) = 0, false)")
    rows = rows.withColumn("live", F.expr("fit AND (NOT narration_around OR coalesce(seq > start, false)) AND NOT heads") & ~echo).withColumn("txn", F.expr("live AND looks_txn"))
    rows = rows.withColumns(
        {
            "in_footer": F.coalesce(F.last(F.when(F.col("foots"), True).when(F.col("txn"), False), ignorenulls=True).over(_so_far()), F.lit(False)),
            "txn_id": F.sum(F.col("txn").cast("int")).over(_so_far()),
            "ref": F.when(F.col("narration_around"), F.expr("CASE WHEN txn THEN ref0 ELSE '' END")).otherwise(F.last(F.when(F.col("txn"), F.col("ref0")), ignorenulls=True).over(_so_far())),
        }
    )
    rows = rows.withColumn("text", C.row_description(F.col("facts"), F.when(F.col("txn"), F.col("date_i")), F.col("bal_i"), F.col("ref"), F.col("drop_code_cells")))
    more = """CASE WHEN narration_around THEN live AND NOT txn AND NOT in_footer AND (txn_id > 0 OR headed) AND text <> ''
              ELSE fit AND NOT txn AND NOT in_footer AND txn_id > 0 AND NOT leading AND table_txn END"""
    rows = rows.withColumn("more", F.expr(f"coalesce({more}, false)")).withColumn("bare", F.expr("NOT txn AND NOT more AND seq = 1"))
    amount = C.classify_amount(F.col("facts"), F.col("bal_i"), F.coalesce("debit_col", "colmap.debit"), F.coalesce("credit_col", "colmap.credit"))
    items = rows.filter("txn OR more OR bare").select(
        *_KEY, "bare", "opening", "seq", "txn", "txn_id", "date", "bal", "bal_i", "ref", "text", "narration_around", "explode_newlines", "drop_code_cells", "no_reference", "glue_hard_wraps",
        amount.alias("amount"), F.when(~F.col("narration_around"), _mark(F.col("facts"), F.col("bal_i"))).alias("mark"), F.when(F.expr("explode_newlines AND NOT txn"), F.col("facts")).alias("facts"),
    )
    group = _targeted(items, glue).groupBy(*_KEY, "bare", "target").agg(
        F.expr("max(CASE WHEN txn OR bare THEN seq END) AS seq"),
        *[F.expr(f"first({c}) AS {c}") for c in ("opening", "narration_around", "explode_newlines", "drop_code_cells", "no_reference", "glue_hard_wraps")],
        *[F.expr(f"first(CASE WHEN txn THEN {c} END, true) AS {c}") for c in ("date", "ref", "amount")],
        F.expr("min_by(bal, CASE WHEN bal IS NOT NULL AND (txn OR NOT narration_around) THEN seq END) AS balance"),
        F.expr("min_by(mark, CASE WHEN mark IS NOT NULL THEN seq END) AS mark"),
        F.expr("sort_array(collect_list(struct(seq, text, glue, facts, bal_i))) AS parts"),
    )
    filled = F.expr("filter(parts, p -> p.text <> '')")
    wrapped = _extend_reference(F.col("ref"), F.expr("slice(parts, 2, size(parts))"), F.col("drop_code_cells"))
    group = group.withColumn("w", F.when(F.col("explode_newlines"), wrapped))
    text = F.when(F.col("explode_newlines"), C.strip(F.expr("concat_ws(' ', parts[0].text, w.text)"))).when(F.col("glue_hard_wraps"), join_fragments(filled, F.col("glue_hard_wraps")))
    group = group.withColumn("description", text.otherwise(C.strip(F.array_join(F.transform(filled, lambda p: p["text"]), " "))))
    around = F.when(F.col("no_reference"), "").otherwise(F.coalesce(F.expr("nullif(ref, '')"), C.guess_reference(F.col("description"))))
    reference = F.when(F.col("narration_around"), around).otherwise(F.expr("coalesce(w.ref, ref)"))
    return group.select(*_KEY, "bare", "opening", "seq", "date", "description", reference.alias("reference"), "balance", F.expr("mark.value AS amt_value"), F.expr("mark.sign AS amt_sign"), F.expr("amount.debit AS col_dr"), F.expr("amount.credit AS col_cr"))


def _targeted(items: DataFrame, glue: DataFrame | None) -> DataFrame:
    """Items with the transaction that each belongs to, and whether their text is glued to the next."""
    own = Window.partitionBy(*_KEY, "bare").orderBy("seq")
    ahead, behind = own.rowsBetween(Window.currentRow, Window.unboundedFollowing), own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    items = items.withColumn("n", F.row_number().over(own))
    items = items.withColumn("_here", F.expr("CASE WHEN txn THEN struct(n, text) END"))
    items = items.withColumns({"_next": F.first("_here", ignorenulls=True).over(ahead), "_prev": F.last("_here", ignorenulls=True).over(behind)})
    target = "CASE WHEN bare OR (narration_around AND txn) THEN n WHEN NOT narration_around THEN txn_id WHEN _next.n = n + 1 AND _next.text = '' THEN _next.n ELSE coalesce(_prev.n, _next.n) END"
    items = items.withColumn("target", F.expr(target)).filter("target IS NOT NULL").drop("_here", "_next", "_prev")
    if glue is None:
        return items.withColumn("glue", F.lit(False))
    # one row of texts for each statement, so that the rows stay in their partitions
    texts = glue.groupBy("statement_id").agg(F.collect_set("text").alias("glued_texts"))
    return items.join(texts.hint("shuffle_hash"), "statement_id", "left").withColumn("glue", F.expr("coalesce(array_contains(glued_texts, text), false)")).drop("glued_texts")


def parse_rows(cells: DataFrame, banks: DataFrame) -> DataFrame:
    """``parsed`` statements of columnar and linear layouts only."""
    return parsed(cells, _banks_of(banks, around=False))


def parse_around(cells: DataFrame, banks: DataFrame, glue: DataFrame | None = None) -> DataFrame:
    """``parsed`` statements of layouts with narration around the amount row only."""
    return parsed(cells, _banks_of(banks, around=True), glue)


def _banks_of(banks: DataFrame, around: bool) -> DataFrame:
    return banks.filter(F.col("bank").isin([b for b, p in fixed.PROFILES.items() if p.get("narration_around", False) == around]))


def _own(t: DataFrame) -> WindowSpec:
    """The transactions of a statement, apart from the row that only carries its opening balance."""
    return Window.partitionBy(*[c for c in (*_KEY, "bare") if c in t.columns])


def balance_direction(txns: DataFrame) -> DataFrame:
    """``txns`` with ascending: steps to a later date are at least as many as steps to an earlier one."""
    before = F.lag("date").over(_own(txns).orderBy("seq"))
    steps = txns.withColumn("step", F.when(F.col("date") > before, 1).when(F.col("date") < before, -1).otherwise(0))
    return steps.withColumn("ascending", F.sum("step").over(_own(txns)) >= 0).drop("step")


def _balance_before(t: DataFrame) -> Column:
    """The balance that a transaction starts from, in time direction; the opening one for the first."""
    own = _own(t).orderBy("seq")
    first, final = F.row_number().over(own) == 1, F.lead(F.lit(1)).over(own).isNull()
    return F.when(F.col("ascending"), F.when(first, F.col("opening")).otherwise(F.lag("balance").over(own))).otherwise(F.when(final, F.col("opening")).otherwise(F.lead("balance").over(own)))


def _finalized(txns: DataFrame) -> DataFrame:
    t = balance_direction(txns)
    t = t.withColumn("delta", F.col("balance") - _balance_before(t))
    marked = F.col("amt_sign").isNotNull() & F.col("amt_value").isNotNull()
    moved = F.coalesce(F.abs("delta") >= 0.005, F.lit(False))
    kind = F.when(marked, F.col("amt_sign")).when(moved, F.when(F.col("delta") > 0, "CR").otherwise("DR")).when(F.col("col_dr") > 0, "DR").when(F.col("col_cr") > 0, "CR")
    value = F.when(marked, F.col("amt_value")).when(moved, F.abs("delta")).when(F.col("col_dr") > 0, F.col("col_dr")).otherwise(F.col("col_cr")).cast(C.MONEY)
    t = t.withColumn("type", kind).withColumn("value", value)
    return t.withColumn("debit", F.when(F.col("type") == "DR", F.col("value"))).withColumn("credit", F.when(F.col("type") == "CR", F.col("value")))


CANONICAL = ["statement_id", "seq", "date", "description", "reference", "debit", "credit", "balance", "type"]


def finalize(txns: DataFrame) -> DataFrame:
    """Debit, credit and type: marked amount, else balance difference in time direction, else columns."""
    real = txns.filter(~F.col("bare")) if "bare" in txns.columns else txns
    return drop_empty_financials(_finalized(real).select(CANONICAL))


def drop_empty_financials(txns: DataFrame) -> DataFrame:
    return txns.filter("balance IS NOT NULL OR debit IS NOT NULL OR credit IS NOT NULL")


def _summary(t: DataFrame) -> DataFrame:
    """One row per statement of finished transactions with bare and opening."""
    t = balance_direction(t)
    net = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    real = ~F.col("bare")
    t = t.withColumn("gap", real & (F.abs(F.col("balance") - _balance_before(t) - net) > 1))
    last, first = F.max_by("balance", F.when(real, F.col("seq"))), F.min_by("balance", F.when(real, F.col("seq")))
    return t.groupBy("statement_id").agg(
        F.first("opening", ignorenulls=True).alias("opening_balance"),
        F.count_if(real).alias("n_txns"), F.count_if(F.col("type") == "DR").alias("n_dr"), F.count_if(F.col("type") == "CR").alias("n_cr"), F.count_if(real & F.col("type").isNull()).alias("n_untyped"),
        F.sum("debit").cast(C.MONEY).alias("sum_debit"), F.sum("credit").cast(C.MONEY).alias("sum_credit"), F.count_if("gap").alias("continuity_breaks"),
        F.when(F.first(F.when(real, F.col("ascending")), ignorenulls=True), last).otherwise(first).alias("closing_balance"),
    )


def _for_statements(summary: DataFrame, statements: DataFrame) -> DataFrame:
    out = statements.select("statement_id").distinct().join(summary, "statement_id", "left")
    return out.fillna(0, ["n_txns", "n_dr", "n_cr", "n_untyped", "continuity_breaks"]).withColumns({c: F.coalesce(c, F.lit(0).cast(C.MONEY)) for c in ("sum_debit", "sum_credit")})


def validate(txns: DataFrame, openings: DataFrame, statements: DataFrame) -> DataFrame:
    """One row per statement: counts, sums, continuity breaks and closing balance."""
    rows = txns.withColumn("bare", F.lit(False)).unionByName(openings.select("statement_id", F.lit(True).alias("bare")), allowMissingColumns=True)
    rows = rows.join(openings, "statement_id", "left")
    return _for_statements(_summary(rows), statements)


def transactions(cells: DataFrame, banks: DataFrame, glue: DataFrame | None = None, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(finished transactions, openings) of statements of all layouts."""
    rows = parsed(cells, banks, glue, expected)
    return finalize(rows), openings_of(rows)


def validated(cells: DataFrame, banks: DataFrame, glue: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """One validation row for each statement of ``banks``, in one pass over its rows."""
    done = _finalized(parsed(cells, banks, glue, expected)).select("bare", "opening", *CANONICAL).filter("bare OR balance IS NOT NULL OR debit IS NOT NULL OR credit IS NOT NULL")
    return _for_statements(_summary(done), banks)


def readings(cells: DataFrame, banks: DataFrame, glue: DataFrame | None = None) -> DataFrame:
    """``parsed`` rows of every reading: of each variant of the cells, with the bank's own profile and the generic one."""
    profiles_of = F.array(F.struct(F.lit(0).alias("rescue"), F.col("bank")), F.struct(F.lit(1).alias("rescue"), F.lit("generic").alias("bank")))
    tried = banks.select("statement_id", F.inline(F.when(F.col("bank") == "generic", F.slice(profiles_of, 1, 1)).otherwise(profiles_of)))
    return parsed(cells, tried, glue)


def _found(reading: int) -> Column:
    """How many transactions a reading of the statement has."""
    return F.count_if((F.col("reading") == reading) & ~F.col("bare")).over(Window.partitionBy("statement_id"))


def with_rescue(cells: DataFrame, banks: DataFrame, glue: DataFrame | None = None) -> DataFrame:
    """``parsed``, and with the generic profile again the statements in which the bank's own profile finds nothing."""
    rows = readings(cells, banks, glue).withColumns({"_own": _found(0), "_generic": _found(1)})
    return rows.filter(F.col("reading") == F.when((F.col("_own") == 0) & (F.col("_generic") > 0), 1).otherwise(0)).drop("_own", "_generic")


def best_extraction(cells: DataFrame, banks: DataFrame, expected: DataFrame, glue: DataFrame | None = None) -> DataFrame:
    """Finished transactions of each statement from the best of its readings.

    ``cells`` has a column variant, default or wide; ``expected`` (statement_id, expected) counts the
    dated lines of the text.  Both variants are parsed, with the generic profile where the bank's own
    finds nothing; wide is taken where default finds nothing, or under 0.9 of the expected and wide more.
    All readings stay in one partitioning, and the winner is picked by windows over the statement.
    """
    keyed = cells.withColumn("variant", (F.col("variant") == "wide").cast("int"))
    rows = readings(keyed, banks, glue).withColumns({f"_n{r}": _found(r) for r in range(4)})
    best = lambda own, generic: F.when(F.col(own) > 0, F.col(own)).otherwise(F.col(generic))
    rows = rows.withColumns({"_plain": best("_n0", "_n1"), "_wide": best("_n2", "_n3")}).join(expected.select("statement_id", "expected").hint("shuffle_hash"), "statement_id", "left")
    few = F.col("_plain") < 0.9 * F.coalesce("expected", F.lit(0))
    wide = (F.col("_wide") > 0) & ((F.col("_plain") == 0) | (few & (F.col("_wide") > F.col("_plain"))))
    won = F.when(wide, F.when(F.col("_n2") > 0, 2).otherwise(3)).otherwise(F.when((F.col("_n0") == 0) & (F.col("_n1") > 0), 1).otherwise(0))
    return finalize(rows.filter(F.col("reading") == won))
