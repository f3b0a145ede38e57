"""Queries of the statement parsers, over a ledger printed as each bank prints it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtspark.operators import parsing, records, routing
from stmtspark.plans import fixtures as X
from stmtspark.sources import tables as sources
from stmtspark.streaming.events import stream_statements


def _transactions(spark: SparkSession, sf_dir: str, banks: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    own = X.statement_banks(spark, sf_dir)
    if banks is not None:
        own = own.filter(F.col("bank").isin(banks))
    return parsing.transactions(X.ledger_cells(spark, sf_dir), own, expected=_expected(spark, sf_dir))


def _expected(spark: SparkSession, sf_dir: str) -> int:
    """How many transactions the ledger has, from the footers of the files."""
    return X.table(spark, sf_dir, "orders").count()


AROUND, LINEAR, EXPLODED = ["uco", "pnb", "bob"], ["jk", "idbi"], ["hdfc"]
COLUMNAR = [b for b in X.BANKS if b not in (*AROUND, *LINEAR, *EXPLODED)]


def _parsed(banks: list[str] | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        txns, _ = _transactions(spark, sf_dir, banks)
        return txns.select("statement_id", "date", "description", "reference", "debit", "credit", "balance", "type")

    return run


def _truth(banks: list[str] | None) -> str:
    keep = "" if banks is None else "WHERE o_custkey % 13 IN (" + ", ".join(str(X.BANKS.index(b)) for b in banks) + ")"
    return f"""WITH {X.LEDGER}
SELECT 'S' || o_custkey AS statement_id, day::VARCHAR AS date,
  'TRANSFER PARTY X' || (o_orderkey % 97) || 'Q' || CASE WHEN o_orderkey % 3 = 0 THEN ' NOTE LINE TWO' ELSE '' END AS description,
  CASE WHEN o_custkey % 13 IN (2, 6, 7, 8, 11) THEN '' ELSE '90000' || lpad(o_orderkey::VARCHAR, 9, '0') END AS reference,
  CASE WHEN NOT credit THEN amount::DOUBLE END AS debit, CASE WHEN credit THEN amount::DOUBLE END AS credit, balance::DOUBLE AS balance,
  CASE WHEN credit THEN 'CR' ELSE 'DR' END AS type
FROM ledger {keep}"""


def t6_balance_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns, _ = _transactions(spark, sf_dir)
    return parsing.balance_direction(txns).groupBy("statement_id").agg(F.first("ascending").alias("ascending"), F.count("*").alias("n"))


def t8_statement_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: cells of all statements to one validation row each."""
    return parsing.validated(X.ledger_cells(spark, sf_dir), X.statement_banks(spark, sf_dir), expected=_expected(spark, sf_dir))


def e8_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that arrive in two batches, each parsed by the batch plan; a statement comes whole."""
    folder = sources.scratch_folder(spark)
    cells, banks = X.ledger_cells(spark, sf_dir), X.statement_banks(spark, sf_dir)
    expected = _expected(spark, sf_dir)
    files = max(1, expected // (2 * parsing.TASK_TRANSACTIONS))
    cells.repartition(2 * files, "statement_id").write.parquet(f"{folder}/cells")
    arriving = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/cells")
    parse = lambda batch: parsing.finalize(parsing.parsed(batch, banks.join(batch.select("statement_id").distinct(), "statement_id", "left_semi"), expected=expected // 2))
    stream_statements(arriving, parse, f"{folder}/parsed", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/parsed").select("statement_id", "date", "debit", "credit", "balance", "type")


def marked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with marked amounts; printed balances are off by 50 for some keys, and some statements have no entry."""
    t = X.ledger(spark, sf_dir)
    printed = F.col("balance") + F.when(F.col("o_orderkey") % 10 == 0, 50).otherwise(0)
    amount = F.concat(F.format_number("amount", 2), F.when(F.col("credit"), " (Cr)").otherwise(" Dr."))
    balance = F.concat(F.format_number(F.abs(printed), 2), F.when(printed < 0, " Dr").otherwise(" Cr"))
    e = F.lit("")
    entry = F.array(F.date_format("day", "dd-MM-yyyy"), F.lit("PAID TO X"), amount, balance)
    opened = F.array(e, F.lit("Opening Balance"), e, F.lit("100,000.00 Cr"))
    rows = F.concat(F.when(F.col("n") == 1, F.array(opened)).otherwise(F.array().cast("array<array<string>>")), F.when(F.col("o_custkey") % 7 != 0, F.array(entry)).otherwise(F.array().cast("array<array<string>>")))
    out = t.select(X.statement_id().alias("statement_id"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), "n", F.posexplode(rows).alias("k", "cells"))
    return out.select("statement_id", "page", "table_no", (F.col("n") * 2 + F.col("k")).cast("int").alias("row_no"), "cells")


def t8_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked amounts decide the type, whatever the balances say; balances that do not follow are breaks."""
    banks = X.statement_banks(spark, sf_dir).select("statement_id", F.lit("generic").alias("bank"))
    return parsing.validated(marked_cells(spark, sf_dir), banks, expected=_expected(spark, sf_dir))


def column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose printed balance never moves: only the columns tell debits from credits, and some rows have neither."""
    t = X.ledger(spark, sf_dir)
    k, e = F.col("o_orderkey") % 3, F.lit("")
    amount, balance = F.format_number("amount", 2), F.lit("100,000.00")
    head = F.array(*[F.lit(w) for w in ("Date", "Narration", "Chq Ref No", "Withdrawals", "Deposits", "Balance")])
    opened = F.array(e, F.lit("Opening Balance"), e, e, e, balance)
    entry = F.array(F.date_format("day", "dd-MM-yyyy"), F.lit("PAID TO X"), e, F.when(k == 0, amount).otherwise(e), F.when(k == 1, amount).otherwise(e), balance)
    rows = F.concat(F.when(F.col("n") == 1, F.array(head, opened)).otherwise(F.array().cast("array<array<string>>")), F.array(entry))
    out = t.select(X.statement_id().alias("statement_id"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), "n", F.posexplode(rows).alias("k", "cells"))
    return out.select("statement_id", "page", "table_no", (F.col("n") * 4 + F.col("k")).cast("int").alias("row_no"), "cells")


def t7_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns decide the type where neither a mark nor the balance does; rows without either stay untyped."""
    banks = X.statement_banks(spark, sf_dir).select("statement_id", F.lit("kotak").alias("bank"))
    return parsing.validated(column_cells(spark, sf_dir), banks, expected=_expected(spark, sf_dir))


def t5_glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrations of the layout that breaks lines inside words; hard-wrapped lines of the text say where."""
    cells, banks = X.ledger_cells(spark, sf_dir), X.statement_banks(spark, sf_dir).filter("bank = 'bob'")
    t = X.ledger(spark, sf_dir)
    # the printed lines: narrations of even parties reach the column's edge, others end before it
    text = F.concat(F.lit("TRANSFER PARTY X"), (F.col("o_orderkey") % 97).cast("string"), F.lit("Q"))
    lines = t.select(X.statement_id().alias("statement_id"), F.lit(1).alias("page"), F.col("n").cast("int").alias("line_no"), F.lit(40.0).alias("x0"), F.when(F.col("o_orderkey") % 97 % 2 == 0, 300.0).otherwise(120.0).alias("x1"), text.alias("text"))
    txns, _ = parsing.transactions(cells, banks, routing.hard_wrapped_lines(lines), _expected(spark, sf_dir))
    return txns.select("statement_id", "description", "balance")


def f7_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractions of each statement: default loses its later pages for some keys and all rows for others;
    some statements are printed in another layout than their bank's profile expects."""
    cells, banks = X.ledger_cells(spark, sf_dir), X.statement_banks(spark, sf_dir).filter("bank = 'generic'")
    k = F.substring("statement_id", 2, 12).cast("long")
    cells = cells.join(banks.select("statement_id"), "statement_id", "left_semi")
    default = cells.filter(~((k % 3 == 1) & (F.col("page") > 1)) & (k % 3 != 2)).withColumn("variant", F.lit("default"))
    both = default.unionByName(cells.withColumn("variant", F.lit("wide")))
    # a profile whose header words never come parses nothing
    banks = banks.withColumn("bank", F.when(k % 2 == 0, "cbi").otherwise("generic"))
    expected = X.ledger(spark, sf_dir).groupBy(X.statement_id().alias("statement_id")).agg(F.count("*").alias("expected"))
    return parsing.best_extraction(both, banks, expected).select("statement_id", "date", "debit", "credit", "balance", "type")


def l11_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished transactions as records of text."""
    txns, _ = _transactions(spark, sf_dir, ["kotak"])
    recs = records.stream_records(txns)
    return recs.select("statement_id", F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h, F.element_at("rec", h))), ";").alias("record"))


QUERIES = {
    "t2_parse_columnar": _parsed(COLUMNAR),
    "t2_parse_exploded": _parsed(EXPLODED),
    "t3_parse_linear": _parsed(LINEAR),
    "t4_parse_around": _parsed(AROUND),
    "t7_transactions": _parsed(None),
    "t6_balance_direction": t6_balance_direction,
    "t8_statement_validation": t8_statement_validation,
    "t5_glued_narrations": t5_glued,
    "t8_marked_breaks": t8_breaks,
    "t7_column_types": t7_columns,
    "e8_stream_statements": e8_stream,
    "f7_best_extraction": f7_best,
    "l11_stream_records": l11_records,
}
ORACLES = {
    "e8_stream_statements": f"""WITH {X.LEDGER} SELECT 'S' || o_custkey AS statement_id, day::VARCHAR AS date, CASE WHEN NOT credit THEN amount::DOUBLE END AS debit, CASE WHEN credit THEN amount::DOUBLE END AS credit, balance::DOUBLE AS balance, CASE WHEN credit THEN 'CR' ELSE 'DR' END AS type FROM ledger""",
    "t8_marked_breaks": f"""WITH {X.LEDGER}, p AS (SELECT *, balance + CASE WHEN o_orderkey % 10 = 0 THEN 50 ELSE 0 END AS printed, CASE WHEN credit THEN amount ELSE -amount END AS net FROM ledger),
g AS (SELECT *, abs(printed - coalesce(lag(printed) OVER (PARTITION BY o_custkey ORDER BY n), 100000) - net) > 1 AS gap, o_custkey % 7 <> 0 AS listed FROM p)
SELECT 'S' || o_custkey AS statement_id, 100000.00::DOUBLE AS opening_balance, count(*) FILTER (listed) AS n_txns, count(*) FILTER (listed AND NOT credit) AS n_dr, count(*) FILTER (listed AND credit) AS n_cr, 0::BIGINT AS n_untyped,
  coalesce(sum(amount) FILTER (listed AND NOT credit), 0)::DOUBLE AS sum_debit, coalesce(sum(amount) FILTER (listed AND credit), 0)::DOUBLE AS sum_credit, count(*) FILTER (listed AND gap) AS continuity_breaks, max_by(printed, n) FILTER (listed)::DOUBLE AS closing_balance
FROM g GROUP BY o_custkey""",
    "t7_column_types": f"""WITH {X.LEDGER} SELECT 'S' || o_custkey AS statement_id, 100000.00::DOUBLE AS opening_balance, count(*) AS n_txns, count(*) FILTER (o_orderkey % 3 = 0) AS n_dr, count(*) FILTER (o_orderkey % 3 = 1) AS n_cr, count(*) FILTER (o_orderkey % 3 = 2) AS n_untyped,
  coalesce(sum(amount) FILTER (o_orderkey % 3 = 0), 0)::DOUBLE AS sum_debit, coalesce(sum(amount) FILTER (o_orderkey % 3 = 1), 0)::DOUBLE AS sum_credit, count(*) FILTER (o_orderkey % 3 < 2 AND amount > 1) AS continuity_breaks, 100000.00::DOUBLE AS closing_balance FROM ledger GROUP BY o_custkey""",
    "t5_glued_narrations": f"""WITH {X.LEDGER}, e AS (SELECT o_custkey, 300 - 2 * sum(CASE WHEN o_orderkey % 97 % 2 = 0 THEN 260 ELSE 80 END) / sum(length('TRANSFER PARTY X' || (o_orderkey % 97) || 'Q')) AS edge, max(CASE WHEN o_orderkey % 97 % 2 = 0 THEN 300 ELSE 120 END) AS most, count(*) AS lines, 2 * sum(CASE WHEN o_orderkey % 97 % 2 = 0 THEN 260 ELSE 80 END) / sum(length('TRANSFER PARTY X' || (o_orderkey % 97) || 'Q')) AS slack FROM ledger GROUP BY 1),
w AS (SELECT DISTINCT l.o_custkey, l.o_orderkey % 97 AS party FROM ledger l JOIN e USING (o_custkey) WHERE lines >= 3 AND CASE WHEN l.o_orderkey % 97 % 2 = 0 THEN 300 ELSE 120 END >= most - slack),
g AS (SELECT o_custkey FROM w GROUP BY 1 HAVING count(*) >= 3)
SELECT 'S' || l.o_custkey AS statement_id, 'TRANSFER PARTY X' || (l.o_orderkey % 97) || 'Q' || CASE WHEN l.o_orderkey % 3 <> 0 THEN '' WHEN (l.o_custkey, l.o_orderkey % 97) IN (SELECT o_custkey, party FROM w WHERE o_custkey IN (SELECT o_custkey FROM g)) THEN 'NOTE LINE TWO' ELSE ' NOTE LINE TWO' END AS description, balance::DOUBLE AS balance
FROM ledger l WHERE l.o_custkey % 13 = 11""",
    "f7_best_extraction": f"""WITH {X.LEDGER} SELECT 'S' || o_custkey AS statement_id, day::VARCHAR AS date, CASE WHEN NOT credit THEN amount::DOUBLE END AS debit, CASE WHEN credit THEN amount::DOUBLE END AS credit, balance::DOUBLE AS balance, CASE WHEN credit THEN 'CR' ELSE 'DR' END AS type
FROM ledger WHERE o_custkey % 13 = 12""",
    "l11_stream_records": f"""WITH {X.LEDGER} SELECT 'S' || o_custkey AS statement_id, 'Date=' || day || ';Description=TRANSFER PARTY X' || (o_orderkey % 97) || 'Q' || CASE WHEN o_orderkey % 3 = 0 THEN ' NOTE LINE TWO' ELSE '' END || ';Reference=90000' || lpad(o_orderkey::VARCHAR, 9, '0')
 || ';Debit=' || CASE WHEN credit THEN '' ELSE amount::VARCHAR END || ';Credit=' || CASE WHEN credit THEN amount::VARCHAR ELSE '' END || ';Balance=' || balance::DECIMAL(18,2)::VARCHAR AS record FROM ledger WHERE o_custkey % 13 = 1""",
    "t2_parse_columnar": _truth(COLUMNAR),
    "t2_parse_exploded": _truth(EXPLODED),
    "t3_parse_linear": _truth(LINEAR),
    "t4_parse_around": _truth(AROUND),
    "t7_transactions": _truth(None),
    "t6_balance_direction": f"WITH {X.LEDGER} SELECT 'S' || o_custkey AS statement_id, NOT bool_or(newest_first) AS ascending, count(*) AS n FROM ledger GROUP BY o_custkey",
    "t8_statement_validation": f"""WITH {X.LEDGER}
SELECT 'S' || o_custkey AS statement_id, 100000.00::DOUBLE AS opening_balance, count(*) AS n_txns, count(*) FILTER (NOT credit) AS n_dr, count(*) FILTER (credit) AS n_cr, 0::BIGINT AS n_untyped,
  coalesce(sum(amount) FILTER (NOT credit), 0)::DOUBLE AS sum_debit, coalesce(sum(amount) FILTER (credit), 0)::DOUBLE AS sum_credit, 0::BIGINT AS continuity_breaks,
  max_by(balance, n)::DOUBLE AS closing_balance
FROM ledger GROUP BY o_custkey""",
}
