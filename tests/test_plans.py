"""Plans of the flagship queries: each statement's rows are exchanged and worked out once."""

import re

import pytest
from conftest import SF

from stmtspark.plans import registry


@pytest.mark.parametrize(("name", "by_statement", "scans"), [("t8_statement_validation", 3, 3), ("f7_best_extraction", 3, 6), ("l10_shape_records", 2, 2)])
def test_exchanges(spark, name, by_statement, scans):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(statement_id", plan)) <= by_statement
    assert plan.count("FileScan") <= scans and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "PythonUDF" not in plan


def test_readings_share_one_partitioning(spark):
    """Both variants and both profiles of a statement are parsed in one pass: the plan has few exchanges, the fixture's included."""
    plan = registry.QUERIES["f7_best_extraction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 8 and len(plan) < 200_000


def test_header_rows_are_worked_out_once(spark):
    """The rounds of header repair read a row that is bound once; spelled out for each look they made up most of the plan."""
    from pyspark.sql import functions as F

    from stmtspark.functions import cells as C

    heads = [["Withdrawals Deposits", "UNKNOWN", "Date\nValue", ""], ["UNKNOWN", "ChqNo Withdrawal", "x", "UNKNOWN"], ["Debit Credit", "UNKNOWN", "UNKNOWN", "Chq No Debit"], []]
    t = spark.createDataFrame([(h,) for h in heads], "h array<string>").select(C.split_merged_headers(C.split_header_row(F.col("h"))).alias("h"))
    assert t._jdf.queryExecution().optimizedPlan().toString().count("split(") < 20
    assert [r["h"] for r in t.collect()] == [["Withdrawals", "Deposits", "Date", "Value"], ["ChqNo", "Withdrawal", "x", "UNKNOWN"], ["Debit", "Credit", "UNKNOWN", "Chq No Debit"], []]


@pytest.mark.parametrize("expected", [6_000_000, 12_000_000])
def test_partitions_grow_with_the_input(spark, expected):
    """Statements are parsed in partitions of a bounded number of transactions, which are not put together by their bytes."""
    from stmtspark.operators import parsing
    from stmtspark.plans import fixtures as X

    t = parsing.validated(X.ledger_cells(spark, SF), X.statement_banks(spark, SF), expected=expected)
    plan = t._jdf.queryExecution().executedPlan().toString()
    own = re.findall(r"Exchange hashpartitioning\(statement_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert own == [str(expected // parsing.TASK_TRANSACTIONS)]
    assert parsing.dealt(t.select("statement_id"), 1_000).rdd.getNumPartitions() <= 4


def test_grid_tables_are_exchanged_once(spark):
    """Sizes and filled columns of a table come from one exchange of its rows, without a join of exploded cells."""
    from stmtspark.operators import routing

    rows = [("a", 1, 1, ["x", None, " "]), ("a", 1, 1, ["x"]), ("a", 1, 1, None), ("a", 2, 1, ["x", "y"]), ("a", 4, 1, ["x"] * 9), ("b", 1, 1, []), ("b", 1, 2, [" ", ""]), ("c", 1, 1, None)]
    best = routing.best_grid_table(spark.createDataFrame(rows, "statement_id string, page int, table_no int, cells array<string>"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan
    assert sorted(map(tuple, best.collect())) == [("a", 3, 3, 1), ("b", 1, 2, 0)]


@pytest.mark.parametrize("name", ["l4_build_records", "l4_repeated_headers", "l7_to_chronological", "l10_shape_records"])
def test_records_are_worked_out_once(spark, name):
    """Orders are exchanged once by statement; records, their headers and profiles are made in those partitions."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan and "ObjectHashAggregate" not in plan


def test_record_partitions_grow_with_the_input(spark, monkeypatch):
    from stmtspark.operators import parsing
    from stmtspark.plans import records_queries

    monkeypatch.setattr(parsing, "TASK_TRANSACTIONS", 20)
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert records_queries.labelled_rows(spark, SF).rdd.getNumPartitions() == -(-n // 20)


def test_profile_by_kinds_of_rows(spark):
    """The profile that windows give is that of the exploded cells, with repeated kinds, odd dates and headers that differ."""
    from pyspark.sql import functions as F

    from stmtspark.operators import records

    a, b = ["Date", "Value Date", "Text", "Amount"], ["Text", "Debit", "Credit", "Date"]
    cells = [("s", 1, a, ["01-02-2024", "", "PARTY 1", "5.00 Dr"]), ("s", 2, a, ["31/02/2025", " ", "September30, 2025", "1,200.00(Cr)"]), ("s", 3, a, ["", "", "2024-01-05", "12.50 cr"]), ("s", 4, a, ["01-02-2024", "", "PARTY 2", "7 Dr."]),
             ("t", 5, b, ["3 Jan 2024 x", "", "1", "x"]), ("t", 9, b, ["", "", "2", "Jan 3, 24"]), ("u", 1, ["A", "B"], ["", None]), ("v", 1, a, ["01-02-2024", "", "", ""]), ("v", 2, b, ["01-02-2024", "", "9 Cr", ""])]
    t = spark.createDataFrame([(s, q, dict(zip(h, v)), h) for s, q, h, v in cells], "statement_id string, seq int, rec map<string,string>, headers array<string>")
    names = [n for n in records._PROFILE if n != "blanks"]
    pick = lambda x: sorted(x.select("statement_id", *names, F.sort_array("blanks").alias("blanks")).distinct().collect(), key=lambda r: r["statement_id"])
    got = records._profiled(t)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == len(cells)
    assert pick(got) == pick(records.column_profile(t))


def test_classifier_rows_are_stored_once(spark):
    """The metrics read stored rows, not the ledger anew for each job."""
    plan = registry.QUERIES["m5_row_classifier"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and "Window" not in plan and "orders.parquet" not in plan
