"""Documented values of the cell functions."""

import datetime
import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stmtspark.functions import cells as C
from stmtspark.operators import routing

D = datetime.date
DATES = [
    ("01/02/2025", D(2025, 2, 1)), ("01/02/25", D(2025, 2, 1)), ("1-2-2025", D(2025, 2, 1)), ("1-2-70", D(1970, 2, 1)), ("1-2-69", D(2069, 2, 1)), ("01-MAR-2024", D(2024, 3, 1)), ("1-mar-24", D(2024, 3, 1)),
    ("3 May 2026", D(2026, 5, 3)), ("3 May 26", D(2026, 5, 3)), ("3-September-2024", D(2024, 9, 3)), ("3 September 2024", D(2024, 9, 3)), ("3.4.2024", D(2024, 4, 3)), ("3.4.24", D(2024, 4, 3)), ("01/01/1965", D(2065, 1, 1)),
    ("31/02/2025", None), ("3-September-24", None), ("3 September 24", None), ("3/May/2024", None), ("3.May.2024", None), ("3-Sept-2024", None), ("1/2/025", None), ("1/2-2025", None), ("", None), (None, None), ("x", None),
]
MONEY = [
    ("30,700.00", "30700.00", None), ("667996.16 Dr.", "667996.16", "DR"), ("50,000.00(Cr)", "50000.00", "CR"), ("35117.37cr", "35117.37", "CR"), ("650640.45 (Cr)", "650640.45", "CR"), ("256.00", "256.00", None), ("1499646", "1499646.00", None),
    ("2022.1", "2022.10", None), ("INR 40,000.00", "40000.00", None), ("Rs. 5,000.00", "5000.00", None), ("₹1,200.00", "1200.00", None), ("-5.00", "5.00", "DR"), ("-5.00 Cr", "5.00", "CR"), ("0000452954753350", None, None), ("7582939659", None, None),
    ("INR 7582939659", None, None), ("7582939659 Cr", "7582939659.00", "CR"), ("0", "0.00", None), ("12 34", None, None), ("", None, None), (None, None, None),
]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("c"))).collect()]


def test_dates(spark):
    assert column(spark, [c for c, _ in DATES], C.parse_date) == [d for _, d in DATES]
    assert column(spark, ["01/02/2025 03/02/2025 X1", "x 01/02/2025"], C.parse_date_leading) == [D(2025, 2, 1), None]
    assert column(spark, ["September30, 2025", "Sep 3, 2025", "2025-01-02", "nope"], C.row_date) == [D(2025, 9, 30), D(2025, 9, 3), D(2025, 1, 2), None]


def test_money(spark):
    found = column(spark, [c for c, *_ in MONEY], C.parse_money)
    assert [(m["value"], m["sign"]) for m in found] == [(Decimal(v) if v else None, s) for _, v, s in MONEY]
    assert column(spark, ["5.00 Dr", "5.00", "x"], C.signed_balance) == [Decimal("-5.00"), Decimal("5.00"), None]


def test_text(spark):
    assert column(spark, [" a\n b ", "nan", None, "x Registered  Office y", "PRINTED BY me"], C.clean) == ["a b", "", "", "x", ""]
    assert column(spark, ["CBINR52025041110007492", "HDFCR52025042162769705", "S30885416", "x1"], C.is_ref_token) == [True, True, True, False]
    assert column(spark, ["pay NEFT-00012 x", "S308854", "no"], C.guess_reference) == ["NEFT-00012", "S308854", ""]
    assert [tuple(x) for x in column(spark, ["2500.00(Dr)", "67.00 (Cr)", "1,800.00 DR", "9,331.00 Cr.", "5"], C.amount_flag)] == [("2500.00", "dr"), ("67.00", "cr"), ("1,800.00", "dr"), ("9,331.00", "cr"), ("", "")]
    assert column(spark, ["RTGS/NEFT IFSC : HDFC0009357", "IFSC Code KKBK0006605", "NEFT CR-KKBK0000958-x"], routing.detect_bank_by_labeled_ifsc) == ["hdfc", "kotak", None]


def test_rows(spark):
    array = lambda rows, f: column(spark, rows, f, "array<string>")
    assert array([["750.00 39,401.43", "a b"]], C.split_money_cells) == [["750.00", "39,401.43", "a b"]]
    assert array([["Withdrawals Deposits", "UNKNOWN"], ["UNKNOWN", "ChqNo Withdrawal"], ["a b", "UNKNOWN"]], C.split_merged_headers) == [["Withdrawals", "Deposits"], ["ChqNo", "Withdrawal"], ["a b", "UNKNOWN"]]
    assert array([["Running\nBalance"], ["Chq\nNo", "", "x"]], C.split_header_row) == [["Running Balance"], ["Chq", "No", "x"]]
    assert array([["DEBIT CMP MANDATE DEBIT / Bajaj Finance Ltd - SI"], ["Date", "Narration", "Balance"], ["Date", "Closing Balance"], []], C.looks_like_header) == [False, True, False, False]
    maps = array([["description", "address", "deposits", "Dr"]], C.build_colmap)
    assert maps[0].asDict() == {"debit": 3, "credit": 2, "balance": None}


def test_hmac_and_gst(spark):
    assert column(spark, ["a|b", ""], lambda c: C.hmac_sha256("key" * 40, c)) == [hmac.new(b"key" * 40, m, hashlib.sha256).hexdigest() for m in (b"a|b", b"")]
    assert [tuple(x) for x in column(spark, [99900, 249900, 25], C.gst_breakup, "long")] == [(17982, 117882), (44982, 294882), (4, 29)]


@pytest.mark.parametrize("text,ratio", [("", 0.0), ("ab", 0.0), ("a\x01", 0.5)])
def test_undecodable(spark, text, ratio):
    assert column(spark, [text], C.undecodable_ratio) == [ratio]
