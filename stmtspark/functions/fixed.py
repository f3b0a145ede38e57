"""Word lists, formats and profiles that results depend on."""

from __future__ import annotations

# Page boilerplate, from which on a cell's text is cut.
BOILERPLATE = [
    "hdfc bank limited",
    "contents of this statement",
    "registered office",
    "this is a computer generated",
    "constituent notifies",
    "date stamp",
    "jammu and kashmir bank",
    "idbi bank ltd",
    "state account branch gstn",
    "hdfc bank gstin",
    "printed by",
    "neft : national electronic fund transfer",
    "this is system generated",
    "unionbankofindia",
    "request to our customers",
    "bharat bill payment service",
]

# Texts of rows that are no transaction.
NOISE = [
    "opening balance",
    "closing balance",
    "brought forward",
    "carried forward",
    "b/f",
    "c/f",
    "statement of account",
    "statement summary",
    "page no",
    "grand total",
    "transaction total",
    "computer generated",
    "this is a system",
    "continued",
    "page total",
    "b/f balance",
    "debit amount",
    "credit amount",
    "tran id",
    "ledger print",
    "ledger report",
    "(cid:",
    "service outlet",
    "order by gl",
    "peg review",
    "gl sub head",
    "national electronic fund transfer",
    "real time gross settlement",
    "this is system generated",
    "unionbankofindia",
    "registered office",
]

# Texts that start a page footer.
FOOTERS = [
    "national electronic fund transfer",
    "this is system generated",
    "this is a computer generated",
    "contents of this statement",
    "constituent notifies",
    "registered office",
    "request to our customers",
    "page no",
    "account branch",
    "statement of account",
    "statement downloaded by",
    "end of statement",
]

# Texts that name a bank, in order of preference.
SIGNATURES = [
    ("jk", ["jammu and kashmir bank", "jaka0"]),
    ("idbi", ["idbi bank", "customer account ledger"]),
    ("kotak", ["kotak", "kkbk0"]),
    ("canara", ["canara", "cnrb0"]),
    ("indusind", ["indusind", "indb0"]),
    ("indian", ["indian bank", "idib0"]),
    ("pnb", ["punjab national", "punb0"]),
    ("union", ["union bank", "ubin0", "vyom"]),
    ("uco", ["uco bank", "ucobank", "ucba0"]),
    ("hdfc", ["hdfc bank", "hdfc0"]),
    ("cbi", ["central bank of india", "cbin0"]),
    ("bob", ["bank of baroda", "barb0"]),
]

# How each bank lays out its statements.
PROFILES = {
    "hdfc": {"engine": "columnar", "header_keywords": ["narration", "balance"], "explode_newlines": True, "find_ref_tokens": True},
    "kotak": {"engine": "columnar", "header_keywords": ["narration", "balance"]},
    "canara": {"engine": "columnar", "header_keywords": ["particulars", "balance"], "no_reference": True},
    "indusind": {"engine": "columnar", "header_keywords": ["particulars", "balance"], "find_ref_tokens": True},
    "indian": {"engine": "columnar", "header_keywords": ["details", "balance"]},
    "union": {"engine": "columnar", "header_keywords": ["remarks", "balance"]},
    "uco": {"engine": "columnar", "header_keywords": ["particulars", "balance"], "debit_col": 2, "credit_col": 3, "narration_around": True, "no_reference": True},
    "pnb": {"engine": "columnar", "debit_col": 1, "credit_col": 2, "narration_around": True, "no_reference": True},
    "jk": {"engine": "linear", "no_reference": True},
    "idbi": {"engine": "linear", "drop_code_cells": True},
    "cbi": {"engine": "columnar", "header_keywords": ["transaction description", "balance"], "drop_code_cells": True},
    "bob": {
        "engine": "columnar", "header_keywords": ["description", "balance"], "debit_col": 5, "credit_col": 6, "narration_around": True, "serial_col": True, "header_lines": 2,
        "no_reference": True, "glue_hard_wraps": True,
    },
    "generic": {"engine": "columnar"},
}

# Header words of each column role.
ROLE_KEYWORDS = {
    "debit": ["withdrawal", "withdrawl", "debit", "dr"],
    "credit": ["deposit", "credit", "cr"],
    "balance": ["balance"],
}

# Groups of header words; a header has a date and one more group.
HEADER_GROUPS = [
    ("date",),
    ("balance",),
    ("withdrawal", "deposit", "debit", "credit", "dr", "cr"),
    ("narration", "remarks", "particulars", "details", "description"),
    ("cheque", "ref no", "reference"),
    ("amount",),
]

# Texts of summary rows.
SUMMARY_MARKERS = [
    "brought forward",
    "total debit",
    "total credit",
    "closing balance",
    "opening balance",
    "dr count",
    "cr count",
    "count",
    "statement summary",
    "page total",
    "carried forward",
]

# Pairs of words that one header cell may hold for two columns.
OPPOSITE_HEADERS = [("withdrawal", "deposit"), ("debit", "credit"), ("dr", "cr")]
WRONG_HEADERS = [("chqno", "withdrawal")]

# Dates at the start of a cell.
LEADING_DATE = r"^\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/\s][A-Za-z]{3,9}[-/\s]\d{2,4})\b"
COLLAPSED_DATE = r"^\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/\s][A-Za-z]{3,9}[-/\s]\d{2,4}|[A-Za-z]{3,9}\s*\d{1,2},\s*\d{2,4})\b"

# Words of description and optional columns.
DESCRIPTION_HEADERS = ["particular", "narration", "description", "details", "remarks"]
OPTIONAL_HEADERS = ["reference", "ref no", "ref.", "cheque", "chq", "code"]

# Amounts with a mark, references, and labels.
AMOUNT_FLAG = r"(?i)^\s*([\d,]+(?:\.\d+)?)\s*\(?\s*(dr|cr)\s*\)?\.?\s*$"
REFERENCE = r"[A-Z]{2,6}[-/:]\d{4,}|\b[A-Z]\d{6,}\b|\b\d{10,}\b"
REF_TOKEN = r"^(?:\d{10,}|[A-Z]{1,6}\d{6,})$"
LABELS = ["header", "entry", "c-entry", "info", "remove"]
ROLES = ["super_admin", "admin", "salesperson", "user"]
