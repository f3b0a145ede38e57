"""Queries of the cell functions, the routing filters and the layout probes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtspark.functions import cells as C
from stmtspark.functions import fixed
from stmtspark.operators import routing
from stmtspark.plans import fixtures as X
from stmtspark.plans.fixtures import table

Query = Callable[[SparkSession, str], DataFrame]


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


ORDERS = "o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"


def c1_dates(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.lit(" "), X.rendered_date(), F.when(F.col("o_orderkey") % 7 == 0, " 01/02/2020 X1").otherwise(""))
    return orders(spark, d).select("o_orderkey", C.parse_date(cell).alias("whole"), C.parse_date_leading(cell).alias("leading"), C.row_date(F.date_format("day", "MMMMdd, yyyy")).alias("month_first"))


def c3_money(spark: SparkSession, d: str) -> DataFrame:
    mark = F.get(F.array(*[F.lit(x) for x in ("", " Dr.", "(Cr)", "cr", " (DR)")]), (F.col("o_orderkey") % 5).cast("int"))
    front = F.get(F.array(*[F.lit(x) for x in ("", "INR ", "Rs. ", "₹", "-")]), (F.floor(F.col("o_orderkey") / 5) % 5).cast("int"))
    cell = F.when(F.col("o_orderkey") % 11 == 0, F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).otherwise(F.concat(front, F.format_number("amount", 2), mark))
    t = orders(spark, d).withColumn("m", C.parse_money(cell)).withColumn("s", C.signed_balance(cell))
    return t.select("o_orderkey", F.col("m.value").alias("value"), F.col("m.sign").alias("sign"), F.col("s").alias("signed"), C.is_money(cell).alias("is_money"))


def c5_clean(spark: SparkSession, d: str) -> DataFrame:
    marker = F.get(F.array(*[F.lit(x) for x in fixed.BOILERPLATE]), (F.col("doc_id") % len(fixed.BOILERPLATE)).cast("int"))
    t = table(spark, d, "documents").select("doc_id", C.clean(F.concat("text", F.lit("\n \n"), F.upper(marker), F.lit(" 560001 printed by"))).alias("t"))
    return t.select("doc_id", F.md5("t").alias("cleaned"), F.char_length("t").alias("n"))


def c7_references(spark: SparkSession, d: str) -> DataFrame:
    key = F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("paid NEFT-"), key, F.lit("/x"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("S"), key)).otherwise(F.lit("no reference 12345"))
    return orders(spark, d).select("o_orderkey", C.guess_reference(cell).alias("reference"), C.is_ref_token(cell).alias("is_token"))


def c13_parsers(spark: SparkSession, d: str) -> DataFrame:
    lead = C.leading_date(F.concat(F.date_format("day", "dd-MM-yy"), F.lit("  MB/IMPS/"), F.col("o_orderkey").cast("string")))
    flag = C.amount_flag(F.concat(F.format_number("amount", 2), F.when(F.col("o_orderkey") % 2 == 0, "(Dr)").otherwise(" Cr.")))
    t = orders(spark, d).select("o_orderkey", lead.alias("l"), flag.alias("f"), C.norm_header_word(F.concat(F.lit("With-drawal"), "o_orderkey", F.lit("s"))).alias("word"), C.password_hint(F.concat(F.lit("/in 99/stmt_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".pdf"))).alias("hint"))
    return t.select("o_orderkey", F.col("l.date").alias("date"), F.col("l.rest").alias("rest"), F.col("f.number").alias("number"), F.col("f.flag").alias("flag"), "word", "hint")


def c18_undecodable(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat("text", F.repeat(F.lit("\x01"), (F.col("doc_id") % 90).cast("int")))
    return table(spark, d, "documents").select("doc_id", F.round(C.undecodable_ratio(cell), 9).alias("ratio"), routing.has_undecodable_text(cell).alias("undecodable"))


def f4_banks(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda k: F.get(F.array(*[F.lit(n[k % len(n)].upper()) for _, n in fixed.SIGNATURES]), (F.col("doc_id") % 12).cast("int"))
    body = F.concat(pick(0), F.lit(" then kotak "), "text")  # the planted name stands before the whole text
    code = F.concat(F.lit("NEFT CR-KKBK0000958 RTGS/NEFT IFSC :\n"), F.when(F.col("doc_id") % 2 == 0, "HDFC0009357").otherwise("ZZZZ0009357"))
    return table(spark, d, "documents").select("doc_id", routing.detect_bank(body).alias("by_text"), routing.detect_bank_by_labeled_ifsc(code).alias("by_code"))


def f4_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Two banks' names put into each whole text, at places of which some lie beyond the first 4000 characters."""
    k = F.col("doc_id")
    name = lambda i: F.get(F.array(*[F.lit(f" {n[0].title()} ") for _, n in fixed.SIGNATURES]), (i % 12).cast("int"))
    put = lambda t, at, what: F.concat(F.substring(t, F.lit(1), at.cast("int")), what, F.substring(t, (at + 1).cast("int"), F.length(t)))
    once = put(F.col("text"), k * 37 % 6000, name(k))
    return table(spark, d, "documents").withColumn("t", once).select("doc_id", routing.detect_bank(put(F.col("t"), k * 91 % 6000, name(k + 5))).alias("bank"))


def f6_banks(spark: SparkSession, d: str) -> DataFrame:
    cells = X.ledger_cells(spark, d)
    named = X.statement_banks(spark, d)
    names = F.create_map(*[F.lit(x) for bank, n in fixed.SIGNATURES for x in (bank, n[0])])
    head = named.select("statement_id", F.lit(0).alias("page"), F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.array(F.initcap(F.coalesce(F.element_at(names, F.col("bank")), F.lit("statement")))).alias("cells"))
    pages = named.filter("bank = 'generic'").select("statement_id", F.lit("IFS Code CNRB0001234").alias("text"))
    return routing.assign_bank(pages, cells.unionByName(head.withColumn("row_no", F.col("row_no").cast("int")).select(*cells.columns)))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """pdf_lines from orders: dated lines and others, with edges by key."""
    o = orders(spark, d)
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("plain text "), "o_orderkey")).otherwise(F.concat(F.date_format("day", "dd MMM yyyy"), F.lit(" PAY "), "o_orderkey"))
    return o.select(X.statement_id().alias("statement_id"), (1 + F.col("o_orderkey") % 4).cast("int").alias("page"), F.col("o_orderkey").cast("int").alias("line_no"), (F.col("o_orderkey") % 3 * 50.0).alias("x0"), (F.col("o_orderkey") % 3 * 50.0 + 60 + F.col("o_orderkey") % 8).alias("x1"), text.alias("text"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Rule segments from orders: rows and columns of a grid, on some statements too few."""
    o = orders(spark, d)
    page = (1 + F.col("o_orderkey") % 2).cast("int")
    y = F.col("o_orderkey") % 30 * 20.0
    h = o.select(X.statement_id().alias("statement_id"), page.alias("page"), F.lit(20.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), y.alias("y1"))
    x = F.col("o_orderkey") % 7 * 60.0
    v = o.filter("o_custkey % 3 <> 0").select(X.statement_id().alias("statement_id"), page.alias("page"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 1).alias("x1"), F.lit(600.0).alias("y1"))
    return h.union(v)


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of small tables from lineitem, some blank."""
    t = table(spark, d, "lineitem")
    cell = lambda k, m: F.when(F.col("l_partkey") % m == 0, F.lit("")).otherwise(F.concat(F.lit(k), F.col("l_suppkey").cast("string")))
    return t.select(F.col("l_orderkey").cast("string").alias("statement_id"), (1 + F.floor(F.col("l_linenumber") / 4)).cast("int").alias("page"), (1 + F.col("l_suppkey") % 2).cast("int").alias("table_no"), F.array(cell("a", 2), cell("b", 3), cell("c", 5), F.lit(""), cell("e", 1)).alias("cells"))


def t1_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each page's table once more, without its first row, as a second table; plus one without content."""
    cells = X.ledger_cells(spark, d)
    again = cells.filter("row_no > 1").withColumn("table_no", F.lit(2))
    blank = cells.filter("row_no = 0").withColumn("table_no", F.lit(3)).withColumn("cells", F.array(F.lit("words only")))
    kept = routing.dedup_tables(cells.unionByName(again).unionByName(blank))
    return kept.groupBy("statement_id", "table_no").agg(F.count("*").alias("rows"))


def f1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two dated tables of each statement where it has them, else its undated one."""
    o = orders(spark, d)
    row = o.select(X.statement_id().alias("statement_id"), (F.col("o_orderkey") % 2).cast("int").alias("page"), (F.col("o_orderkey") % 3).cast("int").alias("table_no"), F.array(F.when(F.col("o_orderkey") % 3 == 0, "info").otherwise(F.date_format("day", "dd/MM/yyyy")), F.lit("x")).alias("cells"))
    return routing.keep_transaction_tables(row).groupBy("statement_id", "page", "table_no").agg(F.count("*").alias("rows"))


def f7_extraction(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).groupBy(X.statement_id().alias("statement_id"), F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    counts = o.select("statement_id", F.lit("default").alias("variant"), F.when(F.col("k") % 3 == 0, 0).otherwise(F.col("n")).alias("n")).union(o.select("statement_id", F.lit("wide"), F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("n") + F.col("k") % 2)))
    return routing.choose_extraction(counts, o.select("statement_id", (F.col("n") + F.col("k") % 4).alias("expected")))


def f13_intervals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 900).cast("double").alias("lo"), (F.col("l_partkey") % 900 + F.col("l_quantity")).alias("hi"))
    return routing.interval_union_length(t, ["k"])


def f15_scanned(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    blocks = o.select(X.statement_id().alias("statement_id"), F.lit(1).alias("page"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), (F.col("o_orderkey") % 2).cast("int").alias("block_type"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("o_orderkey") % 600).cast("double").alias("x1"), F.lit(800.0).alias("y1"))
    pages = X.statement_banks(spark, d).select("statement_id", F.repeat(F.lit("x"), (F.substring("statement_id", 2, 9).cast("int") % 200)).alias("text"))
    return routing.is_scanned(blocks, pages)


def f17_routes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    flags = orders(spark, d).select("o_orderkey", (k % 2 == 0).alias("encrypted"), F.when(k % 4 == 0, "p").alias("password"), (k % 8 == 0).alias("password_ok"), (k % 7 == 0).alias("scanned"), (k % 11 == 0).alias("undecodable"), (k % 13 - 1).alias("remaining"), (k % 5).alias("pages"), F.when(k % 3 == 0, "lattice").when(k % 3 == 1, "stream").alias("category"))
    return routing.route_statements(flags).select("o_orderkey", "status")


def a_cells(spark: SparkSession, d: str) -> DataFrame:
    """Amounts that share a cell come apart, and the right-most marked one is the balance."""
    t = orders(spark, d).withColumn("own", C.split_money_cells(F.array(F.lit("text 12"), F.concat(F.format_number("amount", 2), F.lit(" 5.00 Dr")), F.concat(F.format_number("amount", 2), F.lit("  7.25Cr")), F.lit("9"))))
    t = t.withColumn("f", C.facts(F.col("own"))).withColumn("b", C.last_balance(F.col("f")))
    return t.select("o_orderkey", F.array_join("own", "|").alias("cells"), F.col("b.i").alias("at"), C.signed(F.col("b")).alias("balance"), C.row_text(F.array(F.lit(" a\nb "), F.lit(""), F.col("o_orderkey").cast("string"))).alias("joined"), C.row_text(F.array(F.lit(" a\nb ")), " ").alias("spaced"))


def a10_headers(spark: SparkSession, d: str) -> DataFrame:
    head = C.split_header_row(F.array(F.concat(F.lit("Date\n"), "c_name"), F.lit(""), F.lit("Running\nBalance")))
    merged = C.split_merged_headers(F.array(F.lit("Withdrawals Deposits"), F.lit("UNKNOWN"), F.col("c_name"), F.lit("UNKNOWN"), F.lit("ChqNo Withdrawal")))
    looks = C.looks_like_header(F.array(F.lit("Txn Date"), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "Debit").otherwise("Closing Balance")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(head, "|").alias("head"), F.array_join(merged, "|").alias("merged"), looks.alias("looks"))


def a14_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = C.row_tokens(F.array(F.concat(F.date_format("day", "dd/MM/yyyy"), F.lit("\n"), F.format_number("amount", 2)), F.concat(F.lit("REF"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), F.lit("words here")))
    return orders(spark, d).select("o_orderkey", F.array_join(tokens, "|").alias("tokens"))


def c22_plans(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1996-01-01 12:00:00").cast("timestamp")
    return orders(spark, d).select("o_orderkey", C.days_left(F.col("day").cast("timestamp"), now).alias("left"), C.valid_mobile(F.concat(F.lit("98"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 8, "0"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise(""))).alias("mobile"), C.digits_only(F.concat(F.lit("a-"), "o_orderkey", F.lit(" z"))).alias("digits"))


QUERIES: dict[str, Query] = {
    "c1_parse_date": c1_dates,
    "c3_parse_money": c3_money,
    "c5_clean": c5_clean,
    "c7_references": c7_references,
    "c13_cell_parsers": c13_parsers,
    "c18_undecodable": c18_undecodable,
    "c22_plan_and_mobile": c22_plans,
    "a1_split_and_balance": a_cells,
    "a10_headers": a10_headers,
    "a14_row_tokens": a14_tokens,
    "f1_transaction_tables": f1_tables,
    "f4_detect_bank": f4_banks,
    "f4_bank_in_text": f4_in_text,
    "f6_assign_bank": f6_banks,
    "f7_choose_extraction": f7_extraction,
    "f8_estimate_text_txns": lambda s, d: routing.estimate_text_txns(text_lines(s, d)),
    "f9_hard_wrapped_lines": lambda s, d: routing.hard_wrapped_lines(text_lines(s, d)),
    "f10_best_grid_table": lambda s, d: routing.classify_layout(routing.best_grid_table(grid_cells(s, d))).drop("reason"),
    "f12_page_has_grid": lambda s, d: routing.page_has_grid(segments(s, d)),
    "f13_interval_union": f13_intervals,
    "f14_confident_stream": lambda s, d: routing.is_confident_stream(routing.page_has_grid(segments(s, d)), text_lines(s, d)),
    "f15_scanned": f15_scanned,
    "f17_routes": f17_routes,
    "t1_dedup_tables": t1_dedup,
}
_SIGN_NAMES = "[" + ", ".join(f"'{b}'" for b, _ in fixed.SIGNATURES) + "]"
_LINES = f"""{ORDERS}, l AS (SELECT 'S' || o_custkey AS statement_id, o_orderkey, 1 + o_orderkey % 4 AS page, o_orderkey % 3 * 50 AS x0, o_orderkey % 3 * 50 + 60 + o_orderkey % 8 AS x1,
 CASE WHEN o_orderkey % 4 = 0 THEN 'plain text ' || o_orderkey ELSE strftime(day, '%d %b %Y') || ' PAY ' || o_orderkey END AS text FROM o)"""
#: Rules are 20 apart and columns 60, and every column rule crosses the whole page.
_GRIDS = """s AS (SELECT 'S' || o_custkey AS statement_id, o_custkey, 1 + o_orderkey % 2 AS page, o_orderkey % 30 * 20 AS y, o_orderkey % 7 AS x FROM orders),
 h AS (SELECT *, lag(y) OVER (PARTITION BY statement_id, page ORDER BY y) AS before FROM (SELECT DISTINCT statement_id, page, y FROM s)),
 b AS (SELECT *, sum((y - before > 40)::INT) OVER (PARTITION BY statement_id, page ORDER BY y) AS band FROM (SELECT statement_id, page, y, coalesce(before, y) AS before FROM h)),
 w AS (SELECT statement_id, page, band, count(*) - 1 AS rows FROM b GROUP BY 1, 2, 3),
 v AS (SELECT statement_id, page, count(DISTINCT x) AS columns FROM s WHERE o_custkey % 3 <> 0 GROUP BY 1, 2),
 g AS (SELECT statement_id, page, coalesce(bool_or(rows >= 10 OR rows > 0 AND columns - 2 >= 3), false) AND max(columns) IS NOT NULL AS has_grid FROM w LEFT JOIN v USING (statement_id, page) GROUP BY 1, 2)"""
ORACLES: dict[str, str] = {
    "f12_page_has_grid": f"WITH {_GRIDS} SELECT * FROM g",
    "f14_confident_stream": f"""WITH {_GRIDS}, n AS (SELECT 'S' || o_custkey AS statement_id, sum(CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 5 END) AS words FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1)
 SELECT statement_id, words >= 40 AND NOT coalesce((SELECT bool_or(has_grid) FROM g WHERE g.statement_id = n.statement_id), false) AS confident_stream FROM n""",
    "c1_parse_date": f"WITH {ORDERS} SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN day END::VARCHAR AS whole, day::VARCHAR AS leading, day::VARCHAR AS month_first FROM o",
    "c3_parse_money": f"""WITH {ORDERS}, s AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey // 5 % 5 = 4 THEN 'DR' END WHEN 1 THEN 'DR' WHEN 2 THEN 'CR' WHEN 3 THEN 'CR' ELSE 'DR' END AS sign FROM o)
SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN amount::DOUBLE END AS value, CASE WHEN o_orderkey % 11 <> 0 THEN sign END AS sign, CASE WHEN o_orderkey % 11 <> 0 THEN (CASE WHEN sign = 'DR' THEN -amount ELSE amount END)::DOUBLE END AS signed, o_orderkey % 11 <> 0 AS is_money FROM s""",
    "c5_clean": r"WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\s\v]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(t) AS cleaned, length(t) AS n FROM c",
    "c7_references": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'NEFT-' || lpad(o_orderkey::VARCHAR, 7, '0') WHEN 1 THEN 'S' || lpad(o_orderkey::VARCHAR, 7, '0') ELSE '' END AS reference, o_orderkey % 3 = 1 AS is_token FROM orders",
    "c13_cell_parsers": f"WITH {ORDERS} SELECT o_orderkey, strftime(day, '%d-%m-%y') AS date, 'MB/IMPS/' || o_orderkey AS rest, format('{{:,.2f}}', amount::DOUBLE) AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'dr' ELSE 'cr' END AS flag, 'withdrawal' AS word, lpad(o_orderkey::VARCHAR, 8, '0') AS hint FROM o",
    "c18_undecodable": r"WITH c AS (SELECT doc_id, length(text) AS whole, length(regexp_replace(text, '[\s\v]+', '', 'g')) AS n, doc_id % 90 AS k FROM documents) SELECT doc_id, round(CASE WHEN n + k > 0 THEN k / (n + k) ELSE 0 END, 9) AS ratio, whole + k >= 200 AND k / (n + k) >= 0.1 AS undecodable FROM c",
    "c22_plan_and_mobile": f"WITH {ORDERS} SELECT o_orderkey, greatest(0, date_diff('day', DATE '1996-01-01', day) - 1) AS left, o_orderkey % 2 = 1 AS mobile, o_orderkey::VARCHAR AS digits FROM o",
    "a1_split_and_balance": f"WITH {ORDERS} SELECT o_orderkey, 'text 12|' || format('{{:,.2f}}', amount::DOUBLE) || ' 5.00 Dr|' || format('{{:,.2f}}', amount::DOUBLE) || '|7.25Cr|9' AS cells, 3 AS at, 7.25::DOUBLE AS balance, 'ab ' || o_orderkey AS joined, 'a b' AS spaced FROM o",
    "a10_headers": "SELECT c_custkey, 'Date|' || c_name || '|Running Balance' AS head, 'Withdrawals|Deposits|' || c_name || '|ChqNo|Withdrawal' AS merged, c_custkey % 2 = 0 AS looks FROM customer",
    "a14_row_tokens": f"WITH {ORDERS} SELECT o_orderkey, 'D:' || day || '|M:' || amount || '|R:REF' || lpad(o_orderkey::VARCHAR, 8, '0') AS tokens FROM o",
    "f1_transaction_tables": """WITH r AS (SELECT 'S' || o_custkey AS statement_id, o_orderkey % 2 AS page, o_orderkey % 3 AS table_no FROM orders), t AS (SELECT *, count(*) AS rows FROM r GROUP BY ALL),
 m AS (SELECT *, table_no <> 0 AND rows >= 2 AS good, bool_or(table_no <> 0 AND rows >= 2) OVER (PARTITION BY statement_id) AS found FROM t) SELECT statement_id, page, table_no, rows FROM m WHERE good OR NOT found""",
    "f4_detect_bank": f"SELECT doc_id, {_SIGN_NAMES}[doc_id % 12 + 1] AS by_text, CASE WHEN doc_id % 2 = 0 THEN 'hdfc' END AS by_code FROM documents",
    "f6_assign_bank": f"SELECT DISTINCT 'S' || o_custkey AS statement_id, CASE WHEN o_custkey % 13 = 12 THEN 'canara' ELSE [{', '.join(repr(b) for b in X.BANKS)}][o_custkey % 13 + 1] END AS bank FROM orders",
    "f7_choose_extraction": """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT k, CASE WHEN k % 3 = 0 THEN 0 ELSE n END AS p, CASE WHEN k % 5 = 0 THEN 0 ELSE n + k % 2 END AS w, n + k % 4 AS e FROM o)
 SELECT 'S' || k AS statement_id, CASE WHEN w > 0 AND (p = 0 OR (p < 0.9 * e AND w > p)) THEN 'wide' ELSE 'default' END AS variant FROM c""",
    "f8_estimate_text_txns": f"WITH {_LINES} SELECT statement_id, count(*) FILTER (o_orderkey % 4 <> 0) AS expected FROM l GROUP BY 1",
    "f9_hard_wrapped_lines": f"""WITH {_LINES}, g AS (SELECT statement_id, x0, max(x1) AS m, 2 * sum(x1 - x0) / sum(length(text)) AS s FROM l GROUP BY 1, 2 HAVING count(*) >= 3),
 w AS (SELECT DISTINCT l.statement_id, l.x0, text FROM l JOIN g ON g.statement_id = l.statement_id AND g.x0 = l.x0 WHERE x1 >= m - s), k AS (SELECT statement_id, x0 FROM w GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT DISTINCT w.statement_id, text FROM w JOIN k ON k.statement_id = w.statement_id AND k.x0 = w.x0""",
    "f10_best_grid_table": """WITH c AS (SELECT l_orderkey::VARCHAR AS statement_id, 1 + l_linenumber // 4 AS page, 1 + l_suppkey % 2 AS table_no, count(*) AS rows,
 count(*) FILTER (l_partkey % 2 <> 0) AS a, count(*) FILTER (l_partkey % 3 <> 0) AS b, count(*) FILTER (l_partkey % 5 <> 0) AS c FROM lineitem GROUP BY 1, 2, 3),
 p AS (SELECT *, (a >= greatest(1, 0.3 * rows))::INT + (b >= greatest(1, 0.3 * rows))::INT + (c >= greatest(1, 0.3 * rows))::INT AS populated FROM c WHERE page <= 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY rows * populated DESC, page, table_no) AS n FROM p)
 SELECT statement_id, rows, 5 AS columns, populated, CASE WHEN rows >= 3 AND populated >= 3 THEN 'lattice' ELSE 'stream' END AS category FROM r WHERE n = 1""",
    "f13_interval_union": """WITH i AS (SELECT l_orderkey AS k, (l_partkey % 900)::DOUBLE AS lo, l_partkey % 900 + l_quantity AS hi FROM lineitem),
 g AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS n FROM i),
 s AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS z FROM g), u AS (SELECT k, z, max(hi) - min(lo) AS w FROM s GROUP BY 1, 2) SELECT k, sum(w) AS covered FROM u GROUP BY 1""",
    "f15_scanned": "SELECT 'S' || o_custkey AS statement_id, o_custkey % 200 < 100 AND coalesce(max(o_orderkey % 600) FILTER (o_orderkey % 2 = 1), 0) / 600 >= 0.5 AS scanned FROM orders GROUP BY o_custkey",
    "f17_routes": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'PASSWORD_REQUIRED' WHEN o_orderkey % 2 = 0 AND o_orderkey % 8 <> 0 THEN 'WRONG_PASSWORD' WHEN o_orderkey % 7 = 0 THEN 'SCANNED' WHEN o_orderkey % 11 = 0 THEN 'UNREADABLE'
 WHEN o_orderkey % 13 - 1 <= 0 THEN 'PAGE_LIMIT_REACHED' WHEN o_orderkey % 5 > o_orderkey % 13 - 1 THEN 'INSUFFICIENT_PAGES' WHEN o_orderkey % 3 = 0 THEN 'lattice' WHEN o_orderkey % 3 = 1 THEN 'stream' ELSE 'NO_TABLE' END AS status FROM orders""",
    "t1_dedup_tables": f"""WITH {X.LEDGER}, p AS (SELECT *, o_custkey % 13 AS b, CASE WHEN newest_first THEN of_n - n ELSE n - 1 END AS place FROM ledger)
 SELECT 'S' || o_custkey AS statement_id, 1 AS table_no, sum(1 + (b IN (6, 11))::INT + (o_orderkey % 3 = 0)::INT
  + CASE WHEN place % 5 = 0 THEN CASE b WHEN 11 THEN 2 WHEN 7 THEN 0 WHEN 8 THEN 0 WHEN 9 THEN 0 WHEN 12 THEN 0 ELSE 1 END ELSE 0 END + (place = 0)::INT
  + CASE WHEN (place % 5 = 4 AND b NOT IN (6, 7, 11)) OR place = of_n - 1 THEN 2 ELSE 0 END)::BIGINT AS rows FROM p GROUP BY o_custkey""",
}
_NAMES = ", ".join(f"({i}, '{bank}', '{n}')" for i, (bank, names) in enumerate(fixed.SIGNATURES) for n in names)
_PLANTED = "[" + ", ".join(f"' {n[0].title()} '" for _, n in fixed.SIGNATURES) + "]"
ORACLES["f4_bank_in_text"] = f"""WITH a AS (SELECT doc_id, substr(text, 1, doc_id * 37 % 6000) || {_PLANTED}[doc_id % 12 + 1] || substr(text, doc_id * 37 % 6000 + 1) AS t FROM documents),
 b AS (SELECT doc_id, lower(substr(substr(t, 1, doc_id * 91 % 6000) || {_PLANTED}[(doc_id + 5) % 12 + 1] || substr(t, doc_id * 91 % 6000 + 1), 1, 4000)) AS t FROM a)
 SELECT doc_id, coalesce(min_by(bank, place * 100 + i) FILTER (place > 0), 'generic') AS bank FROM (SELECT doc_id, bank, i, instr(t, name) AS place FROM b, (VALUES {_NAMES}) v(i, bank, name)) GROUP BY doc_id"""
