"""Layout probes and sources on small fixtures."""

from pyspark.sql import functions as F

from stmtspark.operators import routing
from stmtspark.sources import tables

SEGMENT = "statement_id string, page int, x0 double, y0 double, x1 double, y1 double"


def test_page_has_grid(spark):
    rules = lambda s, ys: [(s, 1, 0.0, float(y), 500.0, float(y)) for y in ys]
    cols = lambda s, xs, h: [(s, 1, float(x), 0.0, float(x), float(h)) for x in xs]
    rows = rules("tall", range(0, 330, 30)) + cols("tall", [0], 25)
    rows += rules("columns", [0, 30]) + cols("columns", [0, 100, 101, 200, 300, 400], 30)
    rows += rules("frame", [0, 30]) + cols("frame", [0, 2, 400], 30)
    rows += rules("no_columns", range(0, 330, 30))
    rows += rules("two_bands", [*range(0, 150, 30), *range(300, 450, 30)]) + cols("two_bands", [0], 25)
    found = {r["statement_id"]: r["has_grid"] for r in routing.page_has_grid(spark.createDataFrame(rows, SEGMENT)).collect()}
    assert found == {"tall": True, "columns": True, "frame": False, "no_columns": False, "two_bands": False}


def test_dedup_tables(spark):
    big = [("s", 1, 1, i, ["01/02/2024", f"{i}.50", "text"]) for i in range(6)]
    part = [("s", 1, 2, i, ["01/02/2024", f"{i}.50"]) for i in range(3)]
    other = [("s", 1, 3, i, ["05/02/2024", f"{i + 70}.25"]) for i in range(3)]
    words = [("s", 1, 4, 0, ["only words"])]
    df = spark.createDataFrame(big + part + other + words, "statement_id string, page int, table_no int, row_no int, cells array<string>")
    assert sorted(r[0] for r in routing.dedup_tables(df).select("table_no").distinct().collect()) == [1, 3]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", None), ("c", "d")], "x string, y string")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r["cells"] for r in tables.read_cell_csv(spark, str(tmp_path / "csv")).collect()) == [["a\nb", ""], ["c", "d"]]


def test_contacts_and_unions(spark):
    df = spark.createDataFrame([(" a@b ", None, None), (None, "", " 98 "), (None, None, None)], "email string, phone string, mobile string")
    assert sorted(map(tuple, tables.normalise_contact(df).collect()), key=str) == sorted([("a@b", None, "contact"), (None, "98", "contact")], key=str)
    one = spark.createDataFrame([(["a"],), ([],)], "cells array<string>")
    assert tables.union_tables(one, one).count() == 2


def test_empty_inputs(spark):
    cells = spark.createDataFrame([], "statement_id string, page int, table_no int, row_no int, cells array<string>")
    assert routing.keep_transaction_tables(cells).count() == 0 and routing.dedup_tables(cells).count() == 0
    assert routing.page_has_grid(spark.createDataFrame([], SEGMENT)).count() == 0
    assert routing.interval_union_length(spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 5.0), (1, 7.0, 8.0)], "k int, lo double, hi double"), ["k"]).select(F.col("covered")).first()[0] == 6.0


def test_detect_bank_query_passes_whole_texts(spark, monkeypatch):
    from stmtspark.plans import layout_queries

    monkeypatch.setattr(layout_queries.routing, "detect_bank", lambda body: body)
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = layout_queries.f4_banks(spark, d).collect()
    assert len(rows) == len(texts) and all(r["by_text"].endswith(" then kotak " + texts[r["doc_id"]]) for r in rows)


def test_grid_clusters_stream_over_batches(spark):
    """Clusters are anchored in one sorted pass over many bands, with no Python group for each band, and go on over batches of rows."""
    rules = [(f"p{s}", p, 0.0, float(y), 500.0, float(y)) for s in range(9) for p in (1, 2) for y in (0, 30, 300, 330)]
    # 0, 2, 4 and 6 are two clusters (0 to 2, 4 to 6), however many rows there are; pages of odd statements have one column fewer
    xs = lambda s: [0, 2, 4, 6, 100, 200, 400] if s % 2 == 0 else [0, 2, 100, 200, 400][: 5 - s // 5]
    cols = [(f"p{s}", p, float(x), 0.0, float(x), 330.0) for s in range(9) for p in (1, 2) for x in xs(s)]
    grids = routing.page_has_grid(spark.createDataFrame(rules + cols, SEGMENT))
    assert "FlatMapGroups" not in grids._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        found = {(r["statement_id"], r["page"]): r["has_grid"] for r in grids.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # columns 0, 4, 100, 200, 400 have three inner ones; 0, 100, 200, 400 have two
    assert found == {(f"p{s}", p): s % 2 == 0 for s in range(9) for p in (1, 2)}


def test_dedup_tables_of_many_pages_in_one_pass(spark):
    """No Python group for each page; a page's kept tables say nothing of the next page; batches may end inside a page."""
    row = lambda s, p, t, i, k: (s, p, t, i, ["01/02/2024", f"{k}.50", "text"])
    rows = [row(f"p{s}", p, t, i, i + 1) for s in range(5) for p in (1, 2) for t, n in ((1, 6), (2, 3)) for i in range(n)]
    rows += [row(f"p{s}", 2, 3, i, i + 50) for s in range(5) for i in range(2)] + [("p0", 2, 4, 0, ["words", "only"]), ("p0", 2, 4, 1, [])]
    kept = routing.dedup_tables(spark.createDataFrame(rows, "statement_id string, page int, table_no int, row_no int, cells array<string>"))
    assert "FlatMapGroups" not in kept._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        got = {(r["statement_id"], r["page"], r["table_no"]): r["count"] for r in kept.groupBy("statement_id", "page", "table_no").count().collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(f"p{s}", p, t): n for s in range(5) for p, t, n in ((1, 1, 6), (2, 1, 6), (2, 3, 2))}
