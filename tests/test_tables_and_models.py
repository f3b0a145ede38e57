"""Table deduplication against a fold by hand, exact splits, and models of users."""

import random

import numpy as np
from pyspark.sql import functions as F

from stmtspark.functions import fixed
from stmtspark.operators import records, routing, training


def test_tables_are_dropped_as_the_greedy_fold_says(spark):
    rng, rows, want = random.Random(4), [], set()
    for page in range(30):
        tables = []
        for table in range(rng.randint(1, 5)):
            own = [[f"REF{rng.randint(0, 6):08d}" if rng.random() < 0.8 else "words" for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 6))]
            tables.append(own)
            rows += [("s", page, table, k, r) for k, r in enumerate(own)]
        seen: set[str] = set()
        for _, table in sorted((-len(t) * max(map(len, t)), k) for k, t in enumerate(tables)):
            content = [x for x in ({c for c in r if c != "words"} for r in tables[table]) if x]
            if content and sum(x <= seen for x in content) * 10 <= len(content) * 6:
                want.add((page, table))
                seen.update(*content)
    df = spark.createDataFrame(rows, "statement_id string, page int, table_no int, row_no int, cells array<string>")
    got = {(r["page"], r["table_no"]) for r in routing.dedup_tables(df).select("page", "table_no").distinct().collect()}
    assert got == want and len(want) < len({r[1:3] for r in rows})


def test_split_is_exact_whatever_the_partitions(spark, monkeypatch):
    df = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 2 == 0, "b").when(F.col("id") < 9, None).otherwise("c").alias("label"))
    monkeypatch.setattr(training, "SPLIT_BITS", 3)
    rows = sorted(map(tuple, training.stratified_split(df).select("text", "is_test").collect()))
    monkeypatch.setattr(training, "SPLIT_BITS", 16)
    assert rows == sorted(map(tuple, training.stratified_split(df.repartition(7)).select("text", "is_test").collect()))
    counts = {r["label"]: (r["n"], r["k"]) for r in training.stratified_split(df).groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("k")).collect()}
    assert all(k == int(n * 0.2 + 0.5) for n, k in counts.values()) and sum(n for n, _ in counts.values()) == 5000


def test_models_score_each_text_once(spark):
    rows = spark.createDataFrame([(i, [["Date", "x"], ["12", "y"], ["", " "]][i % 3], "old") for i in range(30)], "seq int, cells array<string>, label string")

    def load():
        return lambda texts: np.array([0 if "Date" in t else 1 if t else -1 for t in texts])

    got = {r["seq"]: r["label"] for r in records.classify_rows(rows, load).collect()}
    assert got == {i: (fixed.LABELS[0], fixed.LABELS[1], None)[i % 3] for i in range(30)}
