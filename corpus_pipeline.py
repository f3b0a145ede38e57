"""A training-data pipeline over ``documents``: filter, deduplicate, clean, tokenise.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written and read again as the next one's docs.  All but the last return the columns of documents.
Rows with a null doc_id belong to no group: they can be dropped as toxic, and pass the three stages after
that unchanged.  Null and empty texts pass all stages.  Rows that repeat a doc_id are kept or dropped
together, but for toxicity, which judges each text by itself; passages found in any of them are cut from
all.  Ties go to the least doc_id.  Extra columns pass through all stages but the last, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtspark.llm import bpe, decontaminate, minhash, substrings, toxicity
from stmtspark.llm.common import cut, discard, tables_made

import public_tokenizers as tokenizers  # isort: skip  (after the subpackage, which may be missing)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of the labelled ones does not call toxic."""
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = next(n for n in ("score", "_score", "__score", "___score") if n not in docs.columns)
    return toxicity.score(docs, scorer, into=into).filter(F.col(into) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates."""
    drop = minhash.near_duplicates(docs).filter("NOT kept").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages that several of them hold; n_chars follows the text."""
    done = substrings.remove_repeats(docs, substrings.repeated_passages(docs))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window like a benchmark item."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and their bytes again, as digests."""
    return bpe.digest(bpe.bpe_round_trip(docs.select("doc_id", "text"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level bpe", tokenise),
]

#: No SQL: the classifier and the tokenizer can't be written in it; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = tables_made()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        discard(spark, begin)  # the stage's own tables, and the documents before it
    return STAGES[-1][1](spark, docs, sf_dir)
