"""The queries over the driver's tables, one per operator; ``ORACLES`` has their DuckDB SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtspark.llm import hard_negatives, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each whole text, and their bytes again, as digests."""
    import public_tokenizers as tokenizers

    from stmtspark.llm import bpe

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.bpe_round_trip(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of each whole text, learnt from the labels that are not held out."""
    from stmtspark.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each whole text for the word-end vocabulary."""
    import public_tokenizers as tokenizers

    from stmtspark.llm import token_counts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from stmtspark.llm import html_text

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.train(pages)).select("page_id", "url", "text", "n_chars")


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors of all embeddings at cosine 0.95."""
    from stmtspark.llm import embeddings

    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more that documents share, with their sources."""
    from stmtspark.llm import substrings

    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the list entries active when it was fetched."""
    pages = _table(spark, sf_dir, "pages")
    return url_filters.filter_urls(url_filters.derived_captures(pages), url_filters.derived_entries(pages))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each benchmark item in each document."""
    from stmtspark.llm import decontaminate

    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: conversations as target, all documents as background."""
    from stmtspark.llm import lm_scores

    return lm_scores.cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "conversations"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at shingle similarity 0.75."""
    from stmtspark.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness to each other and to the next document."""
    from stmtspark.llm import fingerprints

    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers give each text, with corpus-wide counts of linked ids."""
    import public_tokenizers as tokenizers

    from stmtspark.llm import alignment

    return alignment.align(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each hundredth vector for its five best positives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_html_text": op4_html_text,
    "op5_embedding_neardup": op5_embedding_neardup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_decontamination": op8_decontamination,
    "op9_lm_scores": op9_lm_scores,
    "op10_minhash": op10_minhash,
    "op11_fingerprints": op11_fingerprints,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op7_url_filters": url_filters.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
