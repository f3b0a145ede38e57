"""Helpers shared by the operators: word and shingle hashes, shared-folder tables, bounded filters.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z is lower-cased first.  A shingle is
the hash of five words in a row (of the whole sequence when a text has one to four words).
"""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CHUNK_CHARS = 2_000_000
_WORDS_KEPT = 150_000


class _WordHashes(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sequence(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words by position; one hash of all words when there are fewer."""
    n = len(words)
    if n == 0:
        return words
    span = min(size, n)
    out = np.full(n - span + 1, span, dtype=np.uint64)
    for i in range(span):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - span + 1 + i]
    return mix(out)


def text_chunks(texts: list[str | None], limit: int = CHUNK_CHARS):
    """(start, stop) runs of rows of about ``limit`` characters, one row at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat) if kind is None else pa.array(flat, kind))


def binary_array(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        found = _local[app]
    return found.rstrip("/")


_libc = ctypes.CDLL(None)
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python TEXT_ROWS at a time, where the session has Spark's 10,000."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, TEXT_ROWS)


def tidied(parts: Iterator) -> Iterator:
    """What a task yields; at its end the worker gives freed memory back, as it lives on for other stages."""
    yield from parts
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


class _Tables(threading.local):
    """The tables that this thread has written; queries in other threads have their own."""

    def __init__(self):
        self.paths: list[str] = []


_tables = _Tables()


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _tables.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """How many tables ``cut`` has written in this thread so far, to be given to ``discard``."""
    return len(_tables.paths)


def discard(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the tables that ``cut`` wrote in this thread after the first ``since``, but for the last ``keep``.

    For tables that no later plan reads: those of a step whose result was cut itself.
    """
    gone = _tables.paths[since : len(_tables.paths) - keep]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _tables.paths[since : since + len(gone)]


#: Bits of an id filter: its size is the same for every input, 2 MB.
FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A one-hash Bloom filter of the ids: FILTER_BITS bits whatever the input.

    It has no false negatives; it only spares rows a shuffle, and fills up (passing all) in the worst case.
    """
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))
    words = (
        ids.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def filter_slot(column: str):
    """The slot column that ``in_filter`` looks up."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS)).cast("int")


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1 == 1
