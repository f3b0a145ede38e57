"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` keeps the prefix sums of c[i] * B**i of a run of code points, modulo 2**31 - 1 and for two bases B.
The hash of any span is a difference of two of them times an inverse power, so two spans compare in constant
time, and the longest common extension of two places is found by binary search on the span length.  Two
unlike spans of n code points get one hash with a probability of about (n / 2**31)**2.

A fingerprint is the length of a text, its hash, and the SKETCH least mixed hashes of its spans of WINDOW
code points (the whole text as one span when it is shorter); the second and further times that a span comes in a
block of BLOCK code points count as spans of their own.  ``likeness`` of two fingerprints is the share of spans
that they hold in common, 2 * both / (one + other), estimated from the least hashes of the union; it is exact
for texts of up to SKETCH spans, and 1 for equal texts.

Texts are hashed in blocks, so memory is bounded for texts of any length.  Null and empty texts have one
fingerprint, like itself only.  Other columns pass through, but for those of the names that are added.

``edited_fingerprints`` needs each document's successor by id.  The texts are exchanged once, into ranges of ids
between boundaries that are quantiles of the id column; each range is given the first document of the next one
as a tail, and the last one the first document of all.  Rows that repeat an id are ordered by their text, and each
is followed by the next of them.  A row without an id has no successor: its last quarter is replaced by nothing and
near_next is 0.  A single document is its own successor.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stmtspark.llm.common import text_chunks

BITS = 31
PRIME = 2**BITS - 1
BASES = (911_382_323, 972_663_749)
WINDOW, SKETCH, BLOCK = 12, 64, 1 << 18
_P, _BITS = np.uint64(PRIME), np.uint64(BITS)


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo PRIME, in fewer bits."""
    return (x & _P) + (x >> _BITS)


def _least(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME."""
    x = _fold(_fold(x))
    return x - _P * (x >= _P)


class _Powers:
    """B**i and B**-i, grown as needed."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> _Powers:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _least(self.up * np.uint64(pow(self.base, k, PRIME)))])
            self.down = np.concatenate([self.down, _least(self.down * np.uint64(pow(self.back, k, PRIME)))])
        return self


_powers = [_Powers(b) for b in BASES]


def codes_of(text: str | None) -> np.ndarray:
    """Code points plus one, so that no character vanishes in a sum."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)


class Prefixes:
    """Modular prefix arrays of a run of codes; sums are not reduced, as they stay under 2**63."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = np.zeros((len(_powers), self.n + 1), dtype=np.uint64)
        for p, s in zip(_powers, self.sums, strict=True):
            np.cumsum(_fold(codes * p.to(self.n + 1).up[: self.n]), out=s[1:])

    def span(self, start: int, stop: int) -> int:
        """Hash of the span [start, stop), 62 bits."""
        out = 0
        for p, s in zip(_powers, self.sums, strict=True):
            out = out << BITS | (int(s[stop]) - int(s[start])) * int(p.down[start]) % PRIME
        return out

    def windows(self, size: int, most: int) -> np.ndarray:
        """The first base's hashes of the first ``most`` spans of ``size`` codes, by position."""
        k = min(most, self.n - size + 1)
        s = self.sums[0]
        return _least(_fold(s[size : size + k] - s[:k]) * _powers[0].down[:k]).astype(np.uint32)

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether ``length`` codes from i and those of ``other`` from j are the same."""
        return self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """How many codes from the places i and j on are the same, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        if self.equal(i, other, j, high):
            return high
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def common_extension(x: np.ndarray, y: np.ndarray) -> int:
    """How many codes x and y begin with in common: block by block, and by binary search in the block that differs."""
    most, at = min(len(x), len(y)), 0
    while at < most:
        size = min(BLOCK, most - at)
        found = Prefixes(x[at : at + size]).extension(0, Prefixes(y[at : at + size]), 0)
        at += found
        if found < size:
            break
    return at


def _counted(spans: np.ndarray) -> np.ndarray:
    """The SKETCH least mixed hashes (32 bits) of (span, its how-manieth time), sorted."""
    spans = np.sort(spans)
    place = np.arange(len(spans))
    first = np.ones(len(spans), dtype=bool)
    first[1:] = spans[1:] != spans[:-1]
    nth = place - np.maximum.accumulate(np.where(first, place, 0))
    x = spans.astype(np.uint64) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(29))) >> np.uint64(16)).astype(np.uint32)
    return np.unique(np.partition(x, SKETCH)[: SKETCH + 1])[:SKETCH] if len(x) > SKETCH else np.unique(x)


class Fingerprint:
    """Length, hash and least span hashes of a text."""

    def __init__(self, n: int, whole: int, least: np.ndarray, prefixes: Prefixes | None = None):
        self.n, self.whole, self.least, self.prefixes = n, whole, least, prefixes

    @classmethod
    def of(cls, codes: np.ndarray) -> Fingerprint:
        """The fingerprint of a text, which keeps the prefix arrays of a text of one block."""
        own = None
        n, sums, best = len(codes), [0] * len(BASES), np.zeros(0, dtype=np.uint32)
        size = min(WINDOW, n)
        for at in range(0, n, BLOCK):
            own = Prefixes(codes[at : at + BLOCK + WINDOW - 1])
            end = min(BLOCK, n - at)
            for k, p in enumerate(_powers):
                sums[k] = (sums[k] + int(own.sums[k][end]) * pow(p.base, at, PRIME)) % PRIME
            if own.n >= size:
                best = np.unique(np.concatenate([best, _counted(own.windows(size, BLOCK))]))[:SKETCH]
        return cls(n, sums[0] << BITS | sums[1], best, own if n <= BLOCK else None)

    def __str__(self) -> str:
        return f"{self.n:x}:{self.whole:016x}:{self.least.astype('>u4').tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, least = text.split(":")
        return cls(int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(least), dtype=">u4").astype(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        """Share of spans in common, 0 to 1."""
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        both = np.sort(np.concatenate([self.least, other.least]))
        twice = both[1:] == both[:-1]
        new = np.concatenate([[True], ~twice])[: len(both)]  # the first of each unlike value, and how many of those come before
        size = min(SKETCH, int(new.sum()))
        if size == 0:
            return 0.0
        shared = int((twice & (np.cumsum(new)[1:] <= size)).sum()) / size
        return 2 * shared / (1 + shared)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints in their text form."""
    return Fingerprint.parse(a).likeness(Fingerprint.parse(b))


def _added(df: DataFrame, *fields: StructField) -> tuple[DataFrame, StructType]:
    df = df.drop(*[f.name for f in fields])
    return df, StructType([*df.schema.fields, *fields])


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_chars (code points) and fingerprint of each text."""
    df, schema = _added(df, StructField("n_chars", LongType()), StructField("fingerprint", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in text_chunks(texts):
                found = [Fingerprint.of(codes_of(t)) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array([f.n for f in found], pa.int64()), pa.array(map(str, found), pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def common_extensions(df: DataFrame, left: str, right: str, left_at: str, right_at: str) -> DataFrame:
    """``df`` with extension: how many code points the texts ``left`` and ``right`` have in common from the two
    places (from 0) on; null where a text or place is null or a place is outside its text."""
    df, schema = _added(df, StructField("extension", LongType()))

    def one(x: str | None, y: str | None, i: int | None, j: int | None) -> int | None:
        if x is None or y is None or i is None or j is None or not (0 <= i <= len(x) and 0 <= j <= len(y)):
            return None
        return common_extension(codes_of(x[i:]), codes_of(y[j:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = map(one, *(batch.column(c).to_pylist() for c in (left, right, left_at, right_at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


class _Read:
    """A document on its way: its codes and fingerprint, until its successor has come."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.codes = codes_of(self.text)
        self.own = Fingerprint.of(self.codes)

    def row(self, after: _Read | None) -> tuple:
        n = len(self.text)
        q = n // 4
        edited = self.text[: n - q] + (after.text[:q] if after else "")
        new = codes_of(edited)
        print_ = Fingerprint.of(new) if q else self.own
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        one, two = self.own.prefixes, print_.prefixes
        kept = one.extension(0, two, 0) if one and two else common_extension(self.codes, new)
        return self.doc_id, n, sha, str(self.own), str(print_), self.own.likeness(print_), self.own.likeness(after.own) if after else 0.0, kept


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix long"
_KINDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kept_prefix", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KINDS, strict=True)], schema=_KINDS)


def _succession(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order, each with its successor; a tail row is only a successor."""
    held, of, out = None, None, []
    for batch in batches:
        for a, b in text_chunks(batch.column("text").to_pylist()):
            part = batch.slice(a, b - a)
            for own, tail, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")), strict=True):
                if of != own:
                    held, of = None, own
                elif held is None:
                    continue  # a further tail of a range that is done
                now = _Read(doc_id, text)
                if held is not None:
                    out.append(held.row(now))
                held = None if tail else now
            if out:
                yield _batch(out)
                out = []


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in text_chunks(texts):
            yield _batch([_Read(None, t).row(None) for t in texts[a:b]])


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or under the value, by a search over every k-th and then the k after it."""
    k = max(1, int(len(bounds) ** 0.5))
    tops, all_of = F.lit(bounds[k - 1 :: k]).cast("array<bigint>"), F.lit(bounds).cast("array<bigint>")
    outer = F.size(F.filter(tops, lambda x: x <= value))
    return outer * k + F.size(F.filter(F.slice(all_of, outer * k + 1, F.lit(k)), lambda x: x <= value))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document, with the next one by id (after the last: the first): n_chars, the SHA-256 of the text whose
    last n_chars / 4 code points are replaced by the first as many of the next text, both fingerprints, their likeness
    and that to the next text's, and kept_prefix, the code points that text and edited text begin with in common."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = docs.filter("doc_id IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    # a few numbers for each partition: the quantiles of the ids, and the least id of each range
    cuts = placed.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("q")).first()["q"]
    bounds = sorted(set(cuts or []))
    ranged = placed.withColumn("range", _range_of(F.col("doc_id"), bounds) if bounds else F.lit(0))
    firsts = sorted((r["range"], r["id"]) for r in ranged.groupBy("range").agg(F.min("doc_id").alias("id")).collect())
    before = [(firsts[i - 1][0], r, least) for i, (r, least) in enumerate(firsts)]
    tails = ranged.join(F.broadcast(spark.createDataFrame(before, "into int, range int, least long")), "range").filter("doc_id = least").select("doc_id", "text", F.col("into").alias("range"), F.lit(True).alias("tail"))
    rows = ranged.select("doc_id", "text", "range", F.lit(False).alias("tail")).union(tails)
    ordered = rows.repartition(parts, "range").sortWithinPartitions("range", "tail", "doc_id", "text")
    return ordered.mapInArrow(_succession, _EDITED).union(docs.filter("doc_id IS NULL").mapInArrow(_alone, _EDITED))
