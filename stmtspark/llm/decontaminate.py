"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

For each benchmark item, windows of the item's own number of words slide over every document.  Each
window has a 64-bit SimHash of its five-word shingles.  The item fingerprints are indexed by BLOCKS
blocks of eight bits: two fingerprints within RADIUS bits agree, in one block at least, up to
RADIUS // BLOCKS bits, so looking up every block value within that many bits finds all of them.
Candidates are verified by exact weighted-shingle similarity, sum of minima over sum of maxima of
the shingle counts, at LEAST or more.

At similarity 0.75 the cosine of two shingle counts is about 0.857 and their fingerprints differ in 11
bits, with a deviation of 3; so RADIUS 22 loses about 1 in 5,000 of the pairs just at 0.75, and far fewer
above.  A window that shares no shingle with any item of its length has similarity 0 with them all, so
only windows around a shared shingle are fingerprinted; this loses nothing.  With so wide a radius the
index alone passes most items of a length for most windows, so without this every window of every
document would be verified against them.

The benchmark is not joined but searched as a query set: it is cut into groups of at most GROUP items,
whose index has a bounded size, and each group is broadcast and searched over all documents in a pass of
its own.  No document is shuffled; found windows are grouped by document and item, for any number of
groups.  Fingerprints are summed over PIECE shingles at a time, so memory grows with a text's words only.

Null, empty and short documents match nothing, but an item of one to four words matches a document
that is exactly that sequence.  Documents with a null doc_id cannot be named and are left out; repeated
rows of one doc_id count as one document, of ties the first window holds.  Null and empty items and null
item_ids are left out; items with one text are all reported, and of several texts of one item_id the best.
Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtspark.llm.common import SHINGLE, mix, shingle_sequence, small_batches, text_chunks, tidied, word_hashes

LEAST, RADIUS, BLOCKS, GROUP, PIECE = 0.75, 22, 8, 20_000, 16_384
_BITS = np.arange(64, dtype=np.uint64)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    return ((mix(shingles)[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def near_values(radius: int) -> list[list[int]]:
    """For each byte, the bytes within ``radius`` bits."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(8), k)]
    return [[x ^ m for m in masks] for x in range(256)]


def window_starts(hits: np.ndarray, span: int, length: int) -> np.ndarray:
    """First places of the windows of ``span`` places that hold one of ``hits``, each once."""
    change = np.zeros(length + 1, dtype=np.int32)
    np.add.at(change, np.maximum(hits - span + 1, 0), 1)
    np.add.at(change, np.minimum(hits, length - span) + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


class ItemIndex:
    """Fingerprints of one group of items, by length and block value."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.seqs, self.sizes, prints = [], [], [], []
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            words = word_hashes(text)
            if 0 < len(words) < SHINGLE:
                self.short[tuple(words.tolist())].append(item_id)
            elif len(words):
                seq = shingle_sequence(words)
                self.ids.append(item_id)
                self.seqs.append(np.unique(seq, return_counts=True))
                self.sizes.append(len(seq))
                prints.append(packed(signs(seq).sum(axis=0)[None, :])[0])
        self.prints = np.array(prints, dtype=np.uint64)
        every = [s for s, _ in self.seqs]
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        owners: dict[int, set[int]] = defaultdict(set)
        for (s, _), n in zip(self.seqs, self.sizes, strict=True):
            for x in s.tolist():
                owners[x].add(n)
        self.sizes_of = owners
        near = near_values(RADIUS // BLOCKS)
        self.table: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for k, (n, f) in enumerate(zip(self.sizes, prints, strict=True)):
            for b in range(BLOCKS):
                for value in near[(int(f) >> (8 * b)) & 255]:
                    self.table[n, b, value].append(k)

    def search(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity): the best window of each item that reaches LEAST."""
        if 0 < len(words) < SHINGLE:
            return [(i, 0, len(words), 1.0) for i in self.short.get(tuple(words.tolist()), [])]
        if len(words) == 0 or not len(self.known):
            return []
        seq = shingle_sequence(words)
        at = np.searchsorted(self.known, seq)
        hits = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == seq)
        if not len(hits):
            return []
        around: dict[int, list[int]] = defaultdict(list)
        for h, x in zip(hits.tolist(), seq[hits].tolist(), strict=True):
            for n in self.sizes_of[x]:
                around[n].append(h)
        best: dict[int, tuple[float, int, int]] = {}
        for n, own in around.items():
            span = min(n, len(seq))
            first = window_starts(np.array(own), span, len(seq))
            for part in np.split(first, np.flatnonzero(np.diff(first // PIECE)) + 1):
                low = int(part[0])
                sums = np.zeros((int(part[-1]) + span - low + 1, 64), dtype=np.int32)
                np.cumsum(signs(seq[low : low + len(sums) - 1]), axis=0, out=sums[1:])
                prints = packed(sums[part - low + span] - sums[part - low])
                for s, f in zip(part.tolist(), prints.tolist(), strict=True):
                    found = set()
                    for b in range(BLOCKS):
                        found.update(self.table.get((n, b, (f >> (8 * b)) & 255), ()))
                    for k in found:
                        if (f ^ int(self.prints[k])).bit_count() <= RADIUS:
                            j = self.similarity(k, seq[s : s + span])
                            if j >= LEAST and (k not in best or (-j, s) < (-best[k][0], best[k][1])):
                                best[k] = (j, s, span)
        return [(self.ids[k], s, span + SHINGLE - 1, j) for k, (j, s, span) in sorted(best.items())]

    def similarity(self, k: int, window: np.ndarray) -> float:
        shingles, counts = self.seqs[k]
        own, n = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(shingles, own, assume_unique=True, return_indices=True)
        low = np.minimum(counts[i], n[j]).sum()
        return float(low / (counts.sum() + n.sum() - low))


def _search(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        for a, b in text_chunks(texts):
            rows = [(i, *hit) for i, t in zip(ids[a:b], texts[a:b], strict=True) for hit in index.search(word_hashes(t))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each item found in each document."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
    groups = max(1, -(-asked.count() // GROUP))
    out = None
    for g in range(groups):
        own = asked if groups == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)
        index = spark.sparkContext.broadcast(ItemIndex([(r["id"], r["text"]) for r in own.orderBy("id", "text").collect()]))
        found = src.mapInArrow(lambda it, index=index: tidied(_search(it, index.value)), "doc_id long, item_id long, first_word long, n_words long, similarity double")
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("first_word", "n_words", "similarity"), F.struct("similarity", -F.col("first_word"))).alias("b")).select("doc_id", "item_id", "b.*")
