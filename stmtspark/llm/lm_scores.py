"""Cross-entropy difference of matched n-gram models.

Two word-bigram models share one vocabulary, all words of both corpora: the target model counts the
target texts, the background model all documents.  Both are smoothed alike, with MU counts spread
evenly over the vocabulary.  A document's score is its per-token loss under the target model minus
that under the background model; lower means more like the target.

Counts cover both corpora whole and are never gathered in the driver.  Counting and scoring share one
exchange: a task sends each of its bigram occurrences, packed by context, to the context's partition;
there all counts of the context meet, and every occurrence gets its loss difference.  The sums go
back packed by chunk of documents, and are put together there in a fixed order.

Frequent contexts would overload their partition: those of one in HOT tokens or more, and all of
PARTITION_TOKENS / 2 or more, so that what one context brings to a task is bounded at any size.  Their
counts come from a grouped sum first and are broadcast, 24 bytes each; of word frequencies as texts have
them that is some millions of words at 100 TB, and MOST_HOT is checked: the least count doubles until the
list fits.  Their bigrams are dealt out by both words; bigrams that frequent themselves are scored where
they are read.

Words are told apart by 64-bit hashes, and the next words of one context by 32 bits of theirs.  Null and
empty texts have 0 tokens and score 0.0.  Repeated rows of one doc_id count as one longer document.
Documents with a null doc_id count for the background model and have no row.  With an empty target both
models of a bigram are compared all the same: the target model is then uniform.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtspark.llm.common import cut, mix, small_batches, text_chunks, tidied, word_hashes

MU, HOT, PARTITION_TOKENS, MOST_HOT = 2.0, 2000, 600_000, 4_000_000
START = np.uint64(0x5374617274)
_CHARS = 4_000_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, roles, tokens per text, contexts, next words) of runs of whole texts."""
    for batch in batches:
        ids, role, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("role").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        for a, b in text_chunks(texts, _CHARS):
            own = [word_hashes(t) for t in texts[a:b]]
            lengths = np.array([len(x) for x in own])
            after = np.concatenate([np.zeros(0, np.uint64), *own])
            before = np.empty_like(after)
            before[1:] = after[:-1]
            before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
            yield ids[a:b], role[a:b], lengths, before, after


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each word as a context, by corpus, and whether it is a word of the vocabulary."""
    for _, role, lengths, before, after in _chunks(batches):
        if not len(after):
            continue
        t = np.repeat(role == OF_TARGET, lengths)
        words, at = np.unique(np.concatenate([before, after]), return_inverse=True)
        n = len(before)
        ctx_t = np.bincount(at[:n][t], minlength=len(words))
        ctx_b = np.bincount(at[:n][~t], minlength=len(words))
        known = np.bincount(at[n:], minlength=len(words)) > 0
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ctx_b), pa.array(ctx_t), pa.array(known)], names=["w", "b", "t", "known"])


class Hot:
    """Counts of frequent contexts and bigrams."""

    def __init__(self, contexts: list, pairs: list):
        contexts, pairs = sorted(contexts), sorted(pairs)
        self.words, self.cb, self.ct = self._columns(contexts)
        self.pairs, self.pb, self.pt = self._columns(pairs)

    @staticmethod
    def _columns(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return np.array(cols[0], dtype=np.int64), np.array(cols[1], dtype=np.float64), np.array(cols[2], dtype=np.float64)

    @staticmethod
    def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        keys = keys.view(np.int64)
        if not len(sorted_keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + after)


def _frequent_pairs(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    """Counts of the bigrams whose words are both frequent; others cannot be frequent."""
    for _, role, lengths, before, after in _chunks(batches):
        keep = (hot.find(hot.words, before) >= 0) & (hot.find(hot.words, after) >= 0)
        if keep.any():
            keys, at = np.unique(pair_key(before[keep], after[keep]), return_inverse=True)
            t = np.repeat(role == OF_TARGET, lengths)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at[~t], minlength=len(keys))), pa.array(np.bincount(at[t], minlength=len(keys)))], names=["k", "b", "t"])


def _loss(pair: np.ndarray, context: np.ndarray, size: int) -> np.ndarray:
    return -np.log((pair + MU / size) / (context + MU))


_PACKED = "p int, kind int, chunk long, first binary, second binary, words binary, owners binary, counts binary"
_NAMES = ["p", "kind", "chunk", "first", "second", "words", "owners", "counts"]
_KINDS = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
#: Kinds of rows: bigrams of documents, bigrams of the target, and a chunk's own ids.
BACKGROUND, TARGET, HEADER = 0, 1, 2
#: Roles of texts: a document that is scored, a text of the target, and a document that is only counted.
SCORED, OF_TARGET, NAMELESS = 0, 1, 2


def _deal(batches: Iterator[pa.RecordBatch], hot: Hot, size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Bigram occurrences packed by partition and context; a header row has what is scored here.

    A chunk's number is made of the task's partition and a count, so a repeated task gives the same.
    """
    task, number = TaskContext.get().partitionId(), 0
    for ids, role, lengths, before, after in _chunks(batches):
        owner = np.repeat(np.arange(len(ids)), lengths)
        for flag in (SCORED, OF_TARGET, NAMELESS):
            for a in range(0, len(ids), 60_000):  # owners are 16-bit
                own = np.flatnonzero(role[a : a + 60_000] == flag) + a
                if len(own):
                    place = np.full(len(ids), -1)
                    place[own] = np.arange(len(own))
                    keep = place[owner] >= 0
                    rows = _deal_part(ids[own], flag, lengths[own], place[owner][keep], before[keep], after[keep], hot, size, parts, (task << 32) + number)
                    number += 1
                    for at in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64], strict=True), _KINDS, strict=True)], names=_NAMES)


def _deal_part(ids, flag: int, lengths, owner, before, after, hot: Hot, size: int, parts: int, chunk: int) -> list[tuple]:
    key = pair_key(before, after)
    at, ctx = hot.find(hot.pairs, key), hot.find(hot.words, before)
    known = (at >= 0) & (ctx >= 0)
    rows = []
    if flag == SCORED:
        more = _loss(hot.pt[at[known]], hot.ct[ctx[known]], size) - _loss(hot.pb[at[known]], hot.cb[ctx[known]], size)
        sums = np.bincount(owner[known], weights=more, minlength=len(ids))
        rows.append((chunk % parts, HEADER, chunk, ids.astype(np.int64).tobytes(), lengths.astype(np.int64).tobytes(), sums.tobytes(), b"", b""))
    rest = ~known
    owner, before, after, key, ctx = owner[rest], before[rest], after[rest], key[rest], ctx[rest]
    p = (np.where(ctx >= 0, key, mix(before)) % np.uint64(parts)).astype(np.int64)
    word = (mix(after) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((owner, word, before, p))
    p, before, word, owner = p[order], before[order], word[order], owner[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (before[1:] != before[:-1]) | (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(p))).astype(np.uint32)
    p, before, word, owner = p[first], before[first], word[first], owner[first].astype(np.uint16)
    a = 0
    for b in np.append(np.flatnonzero(np.diff(p)) + 1, len(p)).tolist() if len(p) else []:
        runs = np.append(np.flatnonzero(before[a + 1 : b] != before[a : b - 1]) + 1, b - a)
        starts = np.append(0, runs[:-1])
        rows.append((int(p[a]), TARGET if flag == OF_TARGET else BACKGROUND, chunk if flag == SCORED else -1, np.diff(runs, prepend=0).astype(np.uint32).tobytes(), before[a:b][starts].tobytes(), word[a:b].tobytes(), owner[a:b].tobytes(), counts[a:b].tobytes()))
        a = b
    return rows


_SCORED = "chunk long, kind int, ids binary, n binary, sums binary"


def _scored(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["chunk", "kind", "ids", "n", "sums"])


def _score(batches: Iterator[pa.RecordBatch], hot: Hot, size: int) -> Iterator[pa.RecordBatch]:
    """Loss differences of documents from all occurrences of one partition's contexts, packed by chunk."""
    chunks, ends, ctx, word, owner, count, is_t = [], [], [], [], [], [], []
    for r in (r for batch in batches for at in range(0, batch.num_rows, 32) for r in batch.slice(at, 32).to_pylist()):
        if r["kind"] == HEADER:
            yield _scored([(r["chunk"], HEADER, r["first"], r["second"], r["words"])])
            continue
        ctx.append(np.repeat(np.frombuffer(r["second"], np.uint64), np.frombuffer(r["first"], np.uint32)))
        word.append(np.frombuffer(r["words"], np.uint32))
        owner.append(np.frombuffer(r["owners"], np.uint16))
        count.append(np.frombuffer(r["counts"], np.uint32))
        is_t.append(np.full(len(word[-1]), r["kind"] == TARGET))
        chunks.append(r["chunk"] if r["chunk"] >= 0 else None)
        ends.append(len(word[-1]))
    if not ctx:
        return
    ctx, word, owner, count, is_t = (np.concatenate(x) for x in (ctx, word, owner, count, is_t))
    order = np.lexsort((word, ctx))
    sorted_ctx, sorted_word = ctx[order], word[order]
    new_ctx = np.append(True, sorted_ctx[1:] != sorted_ctx[:-1])
    new = new_ctx | np.append(True, sorted_word[1:] != sorted_word[:-1])
    of_pair, of_ctx, first = np.cumsum(new) - 1, np.cumsum(new_ctx) - 1, sorted_ctx[new_ctx]
    del ctx, word, sorted_ctx, sorted_word
    at, n, t = hot.find(hot.words, first), count[order], is_t[order]
    more = np.zeros(len(order))
    for mine, known, sign in ((t, hot.ct, 1), (~t, hot.cb, -1)):
        pair = np.bincount(of_pair, weights=n * mine)
        context = np.bincount(of_ctx, weights=n * mine)
        if len(known):
            context = np.where(at >= 0, known[at], context)
        more += sign * _loss(pair[of_pair], context[of_ctx], size)
    back = np.empty(len(order))
    back[order] = more * n
    a = 0
    for chunk, length in zip(chunks, ends, strict=True):
        b = a + length
        if chunk is not None:
            who, place = np.unique(owner[a:b], return_inverse=True)
            yield _scored([(chunk, BACKGROUND, who.tobytes(), b"", np.bincount(place, weights=back[a:b]).astype(np.float32).tobytes())])
        a = b


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each document from the rows of its chunk, which come one after the other, the header last."""
    chunk, got = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != chunk:
                chunk, got = r["chunk"], []
            if r["kind"] == BACKGROUND:
                got.append((np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["sums"], np.float32)))
                continue
            ids, n, sums = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["n"], np.int64), np.frombuffer(r["sums"], np.float64).copy()
            for who, more in got:
                sums[who] += more
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(sums)], names=["id", "n", "more"])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of each document, the score to five places."""
    spark = docs.sparkSession
    small_batches(spark)
    role = F.when(F.col("id").isNull(), NAMELESS).otherwise(SCORED)
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).select(F.coalesce("id", F.lit(-1)).alias("id"), role.alias("role"), "text")
    src = src.union(target.select(F.lit(-1).cast("long"), F.lit(OF_TARGET), F.col(target_text)))
    counts = cut(src.mapInArrow(_contexts, "w long, b long, t long, known boolean").groupBy("w").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.max("known").alias("known")))
    total = counts.agg(F.coalesce(F.sum(F.col("b") + F.col("t")), F.lit(0)).alias("n"), F.count_if("known").alias("v")).first()
    size, parts = max(total["v"], 1), max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["n"] // PARTITION_TOKENS)
    least = min(max(1, total["n"] // HOT), PARTITION_TOKENS // 2)
    while counts.filter((F.col("b") + F.col("t")) >= least).count() > MOST_HOT:
        least *= 2
    words = [tuple(r) for r in counts.filter((F.col("b") + F.col("t")) >= least).select("w", "b", "t").collect()] if total["n"] > HOT else []
    some = spark.sparkContext.broadcast(Hot(words, []))
    pairs = src.mapInArrow(lambda it: _frequent_pairs(it, some.value), "k long, b long, t long").groupBy("k").agg(F.sum("b").alias("b"), F.sum("t").alias("t")).filter((F.col("b") + F.col("t")) >= least)
    hot = spark.sparkContext.broadcast(Hot(words, [tuple(r) for r in pairs.collect()] if words else []))
    dealt = src.mapInArrow(lambda it: tidied(_deal(it, hot.value, size, parts)), _PACKED)
    scored = dealt.repartition(parts, "p").mapInArrow(lambda it: tidied(_score(it, hot.value, size)), _SCORED)
    sums = scored.repartition("chunk").sortWithinPartitions("chunk", "kind", "ids", "sums").mapInArrow(_gather, "id long, n long, more double").groupBy("id").agg(F.sum("n").alias("n"), F.sum("more").alias("more"))
    return sums.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), F.when(F.col("n") > 0, F.round(F.col("more") / F.col("n"), 5)).otherwise(0.0).alias("score"))
