"""Alignment of two tokenizers' tokens by interval coalescing.

``coalesce`` takes the byte intervals of both sides' tokens at once: they are sorted by start (lexsort), the
running maximum of their ends is kept (maximum.accumulate), and a group ends where a start reaches it.  Inside
groups every A interval is expanded to the B intervals that it overlaps.

A text is cut into chunks before each space that follows something other than white space.  No token of either
side crosses such a place: A's pattern has no match that goes on with a space after another character than white
space, and B's pieces hold their space mark at the front only, which is looked up when the model is loaded (with
a model that has other pieces, texts are not cut).  So a chunk is encoded and aligned once while a worker
remembers it, all new chunks of a batch in one call, and a document is its chunks in a row.

``aligned`` gives each document its counts and its unlike linked id pairs with their number, packed.  ``pair_counts``
counts in how many documents each pair is linked; tasks add up what they have read before the shuffle.
``align`` puts both together.  The most frequent pairs, at most HOT of them (that is checked), are broadcast;
the documents' other pairs are joined with their counts by a shuffle, in which no pair has more rows than its
count, which is under that of the broadcast ones.

Texts that are null or empty, or whose tokens' bytes differ from a space and the text, have no tokens: all
numbers are 0, and groups_sha256 is ''.  A text holds a pair once for the counts, however often it is linked.
Rows that repeat a doc_id are documents of their own, and so are those without an id.  Very long texts are read
in parts.  Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtspark.llm.common import cut, text_chunks, tidied
from stmtspark.llm.token_counts import byte_letters

#: Pairs that are broadcast at most (17 bytes each), chunks that a worker remembers and learns at once, pairs that a task adds up.
HOT, CACHE, AT_ONCE, GATHERED = 1_000_000, 250_000, 4_000, 1_000_000
#: How A's file splits a text into pre-tokens (a fixed value of its kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are cut into chunks at once.
PART_CHARS = 500_000
#: A pair is a << SHIFT | b.
SHIFT = 24
_cuts = re.compile(r"(?<=\S) ").split
_odd = re.compile(r"\s ").search
_end = re.compile(r"\S ").search
_late = re.compile("[\u0370-\U0010ffff]").search


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A and of each B interval, and the number of groups; intervals of a side are in order."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((-end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), dtype=bool)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return group[: len(a_start)], group[len(a_start) :], int(new.sum())


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A index, B index) of all overlapping intervals; those of a side are in order and apart."""
    first = np.searchsorted(b_end, a_start, side="right")
    count = np.maximum(np.searchsorted(b_start, a_end, side="left") - first, 0)
    left = np.repeat(np.arange(len(a_start)), count)
    return left, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(left))


class _Known:
    """What is known of chunks: numbers by place, their pairs one behind the other, and the text of their groups."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.numbers = np.zeros((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, begin and end of the pairs
        self.pairs = np.zeros(0, dtype=np.int64)
        self.groups: list[str | None] = []

    def add(self, chunks: list[str], numbers: np.ndarray, pairs: np.ndarray, groups: list[str | None]) -> None:
        self.place.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        numbers[:, 3:] += len(self.pairs)
        self.numbers, self.pairs = np.concatenate([self.numbers, numbers]), np.concatenate([self.pairs, pairs])
        self.groups += groups


class Aligner:
    """Encodes and aligns chunks, one per Python worker and pair of files."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["id"] for x in spec["added_tokens"]}
        vocabulary = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items() if i not in special}
        self.a_bytes = [vocabulary.get(i, b"") for i in range(1 + max(vocabulary))]
        # the same merges by a faster library, for letters that no version of Unicode has moved
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in vocabulary.items()}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.a_bytes, self.b_bytes))
        # decimal ids with what follows them: A in a group, A at its end, B in a group, B at its end
        self.words = [f"{i}{sign}" for size, signs in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for sign in signs for i in range(size)]
        self.word_size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.known = _Known()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def chunks(self, text: str) -> list[str]:
        """The text in chunks, each without the space before it that the first one has too."""
        if not self.splits:
            return [text]
        own = _cuts(text) if "  " in text or _odd(text) else text.split(" ")
        if len(own) > 1 and not own[0] and text[0] == " ":  # a text that begins with a space begins with two
            own[:2] = [" " + own[1]]
        if len(own) > 1 and not own[-1]:
            own[-2:] = [own[-2] + " "]
        return own

    def _encoded(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of both sides of chunks that stand one behind the other, if their bytes come out the same."""
        if not self.splits and len(chunks) > 1:
            return None
        text = " ".join(chunks)
        whole = (" " + text).encode("utf-8", "replace")
        a = self.fast.encode_ordinary(" " + text) if _late(text) is None else self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        if b"".join([self.b_bytes[k] for k in b]) != whole or b"".join([self.a_bytes[k] for k in a]) != whole:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.cumsum(sizes)

    def learn(self, chunks: list[str]) -> None:
        """Encode and align chunks that are not known yet, all in one call."""
        sizes = np.array([len(c.encode("utf-8", "replace")) + 1 for c in chunks])
        found = self._encoded(chunks, sizes)
        if found is None and len(chunks) > 1:  # some chunk's bytes come out differently: halves, down to that chunk
            half = len(chunks) // 2
            self.learn(chunks[:half])
            self.learn(chunks[half:])
            return
        if found is None:
            self.known.add(chunks, np.zeros((1, 5), dtype=np.int64), np.zeros(0, np.int64), [None])
            return
        a, b, ends = found
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        a_group, b_group, n_groups = coalesce(a_start, a_end, b_start, b_end)
        left, right = overlaps(a_start, a_end, b_start, b_end)
        a_to, b_to = np.searchsorted(a_end, ends, side="right"), np.searchsorted(b_end, ends, side="right")
        p_to, g_to = np.searchsorted(left, a_to), a_group[a_to - 1] + 1
        # the groups' text: each side's ids of a group in order, A before B
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        code = np.concatenate([a + len(self.a_bytes) * a_last, b + 2 * len(self.a_bytes) + len(self.b_bytes) * b_last])
        code = code[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")]
        text = "".join(map(self.words.__getitem__, code.tolist()))
        t_to = np.cumsum(self.word_size[code])[a_to + b_to - 1].tolist()
        before = lambda x: np.concatenate([[0], x[:-1]])
        numbers = np.stack([a_to - before(a_to), b_to - before(b_to), g_to - before(g_to), before(p_to), p_to], axis=1)
        self.known.add(chunks, numbers, (a[left] << SHIFT) | b[right], [text[i:j] for i, j in zip([0, *t_to], t_to)])

    def places(self, chunks: list[str]) -> list[int]:
        """Where chunks are known, new ones after they have been learnt."""
        if len(self.known.groups) > CACHE:
            self.known = _Known()
        new = set(chunks).difference(self.known.place)
        # B's space mark in a text comes out as a space; chunks with spaces at an end would grow together with others
        odd = [c for c in new if "▁" in c]
        apart = [c for c in new.difference(odd) if c[0].isspace() or c[-1] == " "]
        joined = list(new.difference(odd, apart))
        self.known.add(odd, np.zeros((len(odd), 5), dtype=np.int64), np.zeros(0, np.int64), [None] * len(odd))
        for at in range(0, len(joined), AT_ONCE):
            self.learn(joined[at : at + AT_ONCE])
        for c in apart:
            self.learn([c])
        return list(map(self.known.place.__getitem__, chunks))

    def _parts(self, chunks: list[str], lengths: list[int]) -> Iterator[tuple]:
        """(numbers, text of the groups, pairs, times) of runs of chunks; None in place of a text that comes out differently."""
        at = self.places(chunks)
        own = self.known.numbers[at]
        begin, count = own[:, 3], own[:, 4] - own[:, 3]
        ends = np.cumsum(lengths)
        run = np.repeat(np.repeat(np.arange(len(lengths)), lengths), count)
        pairs = self.known.pairs[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(run))]
        links = np.sort((run << 2 * SHIFT) | pairs)
        new = np.flatnonzero(np.append(True, links[1:] != links[:-1])) if len(links) else np.zeros(0, np.int64)
        times, links = np.diff(np.append(new, len(links))), links[new]
        p_at = np.searchsorted(links >> 2 * SHIFT, np.arange(len(lengths) + 1)).tolist()
        links &= (1 << 2 * SHIFT) - 1
        for i, (stop, n) in enumerate(zip(ends.tolist(), lengths, strict=True)):
            groups = list(map(self.known.groups.__getitem__, at[stop - n : stop]))
            yield own[stop - n : stop, :3].sum(axis=0), None if None in groups else "".join(groups), links[p_at[i] : p_at[i + 1]], times[p_at[i] : p_at[i + 1]]

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text; pairs are unlike and sorted."""
        split = [self.chunks(t) if t and len(t) <= PART_CHARS else [] for t in texts]
        short = self._parts([c for own in split for c in own], list(map(len, split)))
        for text, done in zip(texts, list(short), strict=True):
            yield _document([done] if len(text or "") <= PART_CHARS else (next(self._parts(c, [len(c)])) for c in map(self.chunks, self.cut(text))))

    def cut(self, text: str) -> Iterator[str]:
        """A long text in parts that end where chunks do."""
        at = 0
        while self.splits and len(text) - at > PART_CHARS and (m := _end(text, at + PART_CHARS)) is not None and m.end() < len(text):
            yield text[at : m.end() - 1]
            at = m.end()
        yield text[at:]


def _document(parts: Iterable[tuple]) -> tuple:
    """One document of its parts."""
    sums, seen = np.zeros(3, dtype=np.int64), hashlib.sha256()
    pairs = times = np.zeros(0, np.int64)
    held = ""
    for own, groups, new, n in parts:
        if groups is None:
            return NONE
        seen.update((held + groups[:-1]).encode())  # without the last sign
        held = ";"
        sums += own
        pairs, times = _added(pairs, times, new, n) if len(pairs) else (new, n)
    return (*sums.tolist(), int(times.sum()), seen.hexdigest(), pairs, times) if sums[0] else NONE


NONE = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def _added(pairs: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unlike pairs of both, with the sums of their counts."""
    out, at = np.unique(np.concatenate([pairs, more]), return_inverse=True)
    return out, np.bincount(at, np.concatenate([counts, n]), len(out)).astype(np.int64)


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs and their numbers as bytes that compress well: differences, byte by byte."""
    steps = np.diff(pairs, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return steps.T.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 10
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(packed[: 6 * n], dtype=np.uint8).reshape(6, n).T
    times = np.ascontiguousarray(np.frombuffer(packed[6 * n :], dtype=np.uint8).reshape(4, n).T)
    return np.cumsum(steps.view("<u8").ravel().astype(np.int64)), times.view("<u4").ravel().astype(np.int64)


_NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "packed"]


def aligned(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, packed) of each document."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_chunks(texts, 1_000_000):
                rows = [(*row[:5], pack(*row[5:])) for row in aligner.documents(texts[a:b])]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True))], names=["doc_id", *_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda it: tidied(run(it)), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, packed binary")


def pair_counts(docs: DataFrame) -> DataFrame:
    """(pair, n, best) of all pairs of ``aligned`` documents: the documents that hold it, and whether none of its A id's has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = counts = np.zeros(0, np.int64)
        new, held = [], 0
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                new.append(unpack(packed)[0])
                held += len(new[-1])
                if held > GATHERED:
                    pairs, counts = _added(pairs, counts, *np.unique(np.concatenate(new), return_counts=True))
                    new, held = [], 0
                    if len(pairs) > GATHERED:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = _added(pairs, counts, *np.unique(np.concatenate([pairs[:0], *new]), return_counts=True))
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    counts = docs.select("packed").mapInArrow(lambda it: tidied(run(it)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", SHIFT)))
    # one row for each A id: no more than its vocabulary has
    most = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _threshold(counts: DataFrame, hot: int) -> tuple[int, bool]:
    """The least power of two that at most ``hot`` pairs' counts reach, and whether any pair is under it."""
    sizes = counts.groupBy(F.floor(F.log2(F.col("n"))).cast("int").alias("bits")).agg(F.count("*").alias("pairs")).collect()  # 63 rows at most
    total, bits = 0, 62
    for row in sorted(sizes, reverse=True):
        if total + row["pairs"] > hot:
            return 1 << bits, True
        total, bits = total + row["pairs"], row["bits"]
    return 1, False


def align(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best are the links whose pair no other pair of the same A id exceeds in documents; count_sum adds up the
    documents of each link's pair.
    """
    spark = df.sparkSession
    docs = cut(aligned(df, a_path, b_path, doc_id, text).withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    counts = cut(pair_counts(docs))
    least, more = _threshold(counts, hot)
    held = counts.filter(F.col("n") >= least).sort("pair").toArrow()  # at most ``hot`` rows
    known = spark.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("pair", "n", "best")))

    def lookup(packed: bytes) -> tuple:
        pairs, times = unpack(packed)
        keys, n, best = known.value
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
        return pairs, times, at[found], found, n, best

    def hot_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for packed in batch.column("packed").to_pylist():
                _, times, at, found, n, best = lookup(packed)
                own = times[found]
                sums.append((int(own[best[at]].sum()), int((own * n[at]).sum())))
            yield pa.RecordBatch.from_arrays([*batch.select([c for c in batch.schema.names if c != "packed"]).columns, pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())], names=[*(c for c in batch.schema.names if c != "packed"), "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, packed in zip(batch.column("row").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                pairs, times, _, found, _, _ = lookup(packed)
                if not found.all():
                    out.append((np.full(int((~found).sum()), row), pairs[~found], times[~found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["row", "pair", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(hot_part, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long")
    if more:
        rare = docs.select("row", "packed").mapInArrow(rest, "row long, pair long, times long").join(counts.filter(F.col("n") < least), "pair")
        sums = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(sums, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
