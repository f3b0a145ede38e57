"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles by position (64-bit hashes).  For each of HASHES hash
functions the Cartesian tree over the token hashes groups all runs of at least WIDTH tokens by the place
of their minimum: a node is one compact window (left, centre, right), standing for every run that holds
the centre and stays inside.  Trees are cut level by level, for many documents at once, down to nodes
of WIDTH tokens.

Windows of all documents that share a hash function and minimum are brought together with a sketch of
what stands around the centre: SIDE blocks of BLOCK tokens on each side.

1. Windows with all blocks alike are copies there: one of them, the first in document order, stands for
   the others, already within a task's batch, so a passage that a third of all documents hold sends one
   row from each batch.
2. Each window left is joined with the first window of its group that agrees in a set of blocks, for
   every set of one block, of two blocks, and of as many blocks in a row as make a passage (``SETS``).  So
   an earlier window that shares the minimum by a common line, a fragment or a part of the passage hides
   no later copy: the copies agree in blocks that the fragment does not hold together.
3. A pair that agrees in STRONG blocks or more is a candidate; one that agrees in fewer is one if AGREE
   hash functions find it at about one offset.  Of several strong candidates of a window the one that
   agrees in most blocks is kept.
4. Candidates are verified on the tokens between the windows' ends, as 32-bit hashes: runs of tokens
   that the source has too, with gaps of at most GAP tokens, of 50 words or more and set similarity of
   0.75 or more.

An exact passage of WIDTH + BLOCK tokens or more always agrees in a set of blocks in a row, whatever
stands before or behind it and in whatever order documents come; shorter or edited ones agree in two
blocks around a centre of some hash function nearly always.  What can be missed is a copy with words put
in or left out in its middle, if earlier documents quote each side of that place.  Groups of more than LARGE windows are
joined by Spark on the same keys, with grouped minima, instead of in a task's memory; nothing is left out.

The copy that comes first (least doc_id) is the source; ``remove_repeats`` cuts the later copies out.
Which of several earlier copies is named as the source can depend on how rows are dealt to tasks; which
documents are named does not.  Only passages in different documents count.  A token that recurs within
WIDTH places is used once.

Null and empty texts and those under 50 words have no windows.  Null doc_ids are left out.  Repeated
rows of one doc_id count as one document.  Other columns pass through ``remove_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtspark.llm.common import SHINGLE, cut, filter_slot, id_filter, in_filter, mix, shingle_sequence, small_batches, text_chunks, tidied, word_hashes

WORDS = 50
WIDTH = WORDS - SHINGLE + 1
HASHES, AGREE, GAP, LEAST = 4, 2, 10, 0.75
_NONE = np.uint64(0xFFFFFFFF)
#: Blocks on each side of a centre, and tokens in a block.
SIDE, BLOCK = 4, 11
REACH, STRONG = SIDE * BLOCK, 3
#: Sets of blocks by which windows of a group are joined; blocks count from the far left to the far right.
SETS = [*combinations(range(2 * SIDE), 1), *combinations(range(2 * SIDE), 2), *(tuple(range(k, k + SIDE)) for k in range(SIDE + 1))]
#: Tokens to each side of a centre that a window's range is told for; runs further off have a nearer centre.
_FAR = (1 << 10) - 1
#: Windows of a group that a task joins in memory.
LARGE = 200_000
#: The hash function's place in v for rows that are pairs already, and hash functions of a strong pair.
_PAIR, SURE = 7, 3 << 6
_FOLD = 0x9E3779B97F4A7C15


def recent_repeats(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a token occurred within the WIDTH places before, in the same document."""
    order = np.argsort(tokens, kind="stable")
    near = np.zeros(len(tokens), dtype=bool)
    same = tokens[order][1:] == tokens[order][:-1]
    doc = np.searchsorted(starts, order, side="right")
    near[order[1:][same & (np.diff(order) <= WIDTH) & (doc[1:] == doc[:-1])]] = True
    return near


def compact_windows(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash function, left, centre, right) of the windows of at least WIDTH tokens; right is inclusive."""
    skip = recent_repeats(tokens, starts)
    places = np.arange(len(tokens), dtype=np.uint64)
    for h in range(HASHES):
        ranks = (mix(tokens + np.uint64(0x9E37 * (h + 1))) >> np.uint64(33)) << np.uint64(32)
        ranks[skip] = _NONE << np.uint64(32)
        keys = np.append(ranks | places, ~np.uint64(0))
        a, b = starts.copy(), starts + lengths  # open segments
        while True:
            wide = b - a >= WIDTH
            a, b = a[wide], b[wide]
            if not len(a):
                break
            bounds = np.empty(2 * len(a), dtype=np.int64)
            bounds[::2], bounds[1::2] = a, b
            least = np.minimum.reduceat(keys, bounds)[::2]
            real = (least >> np.uint64(32)) != _NONE
            a, b, c = a[real], b[real], (least[real] & _NONE).astype(np.int64)
            yield h, a, c, b - 1
            cuts = np.stack([a, c, c + 1, b], axis=1)
            a, b = cuts[:, [0, 2]].ravel(), cuts[:, [1, 3]].ravel()


_ROW = "v long, doc long, packed long, s1 long, s2 long"
_NAMES = ["v", "doc", "packed", "s1", "s2"]
_FOUND = "doc long, src long, off long, h long, a long, b long"


def block_hashes(tokens: np.ndarray) -> np.ndarray:
    """A 16-bit hash, never 0, of the BLOCK tokens from each place on (fewer at the end)."""
    out = np.zeros(len(tokens), dtype=np.uint64)
    for i in range(BLOCK):
        out[: len(tokens) - i] = out[: len(tokens) - i] * np.uint64(_FOLD) + tokens[i:]
    return np.maximum(mix(out) >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def sketches(hashes: np.ndarray, centre: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The block hashes around each centre; 0 for blocks that the document [start, stop) has not whole."""
    out = np.zeros((len(centre), 2 * SIDE), dtype=np.uint16)
    for k in range(2 * SIDE):
        first = centre + (k - SIDE) * BLOCK + (k >= SIDE)
        there = (first >= start) & (first + BLOCK <= stop)
        out[there, k] = hashes[first[there]]
    return out


def _copies(v: np.ndarray, doc: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether another document's row with the same blocks stands for it, and which row that is."""
    two = sketch.view(np.uint64)
    lead = _first(mix(v.view(np.uint64) + mix(two[:, 0] + mix(two[:, 1]))), doc)
    return (doc != doc[lead]) & sketch.all(axis=1), lead


def _first(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each row, the row of least doc with the same key."""
    order = np.lexsort((doc, key))
    new = np.append(True, key[order][1:] != key[order][:-1])
    lead = np.empty(len(key), dtype=np.int64)
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else order
    return lead


def set_keys(v: np.ndarray, sketch: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have all blocks of the k-th set, their keys)."""
    own = sketch[:, list(SETS[k])]
    rows = np.flatnonzero(own.all(axis=1))
    packed = np.zeros(len(rows), dtype=np.uint64)
    for column in own[rows].T:
        packed = packed << np.uint64(16) | column
    return rows, mix(v[rows].view(np.uint64) + mix(packed + np.uint64(_FOLD * (k + 1) % (1 << 64))))


def _ranges(packed: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(off, a, b) of windows and their partners, on the interval both cover and REACH + GAP tokens at least."""
    place = packed >> 20
    low = np.maximum(np.minimum(packed >> 10 & _FAR, other >> 10 & _FAR), REACH + GAP)
    high = np.maximum(np.minimum(packed & _FAR, other & _FAR), REACH + GAP)
    return (other >> 20) - place, np.maximum(place - low, 0), place + high


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows, of copies in a chunk of texts the first only, and the pairs that the others make with it."""
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(), batch.column("text").to_pylist()
        for a, b in text_chunks(texts, 4_000_000):
            seqs, docs = [], []
            for i, t in zip(ids[a:b], texts[a:b], strict=True):
                words = word_hashes(t)
                if len(words) >= WORDS:
                    seqs.append(shingle_sequence(words))
                    docs.append(i)
            if not seqs:
                continue
            lengths = np.array([len(s) for s in seqs])
            starts = np.cumsum(lengths) - lengths
            tokens, doc_of = np.concatenate(seqs), np.array(docs, dtype=np.int64)
            hashes, found = block_hashes(tokens), []
            for h, left, centre, right in compact_windows(tokens, starts, lengths):
                own = np.searchsorted(starts, centre, side="right") - 1
                v = mix(tokens[centre] + np.uint64(h * 2 + 1)) & ~np.uint64(7) | np.uint64(h)
                packed = (centre - starts[own]) << 20 | np.minimum(centre - left, _FAR) << 10 | np.minimum(right - centre, _FAR)
                found.append((v.view(np.int64), doc_of[own], packed, sketches(hashes, centre, starts[own], starts[own] + lengths[own])))
            if not found:
                continue
            v, doc, packed, sketch = (np.concatenate(x) for x in zip(*found, strict=True))
            copy, lead = _copies(v, doc, sketch)
            two = sketch.view(np.int64)
            yield _rows(v[~copy], doc[~copy], packed[~copy], two[~copy, 0], two[~copy, 1])
            if copy.any():
                off, first, last = _ranges(packed[copy], packed[lead[copy]])
                doc, src = doc[copy], doc[lead[copy]]
                spread = mix(doc.view(np.uint64) * np.uint64(3) + src.view(np.uint64)) & ~np.uint64(7) | np.uint64(_PAIR)
                yield _rows(spread.view(np.int64), doc, src, off, first << 12 | (last - first))


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_NAMES)


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[tuple[bool, pa.Table]]:
    """Rows sorted by v in tables of ``least`` rows or more that split no group of one v.

    Groups of more than LARGE rows come in several tables, marked True.
    """
    held: list[pa.RecordBatch] = []
    size, large = 0, None
    for batch in batches:
        while batch.num_rows:
            v = batch.column("v").to_numpy()
            if large is not None:
                stop = int(np.searchsorted(v, large, side="right"))
                if stop:
                    yield True, pa.Table.from_batches([batch.slice(0, stop)])
                    batch = batch.slice(stop)
                large = large if not batch.num_rows else None
                continue
            held.append(batch)
            size += len(v)
            last = v[-1]
            if size < least:
                break
            table = pa.Table.from_batches(held)
            start = int(np.searchsorted(table.column("v").to_numpy(), last))
            if start:
                yield False, table.slice(0, start)
            rest = table.slice(start)
            held, size = rest.to_batches(), rest.num_rows
            if size > LARGE:
                yield True, rest
                held, size, large = [], 0, last
            break
    if held:
        yield False, pa.Table.from_batches(held)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows of a partition to pairs; windows of large groups stay windows (b -1)."""
    for large, table in _whole_groups(batches):
        v, doc, packed, s1, s2 = (table.column(x).to_numpy() for x in _NAMES)
        done = (v & 7) == _PAIR
        if done.any():
            yield _found(doc[done], packed[done], s1[done], np.full(done.sum(), SURE), s2[done] >> 12, (s2[done] >> 12) + (s2[done] & 4095), *[np.zeros(done.sum())] * 2)
        v, doc, packed, sketch = v[~done], doc[~done], packed[~done], np.ascontiguousarray(np.stack([s1[~done], s2[~done]], axis=1)).view(np.uint16)
        if large:
            yield _found(doc, doc, packed, v, np.zeros(len(v)), np.full(len(v), -1), s1[~done], s2[~done])
            continue
        copy, lead = _copies(v, doc, sketch)
        if copy.any():
            off, first, last = _ranges(packed[copy], packed[lead[copy]])
            yield _found(doc[copy], doc[lead[copy]], off, np.full(len(off), SURE), first, last, *[np.zeros(len(off))] * 2)
        v, doc, packed, sketch = v[~copy], doc[~copy], packed[~copy], sketch[~copy]
        # groups of one document have no partner
        new = np.append(True, v[1:] != v[:-1])[: len(v)]
        group = np.cumsum(new) - 1
        mixed = np.bincount(group, doc != doc[np.flatnonzero(new)[group]])[group] > 0 if len(v) else new
        v, doc, packed, sketch = v[mixed], doc[mixed], packed[mixed], sketch[mixed]
        best, partner, weak = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64), [np.zeros(0, dtype=np.int64)]
        for k in range(len(SETS)):
            rows, keys = set_keys(v, sketch, k)
            lead = rows[_first(keys, doc[rows])]
            other = doc[rows] != doc[lead]
            rows, lead = rows[other], lead[other]
            both = ((sketch[rows] == sketch[lead]) & (sketch[rows] != 0)).sum(axis=1)
            few = both < STRONG
            weak.append(rows[few] * len(v) + lead[few])
            better = ~few & (both > best[rows])
            best[rows[better]], partner[rows[better]] = both[better], lead[better]
        strong = np.flatnonzero(best)
        if len(strong):
            off, first, last = _ranges(packed[strong], packed[partner[strong]])
            yield _found(doc[strong], doc[partner[strong]], off, np.full(len(off), SURE), first, last, *[np.zeros(len(off))] * 2)
        weak = np.unique(np.concatenate(weak))
        rows, lead = weak // max(len(v), 1), weak % max(len(v), 1)
        rows, lead = rows[best[rows] == 0], lead[best[rows] == 0]
        if len(rows):
            off, first, last = _ranges(packed[rows], packed[lead])
            yield _found(doc[rows], doc[lead], off, np.int64(1) << (v[rows] & 7), first, last, *[np.zeros(len(off))] * 2)


_OPEN = _FOUND + ", s1 long, s2 long"


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["doc", "src", "off", "h", "a", "b", "s1", "s2"][: len(columns)])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of a large group and each set of blocks that it has."""
    for batch in batches:
        doc, packed, v, s1, s2 = (batch.column(x).to_numpy() for x in ("doc", "off", "h", "s1", "s2"))
        sketch = np.ascontiguousarray(np.stack([s1, s2], axis=1)).view(np.uint16)
        for k in range(len(SETS)):
            rows, keys = set_keys(v, sketch, k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), doc[rows], packed[rows], v[rows], s1[rows], s2[rows])], names=["key", "doc", "packed", "v", "s1", "s2"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of windows of large groups and the first of their key."""
    for batch in batches:
        doc, packed, v, src, other = (batch.column(x).to_numpy() for x in ("doc", "packed", "v", "src", "other"))
        x, y = (np.ascontiguousarray(np.stack([batch.column(n + i).to_numpy() for i in "12"], axis=1)).view(np.uint16) for n in "st")
        both = ((x == y) & (x != 0)).sum(axis=1)
        off, first, last = _ranges(packed, other)
        yield _found(doc, src, off, np.where(both >= STRONG, SURE, np.int64(1) << (v & 7)), first, last)


def _large_groups(windows: DataFrame) -> DataFrame:
    """Pairs of the windows of large groups, as a task makes them, by grouped minima and a join."""
    keyed = windows.mapInArrow(_exploded, "key long, doc long, packed long, v long, s1 long, s2 long")
    first = keyed.groupBy("key").agg(F.min(F.struct("doc", "packed", "s1", "s2")).alias("f")).select("key", F.col("f.doc").alias("src"), F.col("f.packed").alias("other"), F.col("f.s1").alias("t1"), F.col("f.s2").alias("t2"))
    return keyed.join(first, "key").filter("doc <> src").drop("key").distinct().mapInArrow(_judged, _FOUND)


def _slices(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """32-bit tokens of the documents that an id filter passes."""
    for batch in batches:
        batch = batch.filter(pa.array(in_filter(bits, batch.column("slot").to_numpy())))
        texts = batch.column("text").to_pylist()
        for a, b in text_chunks(texts):
            tokens = [(shingle_sequence(word_hashes(t)) >> np.uint64(32)).astype(np.uint32).tobytes() for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(tokens, pa.binary())], names=["id", "tokens"])


def matching_runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(first, last, first in y, similarity) of runs of x that count as one passage with y.

    A run that is too unlike is split at its largest gap, so an alike part of it is still found.
    """
    at = np.flatnonzero(np.isin(x, y))
    out, todo = [], [at[part] for part in _parts(at, GAP + 1)]
    while todo:
        run = todo.pop()
        if not len(run) or run[-1] - run[0] + 1 < WIDTH:
            continue
        a, b = int(run[0]), int(run[-1])
        p = np.unique(x[a : b + 1])
        there = np.flatnonzero(np.isin(y, p))
        q = np.unique(y[there[0] : there[-1] + 1])
        both = len(np.intersect1d(p, q, assume_unique=True))
        j = both / (len(p) + len(q) - both)
        if j >= LEAST:
            out.append((a, b, int(there[0]), j))
        elif (gap := np.diff(run).max()) > 1:
            todo += [run[part] for part in _parts(run, gap - 1)]
    return sorted(out)


def _parts(at: np.ndarray, most: int) -> list[slice]:
    """Slices of ascending places between steps over ``most``."""
    ends = [0, *(np.flatnonzero(np.diff(at) > most) + 1).tolist(), len(at)]
    return [slice(i, k) for i, k in zip(ends, ends[1:])]


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            x, y = np.frombuffer(r.x, dtype=np.uint32), np.frombuffer(r.y, dtype=np.uint32)
            rows += [(r.doc, r.a + i, r.src, r.p + at, k - i + SHINGLE, j) for i, k, at, j in matching_runs(x, y)]
        yield pd.DataFrame(rows, columns=["doc_id", "first_word", "src_doc_id", "src_first_word", "n_words", "similarity"]).astype({"doc_id": "int64", "first_word": "int64", "src_doc_id": "int64", "src_first_word": "int64", "n_words": "int64", "similarity": "float64"})


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, src_doc_id, src_first_word, n_words, similarity) of later copies of passages."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    # a hash spread over partitions; rows that are pairs already are spread by pair
    rows = src.filter("text IS NOT NULL").mapInArrow(lambda it: tidied(_windows(it)), _ROW)
    made = cut(rows.repartition("v").sortWithinPartitions("v", "doc", "packed").mapInArrow(lambda it: tidied(_candidates(it)), _OPEN))
    found = made.filter("b >= 0").drop("s1", "s2").union(_large_groups(made.filter("b < 0")))
    # the source is the lesser doc_id; repeated rows of one document are no repeat
    found = found.filter("doc <> src").select(
        F.greatest("doc", "src").alias("doc"),
        F.least("doc", "src").alias("src"),
        F.when(F.col("doc") > F.col("src"), F.col("off")).otherwise(-F.col("off")).alias("off"),
        "h",
        F.when(F.col("doc") > F.col("src"), F.col("a")).otherwise(F.col("a") + F.col("off")).alias("a"),
        F.when(F.col("doc") > F.col("src"), F.col("b")).otherwise(F.col("b") + F.col("off")).alias("b"),
    )
    near = F.floor(F.col("off") / 64).alias("near")
    pairs = cut(
        found.groupBy("doc", "src", near).agg(F.bit_or("h").alias("h"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("off").alias("low"), F.max("off").alias("high"))
        .filter(F.bit_count("h") >= AGREE).drop("h").withColumn("a", F.greatest("a", -F.col("high"), F.lit(0)))
    )
    asked = pairs.select("doc", "src", "near", F.lit(0).alias("side"), F.col("doc").alias("id"), F.col("a").alias("p"), F.col("b").alias("q")).union(pairs.select("doc", "src", "near", F.lit(1), F.col("src"), F.expr("greatest(a + low - 8, 0)"), F.expr("b + high + 8")))
    bits = spark.sparkContext.broadcast(id_filter(asked, "id"))
    tokens = src.withColumn("slot", filter_slot("id")).mapInArrow(lambda it: tidied(_slices(it, bits.value)), "id long, tokens binary")
    sliced = asked.join(tokens, "id").select("doc", "src", "near", "side", "p", F.expr("substring(tokens, cast(4 * p + 1 as int), cast(4 * (q - p + 1) as int))").alias("part"))
    both = sliced.groupBy("doc", "src", "near").agg(F.max(F.when(F.col("side") == 0, F.col("p"))).alias("a"), F.max(F.when(F.col("side") == 0, F.col("part"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("part"))).alias("y"), F.max(F.when(F.col("side") == 1, F.col("p"))).alias("p"))
    return both.filter("x IS NOT NULL AND y IS NOT NULL").mapInPandas(lambda it: tidied(_verified(it)), "doc_id long, first_word long, src_doc_id long, src_first_word long, n_words long, similarity double").distinct()


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of each (first, count) span and the white space after them."""
    raw = text.encode("utf-8", "replace")
    starts = [m.start() for m in _WORD.finditer(raw)]
    starts.append(len(raw))
    drop, out, at = sorted((a, min(a + n, len(starts) - 1)) for a, n in spans), [], 0
    for a, b in drop:
        if a < len(starts) - 1 and starts[b] > at:
            out.append(raw[at : max(at, starts[a])])
            at = starts[b]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the later copies of ``passages``; documents of which nothing is left are dropped."""
    names = docs.columns
    spans = passages.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set(F.struct("first_word", "n_words"))).alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s or t is None else without_words(t, [(x["first_word"], x["n_words"]) for x in s]) for t, s in zip(batch.column(text).to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([bool(s) for s in batch.column("_spans").to_pylist()])], names=[*names, "_cut"])

    joined = docs.join(spans, F.col(doc_id) == F.col("_id"), "left").drop("_id")
    done = joined.mapInArrow(run, docs.selectExpr("*", "true as _cut").schema)
    return done.filter(~F.col("_cut") | (F.trim(F.regexp_replace(text, r"[\t-\r]", " ")) != "")).drop("_cut")
