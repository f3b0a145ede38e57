"""Near-duplicate documents: universal hash minima, banding, exact verification, star components.

1. A task turns each text into its set of five-word shingles, ``BANDS * ROWS`` minima of universal
   hashes over it, one key per band, a signature of one byte of each minimum, and a hash of the whole set.
2. Documents of equal sets become one representative (the least id) by a grouped minimum.
3. Representatives that share a band key are candidates.  First every member of a bucket is
   compared with one centre, the member that meets most others over all bands.  The links found
   join members to components.
4. Buckets that still hold more than one component are compared in blocks: every member outside the
   bucket's largest component against all members, one link per pair of components.  So a bucket loses
   no link between components, and no pair of a component is written twice.
5. Components by alternating large-star and small-star.

A block verifies signatures first: pairs whose signatures agree in fewer than LEAST_SAME places go.  At
similarity 0.75 that is over four standard deviations off, so 3 in 100,000 such pairs are lost.  The
others are confirmed on full shingle sets: 100 * intersection >= 75 * union.  Two sets at similarity
0.75 share no band with probability (1 - 0.75**6)**40, about 4 in 10,000; more alike ones far less.
Blocks hold about BLOCK members and SHINGLES shingles at most, so their memory is bounded by one text's.

Null and empty texts have an empty set and link with nothing.  One to four words are one shingle.
Rows with a null doc_id link with nothing; each has a row of its own, with a null component_id and kept
true.  Repeated rows of one doc_id count as one document, that of all their sets.  Other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtspark.llm.common import cut, filter_slot, id_filter, in_filter, list_array, mix, shingle_sequence, small_batches, text_chunks, tidied, word_hashes
from stmtspark.llm.components import connected_components

BANDS, ROWS = 40, 6
#: Members and probes that one verification block holds, and the shingles of either.
BLOCK, PROBES, SHINGLES = 512, 256, 400_000
#: Agreeing places of two signatures; chance adds one in 256 of the others.
LEAST_SAME = int(BANDS * ROWS * (0.75 - 4 * (0.75 * 0.25 / (BANDS * ROWS)) ** 0.5))
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_M = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_sequence(word_hashes(text)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of all hashes a * x + b (mod 2**64) over a set that is not empty."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 256):
        x = np.multiply.outer(_A, shingles[at : at + 256])
        x += _B[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out >> np.uint64(32)


def band_keys(minima: np.ndarray) -> np.ndarray:
    return mix((minima.reshape(BANDS, ROWS) * _M).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _fingerprint(batches: Iterator[pa.RecordBatch], doc_id: str, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(doc_id), batch.column(text).to_pylist()
        for a, b in text_chunks(texts):
            sets = [shingle_set(t) for t in texts[a:b]]
            minima = [signature(s) if len(s) else np.zeros(0, np.uint64) for s in sets]
            keys = [band_keys(m) if len(m) else m for m in minima]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)),
                    list_array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64), np.array([len(k) for k in keys])),
                    pa.array([m.astype(np.uint8).tobytes() for m in minima], pa.binary()),
                ],
                names=["id", "n_shingles", "s1", "s2", "bands", "sig"],
            )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, s1, s2, bands, sig) of each document; s1 and s2 together name its set."""
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(lambda it: tidied(_fingerprint(it, "id", "text")), "id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary")


def _sets(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.array(in_filter(bits, batch.column("slot").to_numpy())))
        texts = batch.column("text").to_pylist()
        for a, b in text_chunks(texts):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([shingle_set(t).tobytes() for t in texts[a:b]], pa.binary())], names=["id", "shingles"])


def _signatures(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(in_filter(bits, batch.column("slot").to_numpy()))).select(["id", "sig"])


def _verify(block: pd.DataFrame) -> pd.DataFrame:
    """Links between components of one block: each probe against all members, by signatures, then on full sets."""
    block = block.drop_duplicates("id")
    sets = [np.frombuffer(s, dtype=np.uint64) for s in block["shingles"]]
    sizes = np.array([len(s) for s in sets])
    signs = np.frombuffer(b"".join(block["sig"]), dtype=np.uint8).reshape(len(block), -1)
    ids, comp, probe = block["id"].to_numpy(), block["comp"].to_numpy(), block["probe"].to_numpy()
    root = {c: c for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    for p in np.flatnonzero(probe):
        like = (comp != comp[p]) & ((signs == signs[p]).sum(axis=1) >= LEAST_SAME) & (4 * np.minimum(sizes, sizes[p]) >= 3 * np.maximum(sizes, sizes[p]))
        for q in np.flatnonzero(like):
            x, y = find(comp[p]), find(comp[q])
            if x == y:
                continue
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 100 * both >= 75 * (sizes[p] + sizes[q] - both):
                root[x] = y
                found.append((ids[p], ids[q]))
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def verified_links(docs: DataFrame, reps: DataFrame, members: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (u, v) inside the blocks of ``members`` (block, id, comp, probe).

    Texts are read again, and only those that an id filter of fixed size passes are shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(members, "id"))
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).withColumn("slot", filter_slot("id"))
    sets = src.filter("id IS NOT NULL").mapInArrow(lambda it: tidied(_sets(it, bits.value)), "id long, shingles binary")
    signs = reps.select(F.col("rep").alias("id"), "sig").withColumn("slot", filter_slot("id")).mapInArrow(lambda it: tidied(_signatures(it, bits.value)), "id long, sig binary")
    return members.join(signs, "id").join(sets, "id").groupBy("block").applyInPandas(_verify, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document."""
    small_batches(docs.sparkSession)
    every = cut(fingerprints(docs, doc_id, text))
    fp = every.filter("id IS NOT NULL")
    # bands and signature follow from the set, so any row's will do
    reps = cut(fp.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    rows = cut(reps.select(F.col("rep").alias("id"), "size", F.explode("bands").alias("key")))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut(rows.join(shared, "key"))

    meets = rows.groupBy("id").agg(F.sum("n").alias("meets"))
    centre = rows.join(meets, "id").groupBy("key").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("centre"))
    stars = rows.join(centre, "key").filter("id <> centre").select("centre", "id", "size").distinct()
    # a centre's members in blocks: the centre is the probe of each
    stars = stars.withColumn("comp", F.col("id"))
    sizes = stars.groupBy("centre").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / SHINGLES)).alias("blocks"))
    part = F.pmod(F.xxhash64("id"), F.col("blocks"))
    placed = cut(stars.join(sizes, "centre").select(F.struct("centre", part.alias("part"), F.lit(0).cast("long").alias("other")).alias("block"), "id", "comp"))
    members = placed.select("block", "id", "comp", F.lit(False).alias("probe")).union(placed.select("block").distinct().select("block", F.col("block.centre").alias("id"), F.col("block.centre").alias("comp"), F.lit(True).alias("probe")))
    links = cut(verified_links(docs, reps, members, doc_id, text))
    comps = connected_components(links)

    # buckets with more than one component
    now = cut(rows.join(comps, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("comp")))
    parts = now.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = F.max_by(F.struct("comp", "n", "size"), F.struct("n", -F.col("comp"))).alias("top")
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), top, F.count("*").alias("comps")).filter("comps > 1")
    blocks_of = lambda n, most, size: F.greatest(F.ceil(n / most), F.ceil(size / SHINGLES))
    mixed = mixed.select("key", "top.comp", blocks_of(F.col("n"), BLOCK, F.col("size")).alias("nm"), blocks_of(F.col("n") - F.col("top.n"), PROBES, F.col("size") - F.col("top.size")).alias("nr")).withColumnRenamed("comp", "top")
    rest = cut(now.join(mixed, "key").withColumn("probe", F.expr("comp <> top")))
    # the same members meet in many buckets: one bucket for each set of members is enough
    names = rest.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("x"))
    rest = rest.join(names.groupBy("n", "h", "x").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    as_member = rest.withColumn("part", F.pmod(F.xxhash64("id"), "nm")).select("key", "id", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("other"), "part", F.lit(False).alias("probe"))
    as_probe = rest.filter("probe").withColumn("other", F.pmod(F.xxhash64("id", F.lit(1)), "nr")).select("key", "id", "comp", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)).alias("part"), F.lit(True).alias("probe"))
    blocks = as_member.union(as_probe).groupBy("key", "part", "other", "id", "comp").agg(F.max("probe").alias("probe"))
    more = verified_links(docs, reps, cut(blocks.select(F.struct("key", "part", "other").alias("block"), "id", "comp", "probe")), doc_id, text)
    final = connected_components(links.union(cut(more)))

    groups = reps.select("s1", "s2", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    full = fp.filter("n_shingles > 0").join(groups, ["s1", "s2"]).select("id", "n_shingles", "component_id")
    empty = fp.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = full.union(empty).groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    nameless = every.filter("id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.union(nameless).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
