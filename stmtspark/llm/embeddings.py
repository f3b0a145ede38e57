"""Embedding near-duplicates by sorted projection passes.

1. Vectors that are null, zero or hold null or non-finite components link with nothing.  Equal
   vectors become one representative with a weight by a grouped minimum.
2. Each pass hashes a vector to the signs of BITS random projections, one integer whose order is the
   lexicographic order of the concatenated hashes.  All passes are sorted in one range exchange, of keys
   without vectors; a row's place in its pass comes from the counts of the sorted partitions.
3. Rows are dealt to blocks of consecutive places, each with the WINDOW rows before it; there they meet
   their vectors, and a task compares every row with its WINDOW predecessors in double precision.  A
   block gives only links that join what it found to components.
4. Verified links of all passes are joined to components by large-star and small-star.
5. n_links is exact inside a component: its members are compared in blocks of members, which write
   one count per member and no pairs.

A pair at cosine 0.95 agrees in one sign with probability 0.899, and meets in a pass over n rows if it
agrees in about log2(n / WINDOW) signs.  ``passes_for`` takes as many passes as leave 1 of 1,000 such
pairs unmet among random vectors: 16 at 50,000 rows, 27 at a million, 85 at a billion.  Vectors that lean one
way crowd the windows, so keys are made of what differs from the mean vector, and what the passes have found is
measured: PROBES rows, spread by a hash, are compared with all rows exactly, and rounds of further passes
follow until FOUND of their links are inside components, or for MOST_ROUNDS.  Recall against brute force is
tested; README has figures.  Groups are found through any chain of their pairs.

A null vec_id links with nothing: each such row has a row of its own, with 0 links, a null component_id
and kept true.  Repeated rows of one vec_id count as one vector, the least of theirs; null ones are passed
over.  Vectors of different length link with nothing of another length.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtspark.llm.common import cut
from stmtspark.llm.components import connected_components

LEAST_PASSES, BITS, WINDOW, PLACES, MEMBERS, UNMET = 16, 48, 64, 4096, 1024, 0.001
#: Rows that are compared with all others, links of one that a task notes, share of them to be found, and rounds of passes at most.
PROBES, NOTED, FOUND, MOST_ROUNDS = 2048, 64, 0.99, 16


def passes_for(rows: int, least: float = 0.95) -> int:
    """Passes that leave a share UNMET of the pairs at cosine ``least`` in no common window."""
    agree = 1 - math.acos(min(1.0, max(-1.0, least))) / math.pi
    meet = min(agree ** math.log2(max(2.0, rows / WINDOW)), 1 - 1e-9)
    return max(LEAST_PASSES, math.ceil(math.log(UNMET) / math.log(1 - meet)))


def planes(dim: int, number: int) -> np.ndarray:
    """The projections of one pass."""
    return np.random.default_rng([977, dim, number]).standard_normal((dim, BITS))


def _by_dim(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(dimension, unit vectors, reps) of each batch."""
    for batch in batches:
        vectors = [np.frombuffer(v, dtype=kind) for v in batch.column("vec").to_pylist()]
        for dim in sorted({len(v) for v in vectors}):
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            x = np.stack([vectors[i] for i in at]).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            yield dim, x / np.linalg.norm(x, axis=1, keepdims=True), batch.column("rep").take(pa.array(at))


def _means(reps: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """The mean unit vector of each dimension: one sum a task and place, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dim, x, _ in _by_dim(batches, kind):
            sums[dim] = sums.get(dim, 0) + np.append(x.sum(axis=0), len(x))
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), dim, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], names=["dim", "place", "sum"])

    rows = reps.select("rep", "vec").mapInArrow(run, "dim int, place int, sum double").groupBy("dim", "place").agg(F.sum("sum").alias("sum")).orderBy("dim", "place").collect()
    sums: dict[int, list[float]] = {}
    for r in rows:
        sums.setdefault(r["dim"], []).append(r["sum"])
    return {dim: np.array(s[:-1]) / s[-1] for dim, s in sums.items()}


def _noted(reps: DataFrame, n: int, least: float, kind: type) -> DataFrame:
    """(probe, rep): links of some rows, found by comparing these with all; a sample, to measure by."""
    probes = reps.filter(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(max(1, n // PROBES))) == 0).select("rep", "vec").limit(2 * PROBES).toArrow()
    held = {dim: (x, own.to_numpy()) for dim, x, own in _by_dim(probes.combine_chunks().to_batches(), kind)} if len(probes) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for dim, x, own in _by_dim(batches, kind):
            if dim not in held:
                continue
            p, ids = held[dim]
            own = own.to_numpy()
            for at in range(0, len(x), 1024):
                i, j = np.nonzero(x[at : at + 1024] @ p.T >= least)
                u, v = ids[j], own[at : at + 1024][i]
                fresh = [k for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)) if a != b and (seen.__setitem__(a, seen.get(a, 0) + 1) or seen[a] <= NOTED)]
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(u[fresh]), pa.array(v[fresh])], names=["probe", "rep"])

    return reps.select("rep", "vec").mapInArrow(run, "probe long, rep long")


def _share_found(noted: DataFrame, comps: DataFrame) -> float:
    """Share of the noted links whose ends are in one component."""
    of = lambda name, to: comps.select(F.col("id").alias(name), F.col("component").alias(to))
    r = noted.join(of("probe", "_p"), "probe", "left").join(of("rep", "_r"), "rep", "left").agg(F.count("*").alias("n"), F.count_if(F.col("_p") == F.col("_r")).alias("k")).first()
    return r["k"] / r["n"] if r["n"] else 1.0


def _keys(batches: Iterator[pa.RecordBatch], begin: int, passes: int, means: dict[int, np.ndarray], kind: type) -> Iterator[pa.RecordBatch]:
    weights = (np.uint64(1) << np.arange(BITS, dtype=np.uint64)[::-1]).astype(np.uint64)
    made: dict[tuple[int, int], np.ndarray] = {}
    for dim, x, reps in _by_dim(batches, kind):
        x = x - means[dim]
        for p in range(begin, begin + passes):
            if (dim, p) not in made:
                made[dim, p] = planes(dim, p)
            keys = ((x @ made[dim, p] > 0) * weights).sum(axis=1, dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(keys), reps], names=["pass", "dim", "key", "rep"])


def _unit(parts: pd.Series, kind: type) -> np.ndarray:
    """Unit vectors padded with zeros to one width; vectors of other widths are told apart by ``dim``."""
    width = max(map(len, parts))
    x = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in parts), dtype=kind).reshape(len(parts), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of unit vectors; what decides at the threshold, for links and counts alike."""
    return np.einsum("ij,ij->i", np.ascontiguousarray(x), np.ascontiguousarray(y))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1, the least node that each can reach by links u, v."""
    lab = np.arange(n)
    while len(u):
        least = np.minimum(lab[u], lab[v])
        before = lab.copy()
        np.minimum.at(lab, lab[u], least)
        np.minimum.at(lab, lab[v], least)
        np.minimum.at(lab, u, least)
        np.minimum.at(lab, v, least)
        lab = lab[lab]
        if (lab == before).all():
            break
    return lab


def _compare(block: pd.DataFrame, least: float, kind: type) -> pd.DataFrame:
    block = block.sort_values("place")
    x, place, dim = _unit(block["vec"], kind), block["place"].to_numpy(), block["dim"].to_numpy()
    reps, node = np.unique(block["rep"].to_numpy(), return_inverse=True)
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(WINDOW, len(block) - 1) + 1):
        near = (place[step:] - place[:-step] <= WINDOW) & (dim[step:] == dim[:-step])
        near &= _cosines(x[step:], x[:-step]) >= least
        u.append(node[step:][near])
        v.append(node[:-step][near])
    root = forest(np.concatenate(u), np.concatenate(v), len(reps))
    linked = np.flatnonzero(root != np.arange(len(reps)))
    return pd.DataFrame({"u": reps[linked], "v": reps[root[linked]]})


def _count(block: pd.DataFrame, least: float, kind: type) -> pd.DataFrame:
    """Links of each row of the left side to the right side of one block pair."""
    is_left = (block["side"] == 0).to_numpy()
    left, right = block[is_left], block[~is_left]
    if left.empty or right.empty:
        return pd.DataFrame({"rep": [], "n": []}).astype("int64")
    x = _unit(block["vec"], kind)
    a, b = x[is_left], x[~is_left]
    cosine = a @ b.T
    near = cosine >= least
    i, j = np.nonzero(np.abs(cosine - least) < 1e-9)
    near[i, j] = _cosines(a[i], b[j]) >= least
    near &= (left["dim"].to_numpy()[:, None] == right["dim"].to_numpy()[None, :]) & (left["rep"].to_numpy()[:, None] != right["rep"].to_numpy()[None, :])
    return pd.DataFrame({"rep": left["rep"].to_numpy(), "n": near @ right["weight"].to_numpy()})


def _pass_links(reps: DataFrame, begin: int, passes: int, means: dict[int, np.ndarray], least: float, kind: type) -> DataFrame:
    """(u, v): links that join what some passes have found to components."""
    spark = reps.sparkSession
    keyed = reps.select("rep", "vec").mapInArrow(lambda it: _keys(it, begin, passes, means, kind), "pass int, dim int, key long, rep long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "dim", "key", "rep"]
    ordered = cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    # one count for each sorted partition, a few numbers; places run on over the partitions
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append((p, total))
        total += counts.get(p, 0)
    offsets = spark.createDataFrame(before, "part int, before long")
    placed = ordered.join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + F.col("nth"))
    block = F.floor(F.col("place") / PLACES)
    again = F.when((F.col("place") % PLACES) >= PLACES - WINDOW, F.array(block, block + 1)).otherwise(F.array(block))
    blocks = placed.select("place", "rep", "dim", F.explode(again).alias("block")).join(reps.select("rep", "vec"), "rep")
    return blocks.groupBy("block").applyInPandas(lambda b: _compare(b, least, kind), "u long, v long").distinct()


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector at cosine ``least`` or more."""
    spark = df.sparkSession
    element = df.schema[vector].dataType.elementType.simpleString()
    kind, name = (np.float32, "float") if element in ("float", "tinyint", "smallint") else (np.float64, "double")
    every = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{name}>").alias("v"))
    src = every.filter("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = cut(src.withColumn("fine", F.coalesce(fine, F.lit(False))))
    good = src.filter("fine").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("weight"), pa.array([np.array(v, dtype=kind).tobytes() for v in b.column("v").to_pylist()], pa.binary())], names=["rep", "weight", "vec"])

    reps = cut(good.mapInArrow(packed, "rep long, weight long, vec binary"))
    n = reps.count()
    passes, means = passes_for(n, least), _means(reps, kind)
    noted = cut(_noted(reps, n, least, kind))
    links = None
    for k in range(MOST_ROUNDS):
        more = cut(_pass_links(reps, k * passes, passes, means, least, kind))
        links = more if links is None else cut(links.union(more).distinct())
        comps = cut(connected_components(links))
        if _share_found(noted, comps) >= FOUND:
            break

    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    member = comps.withColumnRenamed("id", "rep").join(sizes, "component").join(reps, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("dim", F.length("vec"))
    all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = member.select("component", F.col("own").alias("a"), all_blocks.alias("b"), F.lit(0).alias("side"), "rep", "weight", "dim", "vec").union(member.select("component", all_blocks.alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"), "rep", "weight", "dim", "vec"))
    linked = pairs.groupBy("component", "a", "b").applyInPandas(lambda b: _count(b, least, kind), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))

    per_rep = reps.select("rep", "weight").join(linked, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("rep", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    whole = good.select("v", "rep").join(per_rep, "rep").select("v", "n_links", "component_id")
    out = src.filter("fine").join(whole, "v").select("id", "n_links", "component_id").union(src.filter("NOT fine").select("id", F.lit(0).cast("long"), F.col("id")))
    out = out.union(every.filter("id IS NULL").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
