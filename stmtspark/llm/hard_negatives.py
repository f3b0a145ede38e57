"""Hard-negative mining with segment summaries.

Every vector is cut into segments, and each segment's mean and deviation are stored, for segment counts that
double level by level.  For two vectors, a segment of length l adds l * (mean * mean) to their product, give or
take at most l * (deviation * deviation); the sum over the segments bounds the score from both sides.  A task
refines the bounds level by level, drops the pairs that can't come in, and scores the rest exactly.

The query set (anchors) meets all rows in blocks: rows and anchors are dealt to groups of ROWS and ANCHORS by a
hash of their id, and a task holds one group of each.  It keeps the best few rows of each anchor and, with the
final choice, a window over anchors takes the best of those; nothing else leaves a block.  The first round finds
each anchor's positives, the second the negatives in the range that each positive's score allows.

A row takes no part when its id, label or vector is null, or a component is null or not finite.  Rows that repeat an
id count once, with the least (label, vector) of theirs.  Vectors of different lengths have no score with each
other.  Scores are whole numbers, exact as long as they fit a long, and the nearest long beyond.  Ties go to the
smaller id.  Extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtspark.llm.common import cut

ROWS, ANCHORS, LEVELS, SCALE = 8192, 512, (1, 4, 16), 256
_LONG = 2**63 - 1


def summaries(x: np.ndarray, levels: tuple[int, ...] = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, (means, deviations) of its segments, each times the root of the segment's length."""
    out = []
    for count in levels:
        edges = np.unique(np.linspace(0, x.shape[1], min(count, x.shape[1]) + 1).astype(int))
        length = np.diff(edges)
        mean = np.add.reduceat(x, edges[:-1], axis=1) / length
        off = x - np.repeat(mean, length, axis=1)
        out.append((mean * np.sqrt(length), np.sqrt(np.add.reduceat(off * off, edges[:-1], axis=1))))
    return out


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each a with each b that a level's summaries allow, with room for rounding."""
    middle, room = a[0] @ b[0].T, a[1] @ b[1].T
    room = room * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1
    return middle - room, middle + room


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows, as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in a], dtype=object) @ np.array([[int(v) for v in row] for row in b], dtype=object).T
    return np.clip(whole, -_LONG - 1, _LONG).astype(np.int64)


class _Side:
    """One side of a block, in order of id: vectors, labels and stored summaries by level."""

    def __init__(self, block: pd.DataFrame):
        self.block = block.sort_values("id", ignore_index=True)
        self.id, self.label = self.block["id"].to_numpy(), self.block["label"].to_numpy()
        self.x = np.stack([np.frombuffer(v) for v in self.block["vec"]])
        stored = [np.stack([np.frombuffer(v).reshape(2, -1) for v in self.block[f"level{k}"]]) for k in range(len(LEVELS))]
        self.levels = [(s[:, 0], s[:, 1]) for s in stored]

    def some(self, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(m[at], d[at]) for m, d in self.levels]


def _best(keep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest kept scores of each row; of equal ones the leftmost."""
    rows, cols = np.nonzero(keep)
    order = np.lexsort((cols, -score[rows, cols].astype(object) if (score == -_LONG - 1).any() else -score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], cols[nth < k]


def _refined(anchors: _Side, rows: _Side, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, scores): of the wanted pairs those whose score lies in one of the ranges of its anchor (low and high have
    one column each).  A level looks only at rows that some anchor still wants."""
    keep = wanted.copy()
    for a, level in zip(anchors.levels, range(len(LEVELS)), strict=True):
        at = np.flatnonzero(keep.any(axis=0))
        if not len(at):
            break
        least, most = bounds(a, rows.some(at)[level])
        may = np.zeros(least.shape, dtype=bool)
        for k in range(low.shape[1]):
            may |= (most >= low[:, k, None]) & (least <= high[:, k, None])
        keep[:, at] &= may
    at = np.flatnonzero(keep.any(axis=0))
    score = np.zeros(keep.shape, dtype=np.int64)
    if len(at):
        score[:, at] = scores(anchors.x, rows.x[at])
    return keep, score


def _positives(anchors: _Side, rows: _Side, k: int) -> pd.DataFrame:
    """The k best rows of the label of each anchor in one block: the first rows set a floor for the others' bounds."""
    wanted = (anchors.label[:, None] == rows.label[None, :]) & (anchors.id[:, None] != rows.id[None, :])
    least, _ = bounds(anchors.levels[-1], rows.levels[-1])
    floor = np.full((len(anchors.id), 1), -np.inf)
    if least.shape[1] > k:  # k rows reach at least the k-th greatest of the least scores
        floor = np.partition(np.where(wanted, least, -np.inf), -k, axis=1)[:, [-k]]
    keep, score = _refined(anchors, rows, wanted, floor, np.full(floor.shape, np.inf))
    r, c = _best(keep, score, k)
    return pd.DataFrame({"anchor_id": anchors.id[r], "positive_id": rows.id[c], "positive_score": score[r, c]})


def _negatives(anchors: _Side, rows: _Side, k: int) -> pd.DataFrame:
    """For each positive of each anchor, the k best rows of other labels in its range, in one block."""
    wanted = anchors.label[:, None] != rows.label[None, :]
    given = [np.array(v, dtype=np.int64) for v in anchors.block["scores"]]
    width = max(map(len, given))
    # 30 p <= 100 n <= 90 p; ranges that hold nothing stand for positives that an anchor has not
    low, high = np.full((len(given), width), 1.0), np.full((len(given), width), 0.0)
    for i, p in enumerate(given):
        low[i, : len(p)], high[i, : len(p)] = 0.3 * p - 1, 0.9 * p + 1
    keep, score = _refined(anchors, rows, wanted, low, high)
    parts = []
    for j in range(width):
        own = np.array([p[j] if j < len(p) else -1 for p in given], dtype=np.int64)
        # whole-number bounds: n >= 3 p / 10 rounded up, n <= 9 p / 10 rounded down, without overflow
        tens, ones = own // 10, own % 10
        first, last = 3 * tens - (-3 * ones // 10), 9 * tens + 9 * ones // 10
        r, c = _best(keep & (score >= first[:, None]) & (score <= last[:, None]), score, k)
        ids = anchors.block["positives"].to_numpy()
        parts.append(pd.DataFrame({"anchor_id": anchors.id[r], "positive_id": np.array([ids[i][j] for i in r], dtype=np.int64), "positive_score": own[r], "negative_id": rows.id[c], "negative_score": score[r, c]}))
    return pd.concat(parts)


def _blocks(anchors: DataFrame, rows: DataFrame, a_groups: int, r_groups: int, best, schema: str) -> DataFrame:
    """``best`` of every group of anchors with every group of rows of the same dimension."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], own(a_groups).alias("ag"), every(r_groups).alias("rg"))
    right = rows.select("*", every(a_groups).alias("ag"), own(r_groups).alias("rg"))
    keys = ["dim", "ag", "rg"]
    empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in schema.split(", ")})

    def run(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return empty if a.empty or r.empty else best(_Side(a), _Side(r))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def prepared(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, dim, vec, level0, ...) of the rows that take part; vec is floor(scale * x) in doubles, packed."""
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"), whole.alias("v"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND size(x) > 0").filter(fine)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    names = ["id", "label", "dim", "vec", *(f"level{k}" for k in range(len(LEVELS)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("v").to_pylist()
            for dim in sorted(set(map(len, vectors))):
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                x = np.array([vectors[i] for i in at], dtype=np.float64)
                levels = [[np.stack([m, d]).tobytes() for m, d in zip(*level, strict=True)] for level in summaries(x)]
                columns = [b.column(c).take(pa.array(at)) for c in ("id", "label")] + [pa.array([dim] * len(at), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), *(pa.array(v, pa.binary()) for v in levels)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "id long, label long, dim int, vec binary, " + ", ".join(f"level{k} binary" for k in range(len(LEVELS))))


def mine(df: DataFrame, is_anchor, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for whose id ``is_anchor`` (a function of a column) holds.  Each anchor's positives are its first
    rows of the same label by score; a positive's negatives the first rows of other labels whose score is 0.3 to 0.9
    of the positive's.
    """
    rows = cut(prepared(df, vec_id, vector, label, scale))
    anchors = rows.filter(is_anchor(F.col("id")))
    a_groups, r_groups = (max(1, -(-d.count() // size)) for d, size in ((anchors, ANCHORS), (rows, ROWS)))
    near = _blocks(anchors, rows, a_groups, r_groups, lambda a, r: _positives(a, r, positives), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= positives)
    own = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))
    own = own.select(F.col("anchor_id").alias("id"), F.transform("p", lambda p: p["positive_id"]).alias("positives"), F.transform("p", lambda p: p["positive_score"]).alias("scores"))
    found = _blocks(anchors.join(own, "id"), rows, a_groups, r_groups, lambda a, r: _negatives(a, r, negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    hard = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(hard)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for the query's rows over the embeddings table.
ORACLE = """WITH f AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM f a JOIN f b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
