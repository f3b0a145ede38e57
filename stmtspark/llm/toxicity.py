"""Toxicity: a counterfactual-regularised linear classifier over hashed word features.

Features of a text are its distinct words, lower-cased and without outer punctuation, and their
prefixes of PREFIXES letters.  The loss is the mean logistic loss over labelled texts, an L1 term,
and a counterfactual term: each labelled text that names an identity group is copied with every
identity term swapped for the next one of its family, and the squared change of the score between
the two is penalised.  So a neutral mention of a group moves no score, whatever the labels suggest.

Labels are learnt from at most ``max_rows`` labelled documents (the least hashes of doc_id); that bound
is the same for every input.  Features whose gradient without any weight is under half of the L1 term are
sifted out by a grouped sum; that is an approximation, since such a feature could gain a weight later.  The
rest of those rows is fitted in one task, whose memory the bound limits.  Every text is scored, whole.

Nulls and empty texts have no features and get the score of the intercept.  Labels that are null or
belong to no document are left out; of several labels of one document the highest counts, and of several
texts of one doc_id the least.  Documents with a null doc_id are scored and not learnt from.  With no
labelled row, or with labels of one kind only, nothing is learnt: scores are next to 0, or next to 1
where all labels are 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stmtspark.llm.common import cut, list_array, small_batches, text_chunks, tidied

DIMS = 1 << 21
PREFIXES = (3, 4, 5, 6)
MAX_ROWS = 12_000
LEAST_DF = 4
L1, COUNTERFACTUAL, STEPS = 1e-3, 1.0, 120
_KEPT = 100_000
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’¡¿…–—|"

#: Families of identity terms; a counterfactual text has each replaced by the next of its family.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("africans", "europeans", "americans", "asians"), ("immigrants", "natives"), ("immigrant", "native"), ("disabled", "able-bodied"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "inländer"), ("schwule", "heteros"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("immigrés", "citoyens"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("inmigrantes", "ciudadanos"),
)


def swaps(families: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    return {a: f[(i + 1) % len(f)] for f in families for i, a in enumerate(f)}


def words(text: str | None) -> set[str]:
    """Distinct words of a text."""
    return {w for x in set((text or "").lower().split()) if (w := x.strip(_PUNCTUATION))}


def features(word: str) -> list[int]:
    out = [xxhash.xxh32_intdigest(word) & (DIMS - 1)]
    out += [xxhash.xxh32_intdigest(f"{word[:k]}*{k}") & (DIMS - 1) for k in PREFIXES if len(word) > k]
    return out


def doc_features(own: set[str]) -> np.ndarray:
    """Feature indices with one entry for each distinct word that has the feature."""
    return np.array([i for w in sorted(own) for i in features(w)], dtype=np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], l1: float = L1, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[dict[int, float], float]:
    """Weights and intercept by accelerated proximal gradient.

    ``changes`` has, for each text with an identity term, the features its counterfactual gains and loses.
    """
    if not len(labels) or labels.min() == labels.max():
        return {}, -1e9 if not len(labels) or labels.max() == 0 else 1e9
    n = len(rows)
    count = np.zeros(DIMS, dtype=np.int32)
    for r in rows:
        count[np.unique(r)] += 1
    for gained, lost in changes:
        count[gained] += LEAST_DF
        count[lost] += LEAST_DF
    share = labels.mean()
    low, high = class_weight(share)
    weight = np.where(labels == 1, high, low)
    # features whose gradient without any weight is far below the L1 term stay at zero
    slope = np.zeros(DIMS)
    for r, e in zip(rows, weight * ((weight * labels).sum() / weight.sum() - labels) / n, strict=True):
        np.add.at(slope, r, e)
    strong = np.abs(slope) >= l1 / 2
    for gained, lost in changes:
        strong[gained] = strong[lost] = True
    used = np.flatnonzero((count >= LEAST_DF) & strong)
    to = np.full(DIMS, -1, dtype=np.int32)
    to[used] = np.arange(len(used))
    flat, own = [], []
    for i, r in enumerate(rows):
        k = to[r]
        k = k[k >= 0]
        flat.append(k)
        own.append(np.full(len(k), i, dtype=np.int32))
    flat, own = np.concatenate(flat), np.concatenate(own)
    dflat = np.concatenate([np.zeros(0, np.int32), *[to[x] for g, s in changes for x in (g, s)]])
    dsign = np.concatenate([np.zeros(0), *[np.full(len(x), z) for g, s in changes for x, z in ((g, 1.0), (s, -1.0))]])
    down = np.concatenate([np.zeros(0, np.int64), *[np.full(len(g) + len(s), i) for i, (g, s) in enumerate(changes)]]).astype(np.int64)
    w, b = np.zeros(len(used)), np.log(share / (1 - share))
    y, yb, t, step = w.copy(), b, 1.0, 1.0

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        z = np.bincount(own, weights=w[flat], minlength=n) + b
        d = np.bincount(down, weights=w[dflat] * dsign, minlength=len(changes)) if len(changes) else np.zeros(0)
        value = (weight * (np.logaddexp(0, z) - labels * z)).mean() + counterfactual * (d**2).sum() / n
        return value, z, d

    for _ in range(steps):
        value, z, d = loss(y, yb)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / n
        g = np.bincount(flat, weights=e[own], minlength=len(used))
        if len(changes):
            g += np.bincount(dflat, weights=2 * counterfactual * d[down] * dsign / n, minlength=len(used))
        gb = e.sum()
        while True:
            new = y - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            newb = yb - step * gb
            got = loss(new, newb)[0]
            move = new - y
            if got <= value + g @ move + gb * (newb - yb) + (move @ move + (newb - yb) ** 2) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, yb = new + (t - 1) / t2 * (new - w), newb + (t - 1) / t2 * (newb - b)
        w, b, t, step = new, newb, t2, step * 1.2
    b -= best_cut(np.bincount(own, weights=w[flat], minlength=n) + b, labels)
    keep = np.flatnonzero(w)
    return dict(zip(used[keep].tolist(), w[keep].tolist(), strict=True)), float(b)


def best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The score with fewest labelled rows on the wrong side, in the middle of the widest such gap.

    The L1 term draws scores to the intercept; moving it there makes 0.5 the line between the labels.
    """
    order = np.argsort(z, kind="stable")
    z, y = z[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    gaps = np.where(wrong[1:-1] == wrong[1:-1].min(), np.diff(z), -1.0)
    at = int(np.argmax(gaps))
    return float((z[at] + z[at + 1]) / 2)


class Scorer:
    """Scores of texts; a worker remembers the weight of a bounded number of words."""

    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.known: dict[str, tuple[str, float]] = {}
        self.old: dict[str, tuple[str, float]] = {}

    def word(self, raw: str) -> tuple[str, float]:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > _KEPT:  # two generations, so that common words stay
                self.old, self.known = self.known, {}
            found = self.old.get(raw)
            if found is None:
                w = raw.strip(_PUNCTUATION)
                get = self.weights.get
                found = (w, sum(get(i, 0.0) for i in features(w)) if w else 0.0)
            self.known[raw] = found
        return found

    def score(self, text: str | None) -> float:
        heavy = {}
        for raw in set((text or "").lower().split()):
            w, s = self.word(raw)
            if s:
                heavy[w] = s
        z = self.intercept + sum(heavy[k] for k in sorted(heavy))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def labelled_rows(docs: DataFrame, labels: DataFrame, families: tuple[tuple[str, ...], ...] = IDENTITY, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, toxic, f, gained, lost): features and counterfactual changes of at most ``max_rows`` labelled documents."""
    swap = swaps(families)
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_chunks(texts):
                out: tuple[list, list, list] = ([], [], [])
                for t in texts[a:b]:
                    own = words(t)
                    named = own & swap.keys()
                    other = (own - named) | {swap[w] for w in named}
                    for part, x in zip(out, (own, other - own, own - other), strict=True):
                        part.append(doc_features(x))
                kept = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("toxic"), *[pa.array(x, pa.list_(pa.int32())) for x in out]], names=["doc_id", "toxic", "f", "gained", "lost"])

    # at most max_rows ids, so the broadcast has a fixed bound; one text of each
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    found = cut(one.mapInArrow(lambda it: tidied(run(it)), "doc_id long, toxic int, f array<int>, gained array<int>, lost array<int>"))
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    wanted = np.zeros(DIMS, dtype=bool)
    wanted[telling_features(found, total["n"], total["pos"])] = True
    kept = found.sparkSession.sparkContext.broadcast(wanted)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = batch.column("f").flatten().to_numpy(), batch.column("f").value_lengths().to_numpy()
            keep = kept.value[flat]
            left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), list_array(flat[keep], left), batch.column("gained"), batch.column("lost")], names=batch.schema.names)

    return found.mapInArrow(lambda it: tidied(only(it)), found.schema)


def as_arrays(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """What ``fit`` takes, of labelled rows in doc_id order."""
    rows = rows.sort_by("doc_id")
    lists = lambda name: [np.asarray(x.values, dtype=np.int32) for x in rows[name]]
    return lists("f"), rows["toxic"].to_numpy().astype(np.float64), [(g, s) for g, s in zip(lists("gained"), lists("lost"), strict=True) if len(g) or len(s)]


def class_weight(share: float) -> tuple[float, float]:
    """Weights of labels 0 and 1, half way to balanced classes, with a mean of 1."""
    low, high = (0.5 / (1 - share)) ** 0.5, (0.5 / share) ** 0.5
    mean = share * high + (1 - share) * low
    return low / mean, high / mean


def telling_features(found: DataFrame, n: int, positives: int, l1: float = L1) -> np.ndarray:
    """Features in LEAST_DF texts or more whose gradient without any weight is not far below the L1 term.

    Sums by feature are made in the tasks and by a grouped sum; only the features that pass come back.
    """
    if not n or positives in (0, n):
        return np.zeros(0, dtype=np.int32)
    low, high = class_weight(positives / n)
    base = high * positives / n

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, toxic = batch.column("f"), batch.column("toxic").to_numpy()
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            error = np.repeat(np.where(toxic == 1, high * (base - 1), low * base) / n, sizes)
            keys, at = np.unique(flat, return_inverse=True)
            texts = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * DIMS + flat) % DIMS
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, weights=error)), pa.array(np.bincount(np.searchsorted(keys, texts), minlength=len(keys)))], names=["k", "slope", "df"])

    out = found.mapInArrow(sums, "k int, slope double, df long").groupBy("k").agg(F.sum("slope").alias("slope"), F.sum("df").alias("df"))
    return np.sort(out.filter((F.abs("slope") >= l1 / 2) & (F.col("df") >= LEAST_DF)).select("k").toArrow()["k"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, families: tuple[tuple[str, ...], ...] = IDENTITY, max_rows: int = MAX_ROWS) -> Scorer:
    """A scorer fitted in one task; only its weights that are not 0 come to the driver, the intercept at -1."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        weights, intercept = fit(*as_arrays(pa.Table.from_batches(rows))) if rows else fit([], np.zeros(0), [])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *weights], pa.int32()), pa.array([intercept, *weights.values()], pa.float64())], names=["k", "w"])

    found = labelled_rows(docs, labels, families, max_rows).repartition(1).mapInArrow(lambda it: tidied(run(it)), "k int, w double").toArrow()
    weights = dict(zip(found["k"].to_pylist(), found["w"].to_pylist(), strict=True))
    intercept = weights.pop(-1, -1e9)
    return Scorer(weights, intercept)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1) of each whole text in column ``into``; an existing one is replaced."""
    docs = docs.drop(into)
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in text_chunks(texts):
                kept = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([model.value.score(t) for t in texts[a:b]], pa.float64())], names=[*kept.schema.names, into])

    return docs.mapInArrow(lambda it: tidied(run(it)), StructType([*docs.schema.fields, StructField(into, DoubleType())]))
