"""Fingerprints, alignment and hard negatives against brute force and edge cases; long pieces; tables of threads."""

import base64
import hashlib
import itertools
import math
import random
import threading
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from stmtspark.llm import alignment, bpe, components, fingerprints, hard_negatives

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "mine", "mine", 7, "mine") for i, t in rows], "doc_id long, text string, fingerprint string, range string, n_chars int, tail string")


# --- 1: long pieces ---------------------------------------------------------------------------


def test_long_pieces_match_tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.PieceCoder.of(RANKS, P.PATTERN), random.Random(8)
    texts = ["".join(rng.choices(a, k=n)) for a in ("a", "-", "ab", "aeinrst", "日本語éß", "abcdefghijklmnopqrstuvwxyz") for n in (65, 96, 97, 200, 999, 5000)]
    texts += ["x" * 1_000_000, "aab" * 50_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))]
    for t, got in zip(texts, coder.ids(texts), strict=True):
        assert np.frombuffer(got, np.int32).tolist() == own.encode_ordinary(t)


# --- 11: fingerprints -------------------------------------------------------------------------


def test_prefixes_answer_spans_and_extensions():
    rng = random.Random(1)
    x, y = ("".join(rng.choices("ab", k=300)) for _ in range(2))
    p, q = fingerprints.Prefixes(fingerprints.codes_of(x)), fingerprints.Prefixes(fingerprints.codes_of(y))
    for _ in range(500):
        i, j = rng.randrange(300), rng.randrange(300)
        n = rng.randint(0, min(300 - i, 300 - j))
        assert p.equal(i, q, j, n) == (x[i : i + n] == y[j : j + n])
        want = next((k for k in range(min(300 - i, 300 - j)) if x[i + k] != y[j + k]), min(300 - i, 300 - j))
        assert p.extension(i, q, j) == want


def test_blocks_do_not_matter(monkeypatch):
    text = "".join(random.Random(2).choices("abcdefgh ijkl日", k=5000))
    whole = fingerprints.Fingerprint.of(fingerprints.codes_of(text))
    cut = fingerprints.codes_of(text[:3210] + "?" + text[3211:])
    monkeypatch.setattr(fingerprints, "BLOCK", 256)
    parts = fingerprints.Fingerprint.of(fingerprints.codes_of(text))
    assert (parts.n, parts.whole) == (whole.n, whole.whole) and fingerprints.common_extension(fingerprints.codes_of(text), cut) == 3210
    assert parts.likeness(fingerprints.Fingerprint.of(fingerprints.codes_of(text))) == 1.0


def test_likeness_is_the_share_of_spans():
    rng = random.Random(3)
    for n in (20, 60, 4000):
        a = "".join(rng.choices("abcdefghijklmnop", k=n))
        b = a[: n - n // 4] + "".join(rng.choices("abcdefghijklmnop", k=n // 4))
        spans = [Counter(t[i : i + fingerprints.WINDOW] for i in range(len(t) - fingerprints.WINDOW + 1)) for t in (a, b)]
        exact = 2 * sum((spans[0] & spans[1]).values()) / sum(map(lambda s: sum(s.values()), spans))
        got = fingerprints.likeness(*(str(fingerprints.Fingerprint.of(fingerprints.codes_of(t))) for t in (a, b)))
        assert abs(got - exact) < (1e-9 if n <= 60 else 0.15)
    empty, one = (str(fingerprints.Fingerprint.of(fingerprints.codes_of(t))) for t in ("", "x"))
    assert fingerprints.likeness(empty, empty) == 1 and fingerprints.likeness(empty, one) == 0 and fingerprints.likeness(one, one) == 1


def test_edited_documents(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "日本", "é"], k=n))
    rows = [(rng.randrange(10**6) if k % 3 else k, prose(rng.randint(0, 60))) for k in range(120)]
    rows += [(-5, None), (3, "twice b"), (3, "twice a"), (10**7, "x"), (10**7 + 1, prose(40_000)), (None, "no id at all"), (None, None)]
    got = fingerprints.edited_fingerprints(docs(spark, rows)).collect()
    placed = sorted(((i, t or "") for i, t in rows if i is not None))
    want = Counter()
    for k, (i, t) in enumerate(placed):
        after, q = placed[(k + 1) % len(placed)][1], len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()] += 1
    want += Counter((None, len(t or ""), hashlib.sha256((t or "")[: len(t or "") - len(t or "") // 4].encode()).hexdigest()) for i, t in rows if i is None)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            by_text[dict(placed).get(r["doc_id"])].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["kept_prefix"] >= r["n_chars"] - r["n_chars"] // 4
        assert r["near_edited"] == fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"])
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0
    alone = fingerprints.edited_fingerprints(docs(spark, [(1, "abcdefgh")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1


def test_extensions_of_pairs(spark):
    df = spark.createDataFrame([("hello world", "say hello there", 0, 4, 1), (None, "x", 0, 0, 1), ("abc", "abc", 3, 3, 1), ("abc", "abc", 4, 0, 1)], "x string, y string, i int, j int, extension int")
    assert [r["extension"] for r in fingerprints.common_extensions(df, "x", "y", "i", "j").collect()] == [6, None, 0, None]
    assert {r["fingerprint"] for r in fingerprints.fingerprints(docs(spark, [(1, None), (2, "")])).collect()} == {str(fingerprints.Fingerprint.of(fingerprints.codes_of("")))}


# --- 12: alignment ----------------------------------------------------------------------------


def by_hand(text):
    """(n_a, n_b, groups, links) of one text, token by token."""
    own = alignment.Aligner.of(A, B)
    a, b = (own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)) if text else ([], [])
    whole = (" " + (text or "")).encode()
    if not text or b"".join(own.a_bytes[i] for i in a) != whole or b"".join(own.b_bytes[i] for i in b) != whole:
        return 0, 0, [], Counter()
    ends = [list(itertools.accumulate(len(side[i]) for i in ids)) for side, ids in ((own.a_bytes, a), (own.b_bytes, b))]
    groups, links = [], Counter()
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(ids, ends[k], strict=True) if (groups_end[-1] if (groups_end := [c for c in sorted(set(ends[0]) & set(ends[1])) if c < cut]) else 0) < e <= cut] for k, ids in enumerate((a, b))))
    for i, e in zip(a, ends[0], strict=True):
        for j, f in zip(b, ends[1], strict=True):
            if e - len(own.a_bytes[i]) < f and f - len(own.b_bytes[j]) < e:
                links[i, j] += 1
    return len(a), len(b), groups, links


@pytest.mark.parametrize("hot", [alignment.HOT, 3, 0])
def test_alignment_matches_brute_force(spark, hot):
    rng = random.Random(5)
    parts = ["the", "a", " ", "  ", "\n", "\t", "12", "é", "ß", "!", "'s", "日本", " hello", "𝔘", "▁", "<s>", "<|endoftext|>", "\xa0", " ﬁ", "unbelievable", "\x00"]
    texts = [None, "", " ", "abc ", " abc", "  abc  ", "a\n b", "<0x41>", "the same text", "the same text"] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, "a second third"), (None, "no id"), (None, "no id")]
    hand = [(i, *by_hand(t)) for i, t in rows]
    count, most = Counter(), defaultdict(int)
    for *_, links in hand:
        count.update(links.keys())
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = Counter()
    for i, n_a, n_b, groups, links in hand:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for (a, b), n in links.items() if count[a, b] == most[a])
        want[i, n_a, n_b, len(groups), sum(links.values()), best, sum(n * count[x] for x, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if n_a else ""] += 1
    out = alignment.align(docs(spark, rows), A, B, hot=hot)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == want
    if hot == 3:
        assert alignment.align(docs(spark, []), A, B).count() == 0


def test_long_texts_in_parts(monkeypatch):
    own, text = alignment.Aligner.of(A, B), " ".join(random.Random(6).choices(["alpha", "be-ta", "gamma\n", "\n delta", "12"], k=3000))
    whole = next(own.documents([text]))
    monkeypatch.setattr(alignment, "PART_CHARS", 500)
    parts = next(own.documents([text]))
    assert whole[:5] == parts[:5] and all((x == y).all() for x, y in zip(whole[5:], parts[5:], strict=True))
    pairs, times = alignment.unpack(alignment.pack(*whole[5:]))
    assert (pairs == whole[5]).all() and (times == whole[6]).all()


def test_coalescing_of_any_intervals():
    rng = random.Random(7)
    for _ in range(200):
        sides = []
        for _ in range(2):
            at, out = 0, []
            for _ in range(rng.randint(1, 8)):
                at += rng.randint(0, 2)
                out.append((at, at := at + rng.randint(1, 4)))
            sides.append(out)
        a, b = (np.array(s) for s in sides)
        left, right = alignment.overlaps(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
        want = [(i, j) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if x[0] < y[1] and y[0] < x[1]]
        assert list(zip(left.tolist(), right.tolist(), strict=True)) == want
        ga, gb, n = alignment.coalesce(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
        assert all(ga[i] == gb[j] for i, j in want) and max(*ga, *gb) == n - 1


# --- 13: hard negatives -----------------------------------------------------------------------


def mined(rows, every=10, positives=5, negatives=10):
    """The contract row by row."""
    fine = {}
    for i, v, label in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2])):
        if v and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, ([math.floor(256 * x) for x in v], label))
    out = []
    for i, (v, label) in fine.items():
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, (w, other) in fine.items() if j != i and len(w) == len(v)))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 512), (16, 3)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "ROWS", sizes[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[1])
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((4, 24))
    rows = [(i, [float(x) for x in centres[i % 4] * rng.random() + rng.standard_normal(24) * 0.4], int(i % 5)) for i in range(240)]
    rows += [(300, rows[0][1], 0), (310, rows[0][1], 0), (320, rows[0][1], 1), (330, [0.0] * 24, 1), (340, [1.0, 2.0], 1), (350, [1.5, 2.0], 1), (360, [1.0, 1.0], 2)]
    rows += [(370, None, 1), (380, [float("nan")] * 24, 1), (390, [None] * 24, 1), (400, rows[1][1], None), (None, rows[1][1], 1), (20, rows[3][1], 9), (410, [], 1)]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "vec_id long, embedding array<float>, label int, dim string, level0 string")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    out = hard_negatives.mine(df, lambda i: i % 10 == 0)
    assert sorted(map(tuple, out.collect())) == mined(exact)
    if sizes[0] == 16:
        assert hard_negatives.mine(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = np.floor(rng.standard_normal((50, 37)) * 256), np.floor(rng.standard_normal((60, 37)) * 256)
    exact, before = hard_negatives.scores(x, y), None
    for a, b in zip(hard_negatives.summaries(x), hard_negatives.summaries(y), strict=True):
        low, high = hard_negatives.bounds(a, b)
        assert (low <= exact).all() and (exact <= high).all()
        assert before is None or (high - low).mean() <= before
        before = (high - low).mean()
    big = np.full((1, 4), 2.0**40)
    assert hard_negatives.scores(big, big)[0, 0] == 2**63 - 1 and hard_negatives.scores(big, -big)[0, 0] == -(2**63)


# --- 5: one dense topic -----------------------------------------------------------------------


def test_embedding_recall_on_one_topic(spark, tmp_path):
    """Vectors that all lean one way crowd the windows; further rounds must find what the first has missed."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from stmtspark.llm import embeddings

    rng, n, d = np.random.default_rng(2), 6000, 48
    centre = rng.standard_normal(d)
    centre /= np.linalg.norm(centre)
    off = rng.standard_normal((n, d))
    off -= np.outer(off @ centre, centre)
    x = np.sqrt(0.88) * centre + np.sqrt(0.12) * off / np.linalg.norm(off, axis=1, keepdims=True)
    turn = rng.standard_normal((200, d))
    turn -= np.einsum("ij,ij->i", turn, x[:200])[:, None] * x[:200]
    x = np.vstack([x, 0.952 * x[:200] + np.sqrt(1 - 0.952**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    component = embeddings.near_vectors(spark.read.parquet(str(tmp_path / "e.parquet"))).toPandas().set_index("vec_id")["component_id"].sort_index().to_numpy()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    i, j = np.nonzero(unit[::50] @ unit.T >= 0.95)
    i, j = (i * 50)[i * 50 != j], j[i * 50 != j]
    assert (component[i] == component[j]).mean() >= 0.95 and (component[:200] == component[n:]).mean() >= 0.95


# --- 7: many dates of one host ----------------------------------------------------------------


def test_url_lists_of_many_dates(spark):
    from pyspark.sql import functions as F

    from stmtspark.llm import url_filters

    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    entries = spark.range(3000).select(F.lit("hot.org").alias("pattern"), F.when(F.col("id") % 3 == 0, "block").otherwise("allow").alias("action"), at(F.col("id") * 100).alias("since"))
    captures = spark.range(20_000).select(F.concat(F.lit("http://www.hot.org/"), F.col("id") % 7).alias("url"), at(F.col("id") * 15 - 50).alias("fetched"), F.col("id").alias("n"))
    rows = url_filters.filter_urls(captures, entries).select("n", "blocked", F.unix_timestamp(F.col("listed_since").cast("timestamp")).alias("s")).collect()
    assert len(rows) == 20_000
    for r in rows:
        t = r["n"] * 15 - 50
        assert (r["blocked"], r["s"]) == ((t // 100 % 3 == 0, t // 100 * 100) if 0 <= t < 300_000 else (False, None) if t < 0 else (2999 % 3 == 0, 299_900))


# --- tables of threads ------------------------------------------------------------------------


def test_threads_keep_their_own_tables(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 10 != 9], "u long, v long")
    found, failed = [], []

    def run():
        try:
            found.append(sorted(map(tuple, components.connected_components(chain).collect())))
        except Exception as e:  # shown by the assertion
            failed.append(repr(e)[:300])

    threads = [threading.Thread(target=run) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and found[0] == found[1] == found[2] == sorted((i, i - i % 10) for i in range(60))


def test_bpe_remembers_pieces_of_many_batches():
    """Words of an earlier batch are not contracted anew after two batches of 90,000 other words."""
    coder, asked = bpe.PieceCoder.__new__(bpe.PieceCoder), []
    coder.young, coder.old = {}, {}
    coder.encode = lambda pieces: [asked.append(p) or b"" for p in pieces]
    for batch in (0, 1, 2, 0):
        coder.learn({f" w{i}" for i in range(90_000 * batch, 90_000 * (batch + 1))})
    assert len(asked) == 270_000 and len(coder.young) + len(coder.old) <= 2 * (bpe.CACHE + 90_000)
