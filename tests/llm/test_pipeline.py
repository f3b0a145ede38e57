"""The corpus pipeline on a small table with planted cases."""

import base64
import hashlib
import itertools
import random
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
import public_tokenizers as P
import tiktoken
from conftest import SF

from stmtspark.llm import queries


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def brute_force(texts: dict[int, str | None], bad: set[str], items: list[str]) -> list[tuple]:
    """The pipeline in plain Python: all pairs, all runs of 50 words, all windows, the library's tokens."""
    split = lambda t: (t or "").lower().split()
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    now = {i: t for i, t in texts.items() if not bad & set(split(t))}
    sets, root = {i: set(grams(split(t))) for i, t in now.items()}, {i: i for i in now}
    for a, b in itertools.combinations(sorted(now), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = sorted((root[a], root[b]), reverse=True)
            root = {i: new if r == old else r for i, r in root.items()}
    now = {i: now[i] for i in sorted(now) if root[i] == i}
    seen: set[tuple] = set()
    for i, t in now.items():
        w, keep = split(t), (t or "").split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {k + j for k, r in enumerate(runs) if r in seen for j in range(50)}
        if gone:
            now[i] = " ".join(x for k, x in enumerate(keep) if k not in gone)
        seen.update(runs)
    now = {i: t for i, t in now.items() if t is None or t or not texts[i]}

    def leaks(w: list[str], item: list[str]) -> bool:
        a = Counter(grams(item))
        windows = (Counter(grams(w[k : k + len(item)])) for k in range(max(1, len(w) - len(item) + 1)))
        return any((a & b) and sum((a & b).values()) >= 0.75 * sum((a | b).values()) for b in windows)

    now = {i: t for i, t in now.items() if not any(leaks(split(t), split(x)) for x in items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: lib.encode_ordinary(t or "") for i, t in now.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return sorted((i, len(x), sha(",".join(map(str, x)).encode()), sha((now[i] or "").encode())) for i, x in ids.items())


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Copies of many grades, passages behind earlier quotes of them, leaks, nulls, repeats; every row of run()."""
    rng = random.Random(21)
    items, passages = [" ".join(words(rng, 30)) for _ in range(3)], [words(rng, 120) for _ in range(4)]
    texts: list[str | None] = [" ".join(words(rng, 60) + (["scumbag"] if i % 6 == 0 else [])) for i in range(150)]
    labels = [(i, int(i % 6 == 0)) for i in range(150)]
    for k, p in enumerate(passages):
        texts += [" ".join(words(rng, 45) + part + words(rng, 45)) for part in (p[:40], p[60:100], p, p[10:110], p)]
        near = texts[k + 7].split()
        near[k * 7 + 20] = "other"
        texts += [" ".join(near), " ".join([*near[:25], *near[26:], "end"]), " ".join(near[:30] + words(rng, 30))]
    texts += [" ".join(words(rng, 40) + x.split() + words(rng, 30)) for x in items] + [texts[1], texts[2] + " end", None, "", "few words", " ".join([*words(rng, 30), "scumbag"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine") for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute_force(dict(enumerate(texts)), {"scumbag"}, items)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [r[0] for r in got] == [r[0] for r in want] and got == want


def test_stages_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "a b", "en", "s", 3)], schema)
    one.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    item = " ".join(words(rng, 40))
    passage = words(rng, 80)
    texts, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        texts.append(" ".join(words(rng, 60) + (["scumbag", "idiot"] if bad else [])))
        labels.append((i, int(bad)))
    texts += [texts[1], texts[1] + " more", " ".join(words(rng, 30) + passage), " ".join(words(rng, 40) + passage + words(rng, 20)), " ".join(words(rng, 30) + item.split() + words(rng, 30)), " ".join([*words(rng, 50), "scumbag", "idiot"]), "", None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    now = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, d).write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        assert k == 4 or now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = [{r["doc_id"]: r for r in spark.read.parquet(f"{d}/stage{k}").collect()} for k in range(5)]
    toxic = {i for i in range(200) if i % 5 == 0} | {205}
    assert set(range(208)) - set(kept[0]) == toxic
    assert set(kept[0]) - set(kept[1]) == {200, 201}
    assert kept[2].keys() == kept[1].keys() and kept[2][203]["text"] == " ".join(texts[203].split()[:40] + texts[203].split()[120:]) and kept[2][203]["n_chars"] == len(kept[2][203]["text"])
    assert all(kept[2][i]["text"] == kept[1][i]["text"] for i in kept[1] if i != 203)
    assert set(kept[2]) - set(kept[3]) == {204} and kept[4].keys() == kept[3].keys()
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(tuple(r) for r in kept[4].values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    key = lambda df: sorted(tuple("" if str(v) in ("NaT", "None", "nan", "<NA>") else str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_all_queries_run(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_bpe", "op2_toxicity", "op3_token_counts", "op9_lm_scores", "op10_minhash", "op11_fingerprints", "op12_alignment"):
        assert queries.QUERIES[name](spark, SF).count() == n
