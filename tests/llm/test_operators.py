"""The training-data operators against the libraries they follow, brute force and edge cases."""

import base64
import hashlib
import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from stmtspark.llm import bpe, components, decontaminate, embeddings, html_text, lm_scores, minhash, substrings, token_counts, toxicity, url_filters

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello  world\n\tit's 12", "déjà vu — ñandú 日本", "x" * 3000, "aaaaab" * 200, "<|endoftext|> tail", "İΣ é", "the cat sat " * 300]
DOCS = "doc_id long, text string, lang string, ids string, score string, n_tokens string"


def docs(spark, texts, start=0):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(start + i, t, "en", "mine", "mine", "mine") for i, t in enumerate(texts)], DOCS)


def prose(rng, n, size=4000):
    return [f"w{int(size * rng.random() ** 2)}" for _ in range(n)]


# --- 1 and 3: tokens --------------------------------------------------------------------------


def test_bpe_matches_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "\r\n", "1", "23", "é", "ß", "!", "'s", " ", "\x1c", "日本", " hello", "𝔘"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(300)] + ["the cat"] * 2
    texts += ["".join(rng.choices(a, k=n)) for a in ("ab", "aeinrst", "日本語éß", "abcdefghijklmnopqrstuvwxyz") for n in (60, 65, 130, 900)] + ["-" * 70_000, "ab" * 4000, " ".join(prose(rng, 250_000))]
    out = bpe.bpe_round_trip(docs(spark, texts), RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "score", "n_tokens", "ids", "decoded"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == own.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    rows = {r["doc_id"]: r for r in bpe.digest(out).collect()}
    assert rows[3]["ids_sha256"] == hashlib.sha256(",".join(map(str, got[3]["ids"])).encode()).hexdigest()
    back = bpe.bpe_decode(out.select("doc_id", "ids"), RANKS, P.PATTERN).collect()
    assert all(bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode() for r in back)
    assert bpe.digest(bpe.bpe_round_trip(docs(spark, []), RANKS, P.PATTERN)).count() == 0


def test_token_counts_match_tokenizers(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    alphabet = ["a", "The", " ", "\n", "1", "23", "é", "é", "ß", "!", "'LL", " ", "\x85", "日本", " hello", "İ", "ΑΣ", "<|endoftext|>", "<|start"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(400)]
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, texts), WORDS).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["n_tokens"] == len(lib.encode(t or "", add_special_tokens=False).ids), t
        assert rows[i]["n_bytes"] == len((t or "").encode())
        assert rows[i]["over_limit"] == (rows[i]["n_tokens"] > 2048)
    counter = token_counts.WordCounter.of(WORDS)
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(counter.whole), 500))
    assert token_counts.count_tokens(docs(spark, []), WORDS).count() == 0


# --- 2: toxicity ------------------------------------------------------------------------------


def labelled(spark, share):
    """Texts of which every fourth is toxic; ``share`` of those say so, and one group is named mostly in them."""
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        group = "muslims" if rng.random() < (0.8 if bad else 0.1) else "christians"
        texts.append(" ".join([*prose(rng, 20, 300), group, *(["vermin"] if bad and rng.random() < share else [])]))
        labels.append((i, int(bad)))
    return docs(spark, [*texts, None, ""]), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    d, lab = labelled(spark, 1.0)
    scorer = toxicity.train(d, lab)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(d, scorer).collect()}
    held = [r[0] for r in d.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect() if r[0] < 600]
    assert sum((out[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert out[600] == out[601] and 0 <= out[600] < 0.5
    again = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(None, "x")], "doc_id long, text string")
    assert toxicity.labelled_rows(again, spark.createDataFrame([(7, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int"), max_rows=2).count() == 1
    none = toxicity.train(d, lab.limit(0))
    assert none.score("vermin") < 0.5 and toxicity.score(docs(spark, []), scorer).count() == 0


def test_counterfactuals_hold_identity_terms_still(spark):
    rows, y, moves = toxicity.as_arrays(toxicity.labelled_rows(*labelled(spark, 0.5)).toArrow())
    text = " ".join(prose(random.Random(9), 20, 300))
    change = []
    for weight in (0.0, 30.0):
        s = toxicity.Scorer(*toxicity.fit(rows, y, moves, counterfactual=weight))
        change.append(abs(s.score(text + " muslims") - s.score(text + " christians")))
    assert len(moves) == len(rows) and change[0] > 0.05 and change[1] < change[0] / 4


# --- 4: main text -----------------------------------------------------------------------------


def test_blocks():
    page = '<title>t</title><script>x="</p>"</script><nav><ul><li><a href="/">Home</a><li>B</ul></nav><!-- c --><article><h1>A &amp; B</h1><p>one\n two<br>x<p>a<b>b</b> c</article><p class="ad">buy'
    got = [(b.text, b.path[-1]) for b in html_text.blocks_of(page)]
    assert [t for t, _ in got] == ["Home", "B", "A & B", "one two x", "ab c", "buy"]
    assert html_text.blocks_of(None) == [] and html_text.blocks_of("<!-- open") == [] and [b.text for b in html_text.blocks_of("a < b")] == ["a < b"]


def test_blocks_of_odd_markup():
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts("<article><p title=it's>First part.</p><p>We don't stop.</p></article>") == ["First part.", "We don't stop."]
    assert texts("<p title='a > b' x=\"<p>\">one</p><p x=>two") == ["one", "two"]
    assert texts("<p>a <math><mi>x</mi></math> <svg/>b<svg><path d=1 /><text>t</text></svg></p><noscript><p>real</p></noscript>") == ["a x bt", "real"]
    assert texts("<p>a<object><p>b<canvas>c</canvas>") == ["a", "bc"] and texts("<p>x<div a='1") == ["x"]
    began = time.monotonic()
    assert len(html_text.blocks_of("<div>a" * 30_000)) == 30_000 and len(html_text.blocks_of("<i x=" * 50_000 + "<p>" * 50_000 + "t")) == 1
    assert html_text.blocks_of("<p x=" + '="' * 100_000) == [] and time.monotonic() - began < 20
    assert html_text.run_starts(400) == [0] and html_text.run_starts(1000) == [0, 300, 600]


def test_labeller_gradients_and_extraction(spark):
    rng = random.Random(6)
    x = [html_text.vectors(html_text.template(rng)[0]) for _ in range(3)]
    model = html_text.BlockLabeller()
    batch, mask = html_text.padded(x)
    y = np.zeros(mask.shape)
    _, grad = model.gradients(batch.astype(float), mask, y)
    for key in ("hf", "hb", "cf", "o"):
        w, at = model.w[key], (1,) * model.w[key].ndim
        w[at] += 1e-5
        up = model.gradients(batch.astype(float), mask, y)[0]
        w[at] -= 2e-5
        down = model.gradients(batch.astype(float), mask, y)[0]
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[key][at]) < 1e-6
    page = lambda i: f'<body><nav><ul><li><a href="/a">menu {i}</a></li></ul></nav><div class="ad">buy {i} now</div><article><h1>Title {i}</h1><p>{" ".join(prose(rng, 30))}.</p><p>Second {i}.</p></article><footer>&copy; site {i}</footer></body>'
    html = [page(i) for i in range(40)]
    rows = spark.createDataFrame([(i, h, "mine") for i, h in enumerate([*html, None, "", "<p></p>", html[0]])] + [(0, html[0], "mine")] * 9 + [(None, html[1], "mine")] * 2, "page_id long, html string, text string")
    made = html_text.extract(rows, html_text.train(rows)).collect()
    out = {r["page_id"]: r for r in made}
    assert len(made) == 55 and out[None]["text"] == out[1]["text"]
    want = lambda h: "\n".join(b.text for b in html_text.blocks_of(h) if "article" in b.path)
    assert sum(out[i]["text"] == want(h) for i, h in enumerate(html)) >= 39
    assert [out[i]["text"] for i in (40, 41, 42)] == ["", "", ""] and out[43]["text"] == out[0]["text"] and out[0]["n_chars"] == len(out[0]["text"])


# --- 5 and 10: near duplicates ----------------------------------------------------------------


def reach(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = reach(200, links)
    assert got == {i: want[i] for i in {x for a, b in links for x in (a, b) if a != b}}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_minhash_matches_brute_force(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(30, 90)) for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for i in range(120):  # one large group with many grades of likeness
        w = list(base[0])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"z{i}"
        texts.append(" ".join(w))
    texts += [texts[0].upper(), None, "", "one two", "ONE  two", "one two three", texts[3], texts[3]]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = reach(len(texts), links)
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [rows[i]["component_id"] for i in range(len(texts))] == want
    assert all(rows[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_minhash_null_ids_repeats_and_small_blocks(spark, monkeypatch):
    rng = random.Random(18)
    base = prose(rng, 60)
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, "x y z x y z")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    nameless = [r for r in got if r["doc_id"] is None]
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in nameless) == [(0, None, True), (2, None, True), (2, None, True)]
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    monkeypatch.setattr(minhash, "SHINGLES", 100)
    texts = [" ".join(base[:40] + prose(rng, 20)) for _ in range(30)] + [" ".join([*base[:-1], f"z{i}"]) for i in range(30)]
    want = reach(60, [(30, i) for i in range(30, 60)])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(60)] == want


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 32))
    x[50:110] = x[50] + 0.15 * rng.standard_normal((60, 32))
    x[110:114] = x[0]
    x[114] = 3 * x[1]
    vectors = [v.tolist() for v in x] + [None, [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, []]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = reach(300, zip(*np.nonzero(near), strict=True)) + list(range(300, 305))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n_links int")
    rows = {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}
    assert [rows[i]["component_id"] for i in range(305)] == want
    assert [rows[i]["n_links"] for i in range(305)] == [*near.sum(axis=1).tolist(), 0, 0, 0, 0, 0]
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (None, None), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (1, None), (2, [0.0, 2.0]), (3, [0.0, 1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(odd).collect()), key=str) == sorted([(None, 0, None, True), (None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)], key=str)


def test_embedding_recall_on_dense_groups(spark):
    """Of pairs just over the threshold, in a table of dense groups, at least 99 of 100 are found."""
    rng = np.random.default_rng(19)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    n, pairs = 20_000, 400
    x = unit(0.8**0.5 * unit(rng.standard_normal((40, 48)))[rng.integers(0, 40, n)] + 0.2**0.5 * unit(rng.standard_normal((n, 48))))
    e = rng.standard_normal((pairs, 48))
    e = unit(e - (e * x[:pairs]).sum(axis=1)[:, None] * x[:pairs])
    x = np.concatenate([x, 0.952 * x[:pairs] + (1 - 0.952**2) ** 0.5 * e]).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    found = embeddings.near_vectors(rows).toPandas().set_index("vec_id")["component_id"]
    near = unit(x.astype(np.float64)) @ unit(x.astype(np.float64)).T >= 0.95
    want = np.array(reach(len(x), zip(*np.nonzero(np.triu(near, 1)), strict=True)))
    linked = np.flatnonzero(np.bincount(want)[want] > 1)
    assert len(linked) >= 2 * pairs and (found.loc[linked].to_numpy() == want[linked]).mean() >= 0.99
    assert [embeddings.passes_for(k) for k in (100, 50_000, 10**6, 10**9)] == [16, 16, 27, 85]


# --- 6: repeated passages ---------------------------------------------------------------------


def test_compact_windows_cover_each_run_once():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 2**63, 150).astype(np.uint64)
    starts, lengths = np.array([0, 90]), np.array([90, 60])
    seen = Counter()
    for h, left, centre, right in substrings.compact_windows(tokens, starts, lengths):
        for a, c, b in zip(left.tolist(), centre.tolist(), right.tolist(), strict=True):
            seen.update((h, i, j) for i in range(a, c + 1) for j in range(c, b + 1) if j - i + 1 >= substrings.WIDTH)
    runs = [(i, j) for s, n in zip(starts, lengths, strict=True) for i in range(s, s + n) for j in range(i + substrings.WIDTH - 1, s + n)]
    assert seen == Counter((h, i, j) for h in range(substrings.HASHES) for i, j in runs)


def test_repeated_passages(spark):
    rng = random.Random(10)
    passage, short = prose(rng, 70), prose(rng, 40)
    edited = list(passage)
    edited[20] = "changed"
    inserted = passage[:35] + ["extra"] + passage[35:]
    texts = [prose(rng, 60) + p + prose(rng, 60) for p in (passage, passage, edited, inserted, short, short)] + [prose(rng, 200), ["same"] * 400, passage]
    texts = [" ".join(t) for t in texts] + [None, "", "few words"]
    d = docs(spark, texts)
    found = substrings.repeated_passages(d)
    rows = found.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 8} and {r["src_doc_id"] for r in rows} <= {0, 1, 2, 3}
    exact = [r for r in rows if (r["doc_id"], r["src_doc_id"]) == (1, 0)]
    assert [(r["first_word"], r["n_words"], r["src_first_word"], r["similarity"]) for r in exact] == [(60, 70, 60, 1.0)]
    cut = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(d, found).collect()}
    assert cut[0] == texts[0] and cut[6] == texts[6] and 8 not in cut and cut[9] is None
    assert cut[1] == " ".join(texts[1].split()[:60] + texts[1].split()[130:])
    assert substrings.repeated_passages(docs(spark, [])).count() == 0
    assert substrings.without_words("a  b c\nd", [(1, 2)]) == "a  d"


def test_repeated_passages_behind_earlier_partial_copies(spark):
    """Earlier documents that hold a part, a common line or an edited form hide no later copy: all pairs by brute force."""
    rng = random.Random(77)
    texts, line = [], prose(rng, 30)
    for _ in range(6):
        whole = prose(rng, 80)
        edited = [w if i % 9 else "other" for i, w in enumerate(whole)]
        parts = [whole[20:60], whole[:45], whole[35:], edited, whole[10:55]]
        texts += [prose(rng, 40) + p + prose(rng, 40) for p in [*parts, whole, whole]]
    for _ in range(3):
        tail = prose(rng, 60)
        texts += [prose(rng, 30) + line + prose(rng, 50), prose(rng, 25) + line + tail, prose(rng, 35) + line + tail]
    texts = [" ".join(t) for t in texts]
    runs = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for w in map(str.split, texts)]
    want = {i for i in range(len(texts)) if any(runs[i] & runs[k] for k in range(i))}
    rows = substrings.repeated_passages(docs(spark, texts)).collect()
    assert want and want <= {r["doc_id"] for r in rows}
    for r in rows:
        x = texts[r["doc_id"]].split()[r["first_word"] :][: r["n_words"]]
        y = set(texts[r["src_doc_id"]].split())
        assert sum(w in y for w in x) >= 0.75 * len(x) and r["src_doc_id"] < r["doc_id"] and len(x) >= 50


def test_whole_passages_behind_quotes_and_in_large_groups(spark, monkeypatch):
    """Quotes of parts come first; the result is the same for any partitions, and with groups joined by Spark."""
    rng = random.Random(78)
    passage = prose(rng, 70)
    quotes = [passage[a : a + 34] for a in (0, 12, 24, 36)]
    edited = [*passage[:30], "other", *passage[31:]]
    parts = [*quotes, passage, passage, edited, passage[5:] + ["end"], passage]
    texts = [" ".join(prose(rng, 60) + p + prose(rng, 60)) for p in parts] * 2
    for parts in (1, 2, 7):
        got = {r["doc_id"] for r in substrings.repeated_passages(docs(spark, texts).repartition(parts)).collect()}
        assert got == {5, 6, 7, 8, *range(9, 18)}
    code = "import stmtspark.llm.substrings as s; s.LARGE = 3"
    monkeypatch.setattr(substrings, "_candidates", lambda it, own=substrings._candidates: (exec(code), own(it))[1])
    found = substrings.repeated_passages(docs(spark, texts[:9]).repartition(3)).collect()
    assert {r["doc_id"] for r in found} == {5, 6, 7, 8} and all(r["src_doc_id"] >= 4 for r in found)


# --- 7: lists ---------------------------------------------------------------------------------


def test_url_filters(spark):
    at = lambda day: f"2024-01-{day:02d} 00:00:00"
    entries = [("bad.org", "block", at(5)), ("bad.org", "allow", at(9)), ("x.bad.org", "allow", at(5)), ("ok.net/ads", "block", at(3)), ("ok.net/ads", "allow", at(3)), (None, "block", at(1))]
    urls = [("http://bad.org/a", 4), ("http://bad.org/a", 5), ("http://u@www.BAD.org:80/a", 8), ("http://bad.org", 9), ("http://x.bad.org/", 6), ("http://ok.net/ads/1", 4), ("http://ok.net/adsx", 4), (None, 4), ("no url", 4), ("http://bad.org/a", 5)]
    e = spark.createDataFrame(entries, "pattern string, action string, since string").withColumn("since", F.col("since").cast("timestamp_ntz"))
    c = spark.createDataFrame([(i, u, at(d), "mine") for i, (u, d) in enumerate(urls)], "i int, url string, fetched string, blocked string").withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))
    rows = {r["i"]: r for r in url_filters.filter_urls(c, e).collect()}
    assert [rows[i]["blocked"] for i in range(10)] == [False, True, True, False, False, True, False, False, False, True]
    assert rows[4]["pattern"] == "x.bad.org" and rows[7]["pattern"] is None
    e2 = spark.createDataFrame([("OK.net./Private", "block", at(1)), ("bad.org.", "block", at(1))], "pattern string, action string, since string").withColumn("since", F.col("since").cast("timestamp_ntz"))
    c2 = spark.createDataFrame([(u, at(2)) for u in ("http://ok.net/Private/x", "http://ok.net/private/x", "http://a.BAD.org./", "http://ok.net/Privates")], "url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))
    assert {r["url"] for r in url_filters.filter_urls(c2, e2).filter("blocked").collect()} == {"http://ok.net/Private/x", "http://a.BAD.org./"}
    assert url_filters.filter_urls(c.limit(0), e).count() == 0 and url_filters.filter_urls(c, e.limit(0)).filter("blocked").count() == 0


# --- 8: benchmark -----------------------------------------------------------------------------


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(11)
    items = [" ".join(prose(rng, rng.randint(8, 50))) for _ in range(12)] + ["two words", "", None]
    texts = []
    for k in range(60):
        w = items[k % 12].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{k}"
        texts.append(" ".join(prose(rng, 30) + w + prose(rng, 30)))
    texts += ["two words", "two words more", None, "", *[" ".join(prose(rng, 120)) for _ in range(20)]]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = set()
    for k, item in enumerate(items[:12]):
        a = grams(item.split())
        for i, t in enumerate(texts):
            w, n = (t or "").split(), len(item.split())
            for s in range(max(1, len(w) - n + 1)):
                b = grams(w[s : s + n])
                low = sum((a & b).values())
                if low and low / sum((a | b).values()) >= 0.75:
                    want.add((i, k))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    rows = decontaminate.contaminated(docs(spark, texts), df).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want | {(60, 12)}
    assert len(want) > 10 and decontaminate.contaminated(docs(spark, []), df).count() == 0 and decontaminate.contaminated(docs(spark, texts), df.limit(0)).count() == 0


def test_decontamination_groups_repeats_and_long_texts(spark, monkeypatch):
    rng = random.Random(31)
    items = [prose(rng, 40) for _ in range(4)] + [prose(rng, 500)]
    long = " ".join([*prose(rng, 150_000), *items[4] * 20, *prose(rng, 100_000), *items[1], *prose(rng, 40_000)])
    rows = [(1, " ".join(items[0] + prose(rng, 20))), (1, " ".join(prose(rng, 9) + items[0])), (2, " ".join(items[2])), (None, " ".join(items[3])), (3, long)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(0, " ".join(items[0])), (None, " ".join(items[0]))], "item_id long, text string")
    want = {(1, 0, 0, 40, 1.0), (2, 2, 0, 40, 1.0), (3, 4, 150_000, 500, 1.0), (3, 1, 260_000, 40, 1.0)}
    for group in (20_000, 1):
        monkeypatch.setattr(decontaminate, "GROUP", group)
        got = [tuple(r[c] for c in ("doc_id", "item_id", "first_word", "n_words", "similarity")) for r in decontaminate.contaminated(d, df).collect()]
        assert len(got) == 4 and set(got) == want
    assert decontaminate.window_starts(np.array([0, 3, 9]), 3, 10).tolist() == [0, 1, 2, 3, 7]


# --- 9: language models -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [3, 400])
def test_lm_scores_match_brute_force(spark, n):
    rng = random.Random(12)
    texts = [" ".join(prose(rng, rng.randint(1, 60), 80)) for _ in range(n)] + [None, "", " "]
    target = [" ".join(prose(rng, 20, 40)) for _ in range(n // 2)] + [None]
    nameless = spark.createDataFrame([(None, t, "en", "mine", "mine", "mine") for t in texts[:2]], DOCS)
    rows = {r["doc_id"]: r for r in lm_scores.cross_entropy_difference(docs(spark, texts).union(nameless), spark.createDataFrame([(t,) for t in target], "text string")).collect()}
    contexts, pairs, vocabulary = [Counter(), Counter()], [Counter(), Counter()], set()
    bigrams = lambda t: list(zip([None, *(t or "").split()[:-1]], (t or "").split()))
    for k, own in enumerate((texts + texts[:2], target)):
        for t in own:
            vocabulary.update((t or "").split())
            contexts[k].update(a for a, _ in bigrams(t))
            pairs[k].update(bigrams(t))
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        b = bigrams(t)
        loss = [sum(-math.log((pairs[k][x] + lm_scores.MU / len(vocabulary)) / (contexts[k][x[0]] + lm_scores.MU)) for x in b) / max(1, len(b)) for k in (0, 1)]
        assert rows[i]["n_tokens"] == len(b) and abs(rows[i]["score"] - (loss[1] - loss[0])) < 2e-5
    assert lm_scores.cross_entropy_difference(docs(spark, []), spark.createDataFrame([], "text string")).count() == 0
