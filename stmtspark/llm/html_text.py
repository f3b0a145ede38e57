"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks.  Each block becomes a vector: hashed tag path with
class and id words, hashed words, and a few measures.  A bidirectional LSTM in numpy reads the whole
sequence in both directions and labels every block as article text or not; the blocks it keeps are
joined in page order.

The labeller is trained on at most ``max_pages`` pages (the least hashes of page_id, one page of an id),
of each on PIECES runs of RUN blocks at most, a bound that is the same for every input, and on TEMPLATES
made-up block sequences.  Labels come from the pages' own
marks: blocks in article or main elements and outside navigation, asides, forms, notices, adverts and
comments are text.  Each training page also appears in varied forms, with these marks renamed and
with boilerplate of other kinds mixed in, so that the labels can't be read from one mark alone.

Only scripts, styles, titles and the raw text of text areas and frames are passed over while reading;
what else is no article text is for the labeller to tell.  Reading is linear in the page: of deeply
nested tags a block's path holds the outermost and innermost DEPTH.

Nulls and empty pages give an empty text.  Repeated pages give equal rows, and null page_ids are pages as
others, though not trained on.  Comments and tags that are left open end with the page.  Other columns
pass through, except that ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stmtspark.llm.common import small_batches, text_chunks

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style textarea title iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"body", "html"}
#: A quote opens only after an equals sign.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

PATH_DIMS, WORD_DIMS, MEASURES = 64, 32, 8
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
MAX_PAGES, TEMPLATES, VARIANTS, EPOCHS = 400, 100, 1, 12
#: Blocks of a training sequence, and sequences of one page; open tags at either end of a path, and names of a tag.
RUN, PIECES, DEPTH, NAMES = 400, 3, 24, 16


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0


@dataclass
class _Reader:
    """Collects blocks while the tags of one page go by."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                near = self.open if len(self.open) <= 2 * DEPTH else self.open[:DEPTH] + self.open[-DEPTH:]
                self.blocks.append(Block(text, tuple(w for _, own in near for w in own), self.linked))
            self.parts, self.linked = [], 0

    def push(self, tag: str, attributes: str) -> None:
        names = [w for x in _NAMES.findall(attributes) for w in _SPLIT.split("".join(x).lower()) if w]
        self.open.append((tag, (tag, *(f".{w}" for w in names[:NAMES]))))
        self.count[tag] += 1

    def close(self, tag: str) -> None:
        """End the innermost open ``tag`` and all inside it; nothing if there is none."""
        while self.count[tag]:
            last, _ = self.open.pop()
            self.count[last] -= 1
            if last == tag:
                return


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, without scripts, styles, the head's title and comments."""
    page, reader, at = page or "", _Reader(), 0
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            text = page[at : m.start()]
            reader.parts.append(text)
            if any(t == "a" for t, _ in reader.open[-3:]):
                reader.linked += len(text)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = tag in BLOCK_TAGS
        if m[1]:
            if block:
                reader.end_block()
            reader.close(tag)
            continue
        if tag == "br":
            reader.parts.append(" ")
        if block:
            reader.end_block()
            if tag in CLOSES_P and reader.count["p"]:
                reader.close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and reader.open and reader.open[-1][0] == tag:
                reader.close(tag)
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        # drawings and formulas are XML: a tag that ends in a slash has no content
        empty = m[3].endswith("/") and (tag in ("svg", "math") or reader.count["svg"] or reader.count["math"])
        if tag not in VOID_TAGS and not empty:
            reader.push(tag, m[3])
    if at < len(page):
        reader.parts.append(page[at:])
    reader.end_block()
    return reader.blocks


class _Slots(dict):
    def __init__(self, size: int):
        self.size = size

    def __missing__(self, key: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[key] = xxhash.xxh32_intdigest(key) % self.size
        return value


_path_slots, _word_slots = _Slots(PATH_DIMS), _Slots(WORD_DIMS)


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), DIMS), dtype=np.float32)
    for i, b in enumerate(blocks):
        own = out[i]
        for w in b.path:
            own[_path_slots[w]] += 1
        words = b.text.lower().split()
        counts = np.bincount(np.fromiter(map(_word_slots.__getitem__, words), dtype=np.int64, count=len(words)), minlength=WORD_DIMS)
        own[PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / (np.linalg.norm(counts) + 1e-9)
        n = len(b.text)
        own[PATH_DIMS + WORD_DIMS :] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, b.linked / n if b.linked < n else 1.0, b.text[-1] in ".!?:;\"”", b.path[-1:] in (("p",), ("b",)), any(w in ("h1", "h2", "h3") for w in b.path), i / len(blocks), 1.0)
    np.minimum(out[:, :PATH_DIMS], 2, out=out[:, :PATH_DIMS])
    return out


class BlockLabeller:
    """A bidirectional LSTM and a logistic output, forward and backward in numpy."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = weights or {f"{k}{d}": v for d in "fb" for k, v in (("x", rng.normal(0, 0.15, (DIMS, 4 * HIDDEN))), ("h", rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))), ("c", np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)))} | {"o": rng.normal(0, 0.2, 2 * HIDDEN), "b": np.zeros(1)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states over time for x (time, batch, DIMS), and if asked what gradients need; mask marks the real blocks."""
        h = c = np.zeros((x.shape[1], HIDDEN))
        z, out, kept = x @ self.w["x" + d] + self.w["c" + d], np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = z[t] + h @ self.w["h" + d]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep:
                kept.append((t, i, f, o, g, c, h, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]
        return hf @ self.w["o"][:HIDDEN] + hb @ self.w["o"][HIDDEN:] + self.w["b"]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            b = a
            while b < len(order) and b - a < 256 and (b == a or (b - a + 1) * len(pages[order[b]]) <= 20_000):
                b += 1
            x, mask = padded([pages[i] for i in order[a:b]])
            s = self.scores(x, mask)
            for k, i in enumerate(order[a:b]):
                out[i] = s[: len(pages[i]), k] >= 0
            a = b
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        (hf, kf), (hb, kb) = self._run(x, mask, "f", True), self._run(x, mask, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        z = both @ self.w["o"] + self.w["b"]
        n = max(mask.sum(), 1)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / n
        grad = {"o": np.einsum("tb,tbk->k", e, both), "b": np.array([e.sum()])}
        for d, kept, w in (("f", kf, self.w["o"][:HIDDEN]), ("b", kb, self.w["o"][HIDDEN:])):
            dz, dh, dc = np.zeros((*x.shape[:2], 4 * HIDDEN)), np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            gh = np.zeros_like(self.w["h" + d])
            for t, i, f, o, g, c, h, tc, m in reversed(kept):
                dh = dh + e[t][:, None] * w
                live, carry = dh * m, dh * (1 - m)
                dcell = dc * m + live * o * (1 - tc**2)
                da = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), live * tc * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                dz[t] = da
                gh += h.T @ da
                dh = da @ self.w["h" + d].T + carry
                dc = dcell * f + dc * (1 - m)
            grad |= {"x" + d: np.einsum("tbi,tbk->ik", x, dz), "h" + d: gh, "c" + d: dz.sum(axis=(0, 1))}
        loss = (np.logaddexp(0, z) - y * z) * mask
        return float(loss.sum() / n), grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02) -> BlockLabeller:
        rng, m, v, step = np.random.default_rng(11), {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for epoch in range(epochs):
            now = rate * (1 - epoch / epochs)
            order = rng.permutation(len(pages))
            for a in range(0, len(order), 32):
                own = order[a : a + 32]
                x, mask = padded([pages[i] for i in own])
                y = np.zeros(mask.shape)
                for k, i in enumerate(own):
                    y[: len(labels[i]), k] = labels[i]
                _, grad = self.gradients(x, mask, y)
                step += 1
                scale = min(1.0, 2.0 / (np.sqrt(sum((g**2).sum() for g in grad.values())) + 1e-9))
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g * scale
                    v[k] = 0.999 * v[k] + 0.001 * (g * scale) ** 2
                    self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch, DIMS) and its mask."""
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), DIMS), dtype=np.float32), np.zeros((longest, len(pages)))
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


TEXT_MARKS = frozenset({"article", "main"})
OTHER_MARKS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "button", "select", *(f".{w}" for w in "ad ads advert advertisement banner breadcrumb comment comments cookie footer header menu nav navbar newsletter notice popup promo related share sidebar social sponsored subscribe widget".split())))
_RENAMED = {
    "nav": (("div", ".menu"), ("ul", ".nav"), ("div", ".navbar")), "footer": (("div", ".footer"), ("div", ".bottom"), ("div",)), "header": (("div", ".header"), ("div", ".top")),
    "aside": (("div", ".sidebar"), ("div", ".widget")), "article": (("div", ".content"), ("div", ".post"), ("main",), ("section",), ("div",)), "main": (("div", ".main"), ("article",), ("div",)),
    ".ad": ((".banner",), (".sponsored",), (".promo",)),
}
_EXTRA = ((("div", ".comments", "div", ".comment", "p"), 4), (("section", ".comments", "p"), 3), (("div", ".cookie", ".notice", "p"), 1), (("div", ".notice"), 1), (("aside", "p"), 2), (("div", ".sidebar", "ul", "li", "a"), 5), (("form", "label"), 2), (("form", "div"), 2), (("div", ".newsletter", "p"), 1), (("div", ".share", "a"), 2), (("header", "div"), 1), (("aside", ".related", "ul", "li", "a"), 4), (("div", ".ad", "p"), 1))


def marked(blocks: list[Block]) -> np.ndarray | None:
    """Labels by the page's own marks, or None where it has none for text."""
    text = np.array([bool(TEXT_MARKS & set(b.path)) for b in blocks])
    return text & np.array([not OTHER_MARKS & set(b.path) for b in blocks]) if text.any() else None


def varied(blocks: list[Block], labels: np.ndarray, rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """The page with other marks, and with boilerplate of other kinds put in."""
    to = {k: rng.choice(v) for k, v in _RENAMED.items() if rng.random() < 0.6}
    rows = [(Block(b.text, tuple(y for w in b.path for y in to.get(w, (w,))), b.linked), bool(t)) for b, t in zip(blocks, labels, strict=True)]
    pool = " ".join(b.text for b in blocks).split() or ["a"]
    for path, most in rng.sample(_EXTRA, rng.randint(0, 4)):
        inside = [i for i, (_, t) in enumerate(rows) if t]
        at = rng.choice((0, len(rows), inside[-1] + 1 if inside else 0))
        base = ("html", "body", *(rows[inside[-1]][0].path[2:-1] if inside and at == inside[-1] + 1 and rng.random() < 0.5 else ()))
        made = []
        for _ in range(rng.randint(1, most)):
            start, n = rng.randrange(len(pool)), rng.randint(1, 30 if path[-1] == "p" else 5)
            text = " ".join(pool[start : start + n])
            made.append((Block(text, (*base, *path), len(text) if path[-1] == "a" else 0), False))
        rows[at:at] = made
    return [b for b, _ in rows], np.array([t for _, t in rows])


def template(rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """A made-up page: navigation, an article of paragraphs, a footer."""
    word = lambda: "".join(rng.choice("aeiourstlnmdc") for _ in range(rng.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    rows = [(Block(say(1), ("html", "body", "nav", "ul", "li", "a"), 1), False) for _ in range(rng.randint(0, 7))]
    rows += [(Block(say(rng.randint(3, 25)), ("html", "body", "div", ".ad")), False)] * rng.randint(0, 1)
    rows += [(Block(say(rng.randint(3, 10)), ("html", "body", "article", "h1")), True)] * rng.randint(0, 1)
    rows += [(Block(say(rng.randint(1, 80)) + ".", ("html", "body", "article", rng.choice(("p", "p", "p", "li", "h2", "blockquote")))), True) for _ in range(rng.randint(1, 12))]
    rows += [(Block(say(rng.randint(2, 15)), ("html", "body", "footer")), False)]
    return [b for b, _ in rows], np.array([t for _, t in rows])


def run_starts(blocks: int) -> list[int]:
    """Where the training runs of a page begin: of a long page its beginning, middle and end."""
    if blocks <= RUN:
        return [0]
    last = blocks - RUN
    return sorted({round(last * k / (PIECES - 1)) for k in range(PIECES)})


def train(pages: DataFrame, page_id: str = "page_id", markup: str = "html", max_pages: int = MAX_PAGES) -> BlockLabeller:
    """A labeller from at most ``max_pages`` pages and the templates."""
    named = pages.select(F.col(page_id).cast("long").alias("id"), F.col(markup).alias("page")).filter("id IS NOT NULL AND page IS NOT NULL")
    chosen = named.select("id").distinct().orderBy(F.xxhash64("id", F.lit(3)), "id").limit(max_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in zip(batch.column("id").to_pylist(), batch.column("page").to_pylist(), strict=True):
                blocks, x, y = blocks_of(page), [], []
                if len(blocks) and (labels := marked(blocks)) is not None:
                    rng = random.Random(i)
                    for a in run_starts(len(blocks)):
                        own, t = blocks[a : a + RUN], labels[a : a + RUN]
                        for own, t in ((own, t), *[varied(own, t, rng) for _ in range(VARIANTS)]):
                            x.append(vectors(own).tobytes())
                            y.append(t.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["id", "x", "y"])

    # max_pages ids at most, one page of each, and PIECES runs of RUN blocks of it come back, twice
    one = named.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("page").alias("page"))
    found = one.mapInArrow(run, "id long, x binary, y binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    x = [np.frombuffer(b, np.float32).reshape(-1, DIMS) for b in found["x"].to_pylist()]
    y = [np.frombuffer(b, bool) for b in found["y"].to_pylist()]
    rng = random.Random(5)
    for _ in range(TEMPLATES):
        blocks, labels = template(rng)
        for own, t in ((blocks, labels), varied(blocks, labels, rng)):
            x.append(vectors(own))
            y.append(t)
    return BlockLabeller().fit(x, y)


def extract(pages: DataFrame, labeller: BlockLabeller, markup: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) of each whole page."""
    small_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    model = pages.sparkSession.sparkContext.broadcast(labeller.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockLabeller(model.value)
        for batch in batches:
            source = batch.column(markup).to_pylist()
            for a, b in text_chunks(source):
                blocks = [blocks_of(p) for p in source[a:b]]
                keep = own.label([vectors(x) for x in blocks])
                texts = ["\n".join(x.text for x, k in zip(own_blocks, ks, strict=True) if k) for own_blocks, ks in zip(blocks, keep, strict=True)]
                kept = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
