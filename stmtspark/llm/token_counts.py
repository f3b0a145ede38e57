"""Token counts for a word-end BPE vocabulary with a whole-token shortcut.

``WordCounter`` proves in the driver, once and before any text is read, which vocabulary strings encode
alone as one token; the proven set is broadcast, its size that of the vocabulary.  Each string that ends
a word is contracted by the merge list, and kept if one symbol is left and the split pattern takes it as
one pre-token.  A pre-token in that set counts one without merging; only the rest are merged, each
distinct one once while a worker remembers it.  Words of over 48 symbols are merged with a heap, in the
same order and with the same result.

Counts are those of the tokenizers library without added tokens at the ends; special strings inside
a text are one token each, as the library's default has it.  Null and empty texts count 0.  Rows are
independent: repeated rows count alike, an empty table stays empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stmtspark.llm.common import small_batches, text_chunks
from stmtspark.llm.merging import contract

END = "</w>"
#: Pieces of text, and pre-tokens, that a worker remembers.
CACHE = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordCounter:
    _made: dict[str, WordCounter] = {}

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {m: (i, m[0] + m[1]) for i, m in enumerate(merges)}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        specials = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.letters = byte_letters()
        self.whole = self.prove(model["vocab"]) if whole is None else whole
        self.of_part: dict[str, int] = {}
        self.of_word: dict[str, int] = {}

    @classmethod
    def of(cls, path: str, whole: frozenset[str] | None = None) -> WordCounter:
        if path not in cls._made:
            cls._made[path] = cls(path, whole)
        return cls._made[path]

    def prove(self, vocabulary: dict[str, int]) -> frozenset[str]:
        """The texts of vocabulary strings that encode alone as one token."""
        byte_of = {c: b for b, c in enumerate(self.letters)}
        out = set()
        for token in vocabulary:
            if not token.endswith(END):
                continue
            try:
                text = bytes(byte_of[c] for c in token[: -len(END)]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if text and self.normal(text) == text and self.find(text) == [text] and self.merged(text) == [token]:
                out.add(text)
        return frozenset(out)

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case character by character (no rule looks at neighbours)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merged(self, word: str) -> list[str]:
        symbols = [self.letters[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += END
        if len(symbols) > 48:  # the same order with a heap, as the scan below takes the square of the length
            return contract(symbols, lambda a, b: self.pairs.get((a, b)))
        get, none = self.pairs.get, (1 << 60, "")
        while len(symbols) > 1:
            ranked = [get(p, none) for p in zip(symbols, symbols[1:])]
            best = min(ranked)
            if best is none or best[0] == none[0]:
                break
            i = ranked.index(best)
            symbols[i : i + 2] = [best[1]]
        return symbols

    def count_word(self, word: str) -> int:
        if word in self.whole:
            return 1
        n = self.of_word.get(word)
        if n is None:
            if len(self.of_word) > CACHE:
                self.of_word.clear()
            n = self.of_word[word] = len(self.merged(word))
        return n

    def count_part(self, part: str) -> int:
        """Tokens of a run without spaces, tabs and line feeds."""
        if part in self.whole:
            return 1
        if self.special is not None and "<|" in part and (found := self.special.findall(part)):
            return len(found) + sum(self.count_part(p) for p in self.special.split(part) if p)
        return sum(map(self.count_word, self.find(self.normal(part))))

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.of_part) > CACHE:
            self.of_part.clear()
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") if t else [] for t in texts]
        known = self.of_part
        for part in set().union(*split).difference(known):
            known[part] = self.count_part(part) if part else 0
        return [sum(map(known.__getitem__, parts)) for parts in split]


def _count(batches: Iterator[pa.RecordBatch], text: str, path: str, whole: frozenset[str]) -> Iterator[pa.RecordBatch]:
    counter = WordCounter.of(path, whole)
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for a, b in text_chunks(texts):
            kept = batch.slice(a, b - a)
            counts = pa.array(np.array(counter.count(texts[a:b]), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*kept.columns, counts], names=[*kept.schema.names, "n_tokens"])


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); existing ones are replaced."""
    small_batches(df.sparkSession)
    df = df.drop("n_tokens", "n_bytes", "over_limit")
    schema = StructType([*df.schema.fields, StructField("n_tokens", LongType())])
    whole = df.sparkSession.sparkContext.broadcast(WordCounter.of(path).whole)
    out = df.mapInArrow(lambda it: _count(it, text, path, whole.value), schema)
    return out.select(*df.columns, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
