"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A task splits its texts into pre-tokens and gives each distinct piece it has not met yet to DuckDB
as token-position rows.  A recursive query joins neighbouring rows with the merge table, contracts
the leftmost pair of minimum rank of every piece, and repeats until no piece has a pair left.
Decoding is another query over the ids that were put together for each document: the rows of its ids
join the vocabulary, and an ordered aggregation makes their bytes.

A recursive query keeps the rows of all its steps, so pieces go to it in groups of QUERY_ROWS rows
times steps.  A piece that is longer than LONG_PIECE bytes is contracted in spans of SPAN bytes by the same
query, and mended where spans meet (``_contract_long``): a row of tokens is the contraction of its bytes if
each two neighbours, taken alone, contract to themselves.

Nulls and empty texts give no ids and empty bytes.  Rows are independent of each other, so ties and
repeated rows need no rule; an empty table gives an empty table.  Very long texts and pieces are split,
contracted and decoded in parts of a bounded size.  Other columns pass through, except that existing columns named
``ids`` and ``decoded`` are replaced.  An id that is not in the vocabulary is an error.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from stmtspark.llm.common import list_array, small_batches, text_chunks, tidied

#: Bytes up to which pieces are contracted whole, one pair of each in a step, and bytes of a span of longer ones.
LONG_PIECE, SPAN = 64, 48
#: Position rows times steps that one recursive query may hold.
QUERY_ROWS = 4_000_000
#: Pieces in each of a worker's two generations of remembered pieces, about 200 bytes each; contracting one anew takes most of its time.
CACHE = 250_000
#: Parts of long pieces, and a quarter of the pairs of tokens, that a worker remembers.
PARTS = 80_000
#: Characters that are split into pieces at once, and ids that one row of the decoding query holds.
SPLIT_CHARS, DECODE_IDS = 1_000_000, 65_536
#: A position row's place is w << SHIFT | pos.
SHIFT = 40
_MASK = (1 << SHIFT) - 1

CONTRACT = f"""
WITH RECURSIVE state AS (
  SELECT g, tok, false AS done FROM start
  UNION ALL
  (WITH ranked AS MATERIALIZED (
     SELECT g, tok, ng, rank FROM
       (SELECT g, tok, lead(g) OVER win AS ng, (tok::BIGINT << 20) | lead(tok) OVER win AS k
        FROM state WHERE NOT done WINDOW win AS (ORDER BY g))
       LEFT JOIN merges USING (k)),
   best AS (SELECT g >> {SHIFT} AS w, min((rank::BIGINT << {SHIFT}) | (g & {_MASK})) AS b, arg_min(ng, (rank::BIGINT << {SHIFT}) | (g & {_MASK})) AS gone
            FROM ranked WHERE rank IS NOT NULL AND ng >> {SHIFT} = g >> {SHIFT} GROUP BY 1)
   SELECT g, CASE WHEN g & {_MASK} = b & {_MASK} THEN (b >> {SHIFT})::INT ELSE tok END, b IS NULL
   FROM ranked LEFT JOIN best ON g >> {SHIFT} = w WHERE b IS NULL OR g <> gone)
)
SELECT g, tok, done FROM state WHERE done ORDER BY g
"""

DECODE = f"""
SELECT g >> {SHIFT} AS w, string_agg(hex, '' ORDER BY g) AS hex FROM ids JOIN vocabulary USING (tok) GROUP BY 1 ORDER BY 1
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _places(lengths: np.ndarray) -> np.ndarray:
    """w << SHIFT | pos of runs of the given lengths."""
    starts = np.cumsum(lengths) - lengths
    return (np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) << SHIFT) | (np.arange(lengths.sum()) - np.repeat(starts, lengths))


#: A single space between two other characters always starts a match of the pattern.
_SAFE = re.compile(r"\S \S").search


def segments(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters that no match of the pattern spans."""
    at = 0
    while len(text) - at > size and (m := _SAFE(text, at + size)) is not None:
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


class PieceCoder:
    """Encodes and decodes pre-tokens, one per Python worker and rank file."""

    _made: dict[tuple[str, str], PieceCoder] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.byte_rank = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        parts = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = np.array(parts, dtype=np.int64).T if parts else np.zeros((3, 0), dtype=np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": "", "preserve_insertion_order": False})
        merges = pa.table({"k": (left << 20) | right, "rank": rank.astype(np.int32)})
        vocabulary = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.known = np.zeros(1 + max(self.ranks.values(), default=0), dtype=bool)
        self.known[list(self.ranks.values())] = True
        self.whole = {p: np.int32(r).tobytes() for p, r in self.ranks.items()}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.stays: dict[tuple[int, int], bool] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> PieceCoder:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def _query(self, name: str, g: np.ndarray, tok: np.ndarray, sql: str, **given: int) -> pa.Table:
        self.db.register(name, pa.table({"g": g, "tok": tok}))
        try:
            return self.db.sql(sql, params=given or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of short pieces."""
        out = self._query("start", _places(np.array([len(p) for p in pieces])), self.byte_rank[np.frombuffer(b"".join(pieces), dtype=np.uint8)], CONTRACT)
        return _unpacked(out["g"].to_numpy(), out["tok"].to_numpy(), len(pieces))

    def _all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many short pieces, each unlike one contracted once, in groups of bounded rows."""
        found, group, rows = {}, [], 0
        unlike = sorted(set(pieces), key=len)
        for i, p in enumerate(unlike):
            group.append(p)
            rows += len(p) ** 2
            if rows > QUERY_ROWS or i + 1 == len(unlike):
                found.update(zip(group, (np.frombuffer(x, np.int32).tolist() for x in self._contract(group)), strict=True))
                group, rows = [], 0
        return [found[p].copy() for p in pieces]

    def _meet(self, pairs: set[tuple[int, int]]) -> None:
        """Find out which pairs of tokens stay as they are when they stand side by side."""
        new = [x for x in pairs if x not in self.stays]
        if len(self.stays) > 4 * PARTS:
            self.stays.clear()
            new = list(pairs)
        if new:
            self.stays.update((x, own == list(x)) for x, own in zip(new, self._all([self.bytes_of[a] + self.bytes_of[b] for a, b in new]), strict=True))

    def _stays(self, a: int, b: int) -> bool:
        if (a, b) not in self.stays:
            self._meet({(a, b)})
        return self.stays[a, b]

    def _contract_long(self, piece: bytes) -> bytes:
        """Packed ids of a piece of any length.

        A row of tokens is what the contraction gives if each two neighbours, taken alone, contract to themselves.  So
        the piece is contracted in spans, all at once; where two spans' end tokens don't stay as they are, a few
        tokens on either side are contracted anew, first for all such places together, then one after the other.
        """
        spans = self._all([piece[i : i + SPAN] for i in range(0, len(piece), SPAN)])
        self._meet({(x[-1], y[0]) for x, y in zip(spans, spans[1:])})
        text = lambda ids: b"".join([self.bytes_of[i] for i in ids])
        for k in (2, 4, 6):
            # both spans must keep tokens beyond the k that the places on either side may take
            bad = [i for i in range(len(spans) - 1) if not self.stays[spans[i][-1], spans[i + 1][0]] and len(spans[i]) > 2 * k and len(spans[i + 1]) > 2 * k]
            anew = self._all([text(spans[i][-k:] + spans[i + 1][:k]) for i in bad])
            self._meet({x for i, r in zip(bad, anew, strict=True) for x in ((spans[i][-k - 1], r[0]), (r[-1], spans[i + 1][k]))})
            for i, r in zip(bad, anew, strict=True):
                if self.stays[spans[i][-k - 1], r[0]] and self.stays[r[-1], spans[i + 1][k]]:
                    half = max(1, len(r) // 2)
                    spans[i][-k:], spans[i + 1][:k] = r[:half], r[half:]
            self._meet({(x[-1], y[0]) for x, y in zip(spans, spans[1:])})
        out = spans[0]
        for own in spans[1:]:
            if not self._stays(out[-1], own[0]):
                left = right = 1
                while True:
                    left, right = min(left, len(out)), min(right, len(own))
                    part = text(out[-left:] + own[:right])
                    if part not in self.parts:
                        if len(self.parts) > PARTS:
                            self.parts.clear()
                        self.parts[part] = self._all([part])[0]
                    r = self.parts[part]
                    fits_left = left == len(out) or self._stays(out[-left - 1], r[0])
                    fits_right = right == len(own) or self._stays(r[-1], own[right])
                    if fits_left and fits_right:
                        break
                    left, right = left + (0 if fits_left else left + 1), right + (0 if fits_right else right + 1)
                out[-left:] = r
                own = own[right:]
            out += own
        return np.array(out, dtype=np.int32).tobytes()

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; a piece that is in the vocabulary is that token."""
        out = list(map(self.whole.get, pieces))
        rest = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(pieces[i]))
        group, rows = [], 0
        for i in rest:
            if len(pieces[i]) > LONG_PIECE:
                out[i] = self._contract_long(pieces[i])
                continue
            group.append(i)
            rows += len(pieces[i]) ** 2
            if rows > QUERY_ROWS:
                for k, ids in zip(group, self._contract([pieces[g] for g in group]), strict=True):
                    out[k] = ids
                group, rows = [], 0
        if group:
            for k, ids in zip(group, self._contract([pieces[g] for g in group]), strict=True):
                out[k] = ids
        return out

    def decode(self, flat: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids; an id outside the vocabulary is an error."""
        if not len(flat):
            return [b""] * len(lengths)
        if flat.min() < 0 or flat.max() >= len(self.known) or not self.known[flat].all():
            raise ValueError("an id is not in the vocabulary")
        # runs are cut into parts, so that no row of the result is unbounded
        parts = np.maximum(1, -(-lengths // DECODE_IDS))
        last = np.cumsum(parts)
        sizes = np.full(last[-1], DECODE_IDS)
        sizes[last - 1] = lengths - (parts - 1) * DECODE_IDS
        back = [b""] * len(sizes)
        ends = np.cumsum(sizes)
        a = 0
        while a < len(sizes):  # about eight parts' rows in one query
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 8 * DECODE_IDS, side="right")))
            begin = int(ends[a] - sizes[a])
            found = self._query("ids", _places(sizes[a:b]), flat[begin : ends[b - 1]], DECODE)
            for w, h in zip(found["w"].to_pylist(), found["hex"].to_pylist(), strict=True):
                back[a + w] = bytes.fromhex(h)
            a = b
        return [back[i] if k == 1 else b"".join(back[i : i + k]) for i, k in zip((last - parts).tolist(), parts.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Put the packed ids of the pieces into the young generation."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        new = pieces.difference(self.young)
        for p in new.intersection(self.old):
            self.young[p] = self.old[p]
        new = list(new.difference(self.old))
        if new:
            self.young.update(zip(new, self.encode([p.encode("utf-8", "replace") for p in new]), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [[self.find(part) for part in segments(t)] for t in texts]
        self.learn({p for own in split for part in own for p in part} if len(split) < 8 else set().union(*(part for own in split for part in own)))
        of = self.young.__getitem__
        return [b"".join([b"".join(map(of, part)) for part in own]) for own in split]


def _unpacked(g: np.ndarray, tok: np.ndarray, n: int) -> list[bytes]:
    """The packed ids of each of n pieces from sorted position rows."""
    data = tok.astype(np.int32).tobytes()
    ends = (4 * np.searchsorted(g, np.arange(1, n + 1, dtype=np.int64) << SHIFT)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _encoded(batches: Iterator[pa.RecordBatch], text: str, path: str, pattern: str, back: bool) -> Iterator[pa.RecordBatch]:
    coder = PieceCoder.of(path, pattern)
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for a, b in text_chunks(texts):
            packed = coder.ids([t or "" for t in texts[a:b]])
            lengths = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            flat = np.frombuffer(b"".join(packed), dtype=np.int32)
            kept = batch.slice(a, b - a)
            columns, names = [*kept.columns, list_array(flat, lengths)], [*kept.schema.names, "ids"]
            if back:
                columns, names = [*columns, pa.array(coder.decode(flat, lengths), pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _with(df: DataFrame, *fields: tuple[str, object]) -> StructType:
    return StructType([*df.schema.fields, *(StructField(n, t) for n, t in fields)])


def bpe_round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) of each text and ``decoded`` (binary), those ids turned back."""
    small_batches(df.sparkSession)
    df = df.drop("ids", "decoded")
    schema = _with(df, ("ids", ArrayType(IntegerType())), ("decoded", BinaryType()))
    return df.mapInArrow(lambda it: tidied(_encoded(it, text, path, pattern, True)), schema)


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``, the token ids of each text."""
    df = df.drop("ids", "decoded")
    return df.mapInArrow(lambda it: tidied(_encoded(it, text, path, pattern, False)), _with(df, ("ids", ArrayType(IntegerType()))))


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of each id list (null: empty)."""
    df = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = part.column(ids)
                lengths = np.nan_to_num(own.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                back = coder.decode(own.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lengths)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary())], names=[*part.schema.names, "decoded"])

    return df.mapInArrow(run, _with(df, ("decoded", BinaryType())))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a round trip."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
