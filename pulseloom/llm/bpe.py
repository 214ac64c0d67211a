"""Byte-level BPE: encode whole texts into token ids and decode ids into bytes.

Lookup has two tiers. A pre-token (one match of the split pattern) that is in the
vocabulary is resolved whole by a minimal perfect hash. A pre-token that is not is
merged from its bytes: a doubly linked list of byte nodes and a heap of
(rank, position) candidates, always taking the lowest rank, leftmost first.

The vocabulary is fixed, so what is broadcast (keys, displacements, ranks: about
2 MB for 50,256 entries) does not grow with the data. Texts are independent: one
scan, no shuffle, and a lost executor costs only its running tasks.

Defined results: a null or empty text has no ids; columns other than the text pass
through, whatever their names; repeated rows are each encoded; an empty table gives
an empty table. Special tokens are never produced.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
import sys
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import MASK64, BoundedMemo, claim, released, small_batches

_GOLD, _ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Pre-tokens that a worker remembers, and the longest one that it does.
MEMO_ENTRIES, MEMO_CHARS = 500_000, 64


def _slot(high: int, d: int, n: int) -> int:
    return ((((high ^ (d * _GOLD & MASK64)) * _ODD & MASK64) >> 32)) % n


@dataclass
class PerfectHash:
    """Minimal perfect hash (hash and displace): key -> slot in 0..n-1, bijective on the keys."""

    n: int
    displacement: list[int]
    keys: list[bytes] = field(repr=False)  # by slot
    values: list[int] = field(repr=False)  # by slot

    @classmethod
    def build(cls, table: dict[bytes, int], load: int = 3) -> PerfectHash:
        """Buckets of about ``load`` keys, largest first, each tries displacements until its keys
        fall on free slots; single keys take the slots left over, stored as negative numbers."""
        n = len(table)
        names = list(table)
        digests = [xxhash.xxh3_128_intdigest(k) for k in names]
        low = np.array([d & MASK64 for d in digests], np.uint64)
        high = np.array([d >> 64 for d in digests], np.uint64)
        m = max(1, n // load)
        bucket = (low % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        displacement, taken, slot_of = np.zeros(m, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        tries = np.arange(64, dtype=np.uint64) * np.uint64(_GOLD)
        step = np.uint64(64 * _GOLD & MASK64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            members = order[starts[b] : starts[b + 1]]
            at, done = tries, 0
            while True:
                slots = (((high[members][:, None] ^ at) * np.uint64(_ODD)) >> np.uint64(32)) % np.uint64(n)
                free = ~taken[slots.astype(np.int64)].any(axis=0)
                if len(members) > 1:
                    s = np.sort(slots, axis=0)
                    free &= (s[1:] != s[:-1]).all(axis=0)
                if free.any():
                    d = int(np.argmax(free))
                    displacement[b] = done + d
                    slot_of[members] = slots[:, d].astype(np.int64)
                    taken[slots[:, d].astype(np.int64)] = True
                    break
                at, done = at + step, done + 64
        left = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            displacement[b] = -slot - 1
            slot_of[order[starts[b]]] = slot
        keys, values = [b""] * n, [0] * n
        for name, slot in zip(names, slot_of.tolist(), strict=True):
            keys[slot], values[slot] = name, table[name]
        return cls(n, displacement.tolist(), keys, values)

    def get(self, key: bytes) -> int | None:
        """The value of a key, or None for what is not a key (the stored key decides)."""
        digest = xxhash.xxh3_128_intdigest(key)
        d = self.displacement[(digest & MASK64) % len(self.displacement)]
        slot = -d - 1 if d < 0 else _slot(digest >> 64, d, self.n)
        return self.values[slot] if self.keys[slot] == key else None


@dataclass
class Vocabulary:
    """Ranks, tokens by id and the split pattern."""

    hash: PerfectHash
    tokens: dict[int, bytes] = field(repr=False)
    pattern: str

    @classmethod
    def load(cls, spark: SparkSession, path: str, pattern: str) -> Vocabulary:
        """Read ``token-in-base64 rank`` lines. The file is fixed and small; it is read on the driver."""
        try:
            with open(path, "rb") as f:
                lines = f.read().splitlines()
        except FileNotFoundError:
            lines = [r.value.encode() for r in spark.read.text(path).collect()]
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        return cls.of(ranks, pattern)

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        return cls(PerfectHash.build(ranks), {v: k for k, v in ranks.items()}, pattern)


#: Ranges of characters that are letters in Unicode 17 but not in 16, which tiktoken's tables follow.
NEWER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: The same of numbers.
NEWER_NUMBERS = [
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6),
]


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_CONTROL = re.compile("[\x1c-\x1f]")
#: What the standard library's classes do not treat as the pattern's do: texts without such characters take its faster engine.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]")


def _plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern in the standard library's classes, or None where it holds others."""
    p = re.sub(r"\[\^((?:\\[srn])*)\\p\{L\}\\p\{N\}\]", r"(?:[^\1\\w]|_)", pattern)
    p = p.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    try:
        return None if r"\p" in p else re.compile(p)
    except re.error:
        return None


class Encoder:
    """Encodes texts with a vocabulary; one per worker, with bounded memos."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.rank = vocabulary, vocabulary.hash.get
        self.split, self.plain_split = regex.compile(vocabulary.pattern), _plain_pattern(vocabulary.pattern)
        letters, numbers = _class(NEWER_LETTERS), _class(NEWER_NUMBERS)
        self.newer = re.compile(f"[{letters}{numbers}]")
        exact = vocabulary.pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{letters}{numbers}]]")
        exact = re.sub(r"(?<!\[\^\\s)\\p\{L\}(?!\\p\{N\}\])", lambda _: f"[\\p{{L}}--[{letters}]]", exact)
        exact = re.sub(r"(?<!\\p\{L\})\\p\{N\}(?!\])", lambda _: f"[\\p{{N}}--[{numbers}]]", exact)
        self.exact_split = regex.compile("(?V1)" + exact)
        self.single, self.first, self.joined = self._merge_table()
        self.memo = BoundedMemo(self._piece, MEMO_ENTRIES)

    def pieces(self, text: str) -> list[str]:
        if self.plain_split is not None and (text.isascii() and not _CONTROL.search(text) or not _UNUSUAL.search(text)):
            return self.plain_split.findall(text)
        if self.newer.search(text):
            return self.exact_split.findall(text)
        return self.split.findall(text)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.rank(raw)
        return array("I", self.merge(raw) if whole is None else (whole,)).tobytes()

    def _merge_table(self) -> tuple[list[int], list[int], dict[int, int]]:
        """Ids of the 256 bytes, ids of all two bytes (-1 where they are no token), and for each way to cut
        a token into two tokens, left id << 32 | right id -> its id."""
        ids = {raw: i for i, raw in self.vocabulary.tokens.items()}
        joined = {}
        for raw, i in ids.items():
            for cut in range(1, len(raw)):
                if (left := ids.get(raw[:cut])) is not None and (right := ids.get(raw[cut:])) is not None:
                    joined[left << 32 | right] = i
        return [ids[bytes([b])] for b in range(256)], [ids.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], joined

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a byte string that is not itself a token: a heap over linked bytes.

        Heap entries are rank << 40 | position, so the lowest rank comes first and then the leftmost. An
        entry is stale unless its rank is the one that waits at its position."""
        single, first, get, pop, push = self.single, self.first, self.joined.get, heapq.heappop, heapq.heappush
        waits = [first[a << 8 | b] for a, b in itertools.pairwise(raw)]
        ids = [single[b] for b in raw]
        heap = [r << 40 | i for i, r in enumerate(waits) if r >= 0]
        heapq.heapify(heap)
        n = len(raw)
        waits.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFFFF, top >> 40
            if waits[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], waits[j] = rank, -1, -1
            if k < n:
                before[k] = i
                r = waits[i] = get(rank << 32 | ids[k], -1)
                if r >= 0:
                    push(heap, r << 40 | i)
            else:
                waits[i] = -1
            if (p := before[i]) >= 0:
                r = waits[p] = get(ids[p] << 32 | rank, -1)
                if r >= 0:
                    push(heap, r << 40 | p)
        return [i for i in ids if i >= 0]

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.pieces(text)
        if text and max(map(len, pieces)) > MEMO_CHARS:
            return b"".join([self.memo[p] if len(p) <= MEMO_CHARS else self._piece(p) for p in pieces])
        return b"".join(map(self.memo.__getitem__, pieces))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:  # noqa: ANN001
    claim("bpe", _ENCODERS.clear)
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    """A broadcast with a stable id for the workers' memos."""

    def __init__(self, broadcast, key: int) -> None:  # noqa: ANN001
        self.broadcast, self.id = broadcast, key

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def _share(spark: SparkSession, vocabulary: Vocabulary) -> _Shared:
    key = xxhash.xxh3_64_intdigest(repr((vocabulary.pattern, vocabulary.hash.keys, vocabulary.hash.values)).encode())
    return _Shared(spark.sparkContext.broadcast(vocabulary), key)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids_packed", decoded: str | None = None, verified: str | None = None) -> DataFrame:
    """``df`` with ``out`` (binary): the ids of ``text`` as little-endian unsigned 32-bit integers.

    Packed ids are what training shards store; ``unpack_ids`` gives them as an array. With
    ``decoded``, the ids are also decoded, in the same worker, into that column (binary); with
    ``verified``, that column (boolean) says whether they decode to the text's bytes, and no second
    text leaves the worker. Raises if a new column's name is taken.
    """
    fields = [T.StructField(out, T.BinaryType())]
    fields += [T.StructField(name, kind) for name, kind in ((decoded, T.BinaryType()), (verified, T.BooleanType())) if name is not None]
    new = [f.name for f in fields]
    if clash := set(new) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    shared, at = _share(df.sparkSession, vocabulary), df.columns.index(text)

    def run(batches):  # noqa: ANN001, ANN202
        encoder = _encoder(shared)
        tokens = encoder.vocabulary.tokens
        for batch in released(batches):
            texts = [x.as_py() or "" for x in batch.column(at)]
            ids = [encoder.packed(x) for x in texts]
            added = [pa.array(ids, pa.binary())]
            if decoded is not None:
                added.append(pa.array([decode_packed(x, tokens) for x in ids], pa.binary()))
            if verified is not None:
                added.append(pa.array([decode_packed(x, tokens) == t.encode() for x, t in zip(ids, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *new])

    return small_batches(df).mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def decode_packed(packed: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, memoryview(packed).cast("I") if sys.byteorder == "little" else np.frombuffer(packed, "<u4").tolist()))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids_packed", out: str = "decoded") -> DataFrame:
    """``df`` with ``out`` (binary): the bytes that the packed ids stand for; null ids give no bytes.

    An id outside the vocabulary raises: dropping it would change the text silently."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    shared, at = _share(df.sparkSession, vocabulary), df.columns.index(ids)

    def run(batches):  # noqa: ANN001, ANN202
        tokens = shared.value.tokens
        for batch in batches:
            texts = [decode_packed(x.as_py() or b"", tokens) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return small_batches(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def unpack_ids(df: DataFrame, ids: str = "ids_packed", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the packed ids as an array of integers, in JVM expressions."""
    byte = lambda i, k: F.hex(F.substring(F.col(ids), i * 4 + k, F.lit(1)))
    word = lambda i: F.concat(*[byte(i, k) for k in (4, 3, 2, 1)])
    n = (F.octet_length(ids) / 4).cast("int")
    return df.withColumn(out, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(word(i), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>")))
