"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity bands by language.

The language models are modified Kneser-Ney over three-grams of bytes (A-Z lower-cased), one for each
language. Spark counts the three-grams of every whole document, summed by batch and task before the
shuffle, and fits each language in a task of its own. A model is stored as sorted hash arrays (one
of keys and one of values for each order), and every score is looked up there: a batch's distinct three-grams by
binary search, once a batch. A language has at most 256 ** 3 three-grams, whatever the size of the corpus
(the given tables: about 20,000). Models are broadcast in lots of at most LOT_BYTES (or one model); beyond one
lot, each lot's languages are measured by a scan of their own.

A document's perplexity (the median of its segments') is judged against its language's band, from the
corpus-wide quartiles of the rounded logarithms of all different texts that pass the base rules (copies count
once, or a large group of them would set the band): rejected are those under ``q1 - low * (q3 - q1)`` (boilerplate, loops) or over ``q3 + high * (q3 - q1)`` (noise).

Defined results: a null text counts as empty; fewer than MIN_WORDS words fail the base rules;
a null language is '' and a language like any other; repeated rows, and rows that share a key (nulls too), are
each judged by their own text and each returned; empty tables give empty tables. Texts are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import BoundedMemo, claim, cut, mix64, released, small_batches, store

SYMBOLS_OF_TEXT = 256
MIN_WORDS = 50
#: Bytes of a segment; a document's perplexity is the median of its segments'.
SEGMENT = 200
#: Least quartile spread in natural log units, for corpora without spread, and the bands' widths in spreads.
LEAST_SPREAD = 0.02
LOW, HIGH = 3.0, 2.0
#: Bytes of models that are broadcast at once, and bands that are broadcast.
LOT_BYTES, BROADCAST_BANDS = 64 << 20, 10_000
#: Three-grams that a task holds before it sends its sums on.
HELD = 1 << 21
SYMBOLS = b"#*$%&|<>"
CODES = SYMBOLS_OF_TEXT**3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def trigram_codes(raw: bytes) -> np.ndarray:
    """A code in 0..256**3-1 for each byte: it and the two before it (zeros before the text)."""
    c = np.zeros(len(raw) + 2, np.int32)
    c[2:] = _FOLD[np.frombuffer(raw, np.uint8)]
    return (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]


class _Scratch:
    """A place for each code, one a worker: distinct codes and a lookup by code without sorting."""

    seen: np.ndarray | None = None
    place: np.ndarray | None = None

    @classmethod
    def distinct(cls, codes: np.ndarray) -> np.ndarray:
        if cls.seen is None:
            cls.seen = np.zeros(CODES, bool)
        cls.seen[codes] = True
        found = np.flatnonzero(cls.seen) if len(codes) > 100_000 else np.unique(codes)
        cls.seen[found] = False
        return found

    @classmethod
    def spread(cls, codes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """An array whose item ``codes[i]`` is ``values[i]``; other items are left over from before."""
        if cls.place is None:
            cls.place = np.zeros(CODES, np.float32)
        out = cls.place.view(values.dtype)
        out[codes] = values
        return out

    @classmethod
    def clear(cls) -> None:
        cls.seen = cls.place = None


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = _Scratch.distinct(codes)
    at = _Scratch.spread(found, np.arange(len(found), dtype=np.int32))[codes]
    return found, np.bincount(at, minlength=len(found))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def count_trigrams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, code, n) over all documents, summed in each task before the shuffle."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))

    def run(batches):  # noqa: ANN001, ANN202
        claim("quality", _release)
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def flush():  # noqa: ANN202
            for name, parts in sums.items():
                codes, n = _added(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(n)], names=["lang", "code", "n"])
            sums.clear()

        for batch in released(batches):
            of: dict[str, list[np.ndarray]] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if raw := (text.as_py() or "").encode():
                    of.setdefault(name, []).append(trigram_codes(raw))
            for name, codes in of.items():
                parts = sums.setdefault(name, [])
                parts.append(_counts(np.concatenate(codes)))
                held += len(parts[-1][0])
            if held > HELD:
                for name, parts in sums.items():
                    sums[name] = [_added(parts)]
                held = sum(len(p[0][0]) for p in sums.values())
                if held > HELD // 2:
                    yield from flush()
                    held = 0
        yield from flush()

    return small_batches(docs).mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(x, 0.05), k + 0.95)) for k, x in enumerate(d))


def key_of(codes: np.ndarray, order: int) -> np.ndarray:
    return mix64(codes.astype(np.uint64) * np.uint64(4) + np.uint64(order))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted keys are there, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


@dataclass
class KneserNey:
    """Modified Kneser-Ney three-gram model in sorted hash arrays, by order 1..3: n-grams with log probabilities,
    and their contexts with the logarithm of the weight that goes to the lower order."""

    keys: list[np.ndarray] = field(repr=False)
    logp: list[np.ndarray] = field(repr=False)
    left_keys: list[np.ndarray] = field(repr=False)
    left: list[np.ndarray] = field(repr=False)

    @classmethod
    def fit(cls, codes: np.ndarray, n: np.ndarray) -> KneserNey:
        """Of the distinct three-grams and their counts; lower orders count distinct bytes before an n-gram."""
        grams: list[tuple[np.ndarray, np.ndarray]] = [(codes.astype(np.int64), n.astype(np.int64))]
        for width in (2, 1):
            grams.insert(0, np.unique(grams[0][0] & ((1 << 8 * width) - 1), return_counts=True))
        model = cls([], [], [], [])
        below = np.full(1, 1.0 / SYMBOLS_OF_TEXT)  # probabilities of the order below, by its sorted codes
        below_codes = np.zeros(1, np.int64)
        for order, (g, c) in enumerate(grams, 1):
            d = np.array([0.0, *_discounts(c)])[np.minimum(c, 3)]
            context, at = np.unique(g >> 8, return_inverse=True)
            total, rest = np.bincount(at, c), np.bincount(at, d)
            weight = rest / total
            lower = below[np.searchsorted(below_codes, g & ((1 << 8 * (order - 1)) - 1))]
            p = (c - d) / total[at] + weight[at] * lower
            for codes_, values, keys_, out in ((g, p, model.keys, model.logp), (context, weight, model.left_keys, model.left)):
                k = key_of(codes_, order)
                by = np.argsort(k)
                keys_.append(k[by])
                out.append(np.log(np.maximum(values[by], 1e-12)).astype(np.float32))
            by = np.argsort(g)
            below, below_codes = p[by], g[by]
        return model

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of P(last byte | the two before it) for three-gram codes."""
        out = np.full(len(codes), -np.log(SYMBOLS_OF_TEXT))
        for order in (1, 2, 3):
            part = codes.astype(np.int64) & ((1 << 8 * order) - 1)
            known, at = _find(self.left_keys[order - 1], key_of(part >> 8, order))
            out = out + np.where(known, self.left[order - 1][at] if len(self.left[order - 1]) else 0.0, 0.0)
            hit, at = _find(self.keys[order - 1], key_of(part, order))
            out = np.where(hit, self.logp[order - 1][at] if len(self.logp[order - 1]) else 0.0, out)
        return out

    def arrays(self) -> list[np.ndarray]:
        return [*self.keys, *self.logp, *self.left_keys, *self.left]

    @classmethod
    def of(cls, parts: list[bytes]) -> KneserNey:
        a = [np.frombuffer(x, np.uint64 if k // 3 % 2 == 0 else np.float32) for k, x in enumerate(parts)]
        return cls(a[:3], a[3:6], a[6:9], a[9:])


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, size, parts): the model of each language that has text, as the bytes of its sorted hash arrays. Stored."""

    def fit(rows: pa.Table) -> pa.Table:
        model = KneserNey.fit(rows.column("code").to_numpy(), rows.column("n").to_numpy())
        parts = [a.tobytes() for a in model.arrays()]
        return pa.table({"lang": rows.column("lang")[:1], "size": pa.array([sum(map(len, parts))], pa.int64()), "parts": pa.array([parts], pa.list_(pa.binary()))})

    return store(count_trigrams(df, text, lang).groupBy("lang").applyInArrow(fit, "lang string, size long, parts array<binary>"))


def lots(models: DataFrame, most: int = LOT_BYTES) -> list[list[str]]:
    """Languages whose models are broadcast together: each lot has at most ``most`` bytes, or one model."""
    out: list[list[str]] = []
    room = 0
    for r in models.select("lang", "size").orderBy("size", "lang").toLocalIterator():
        if not out or r["size"] > room:
            out.append([])
            room = most
        out[-1].append(r["lang"])
        room -= r["size"]
    return out


def segment_median(logp: np.ndarray) -> float:
    """Log perplexity of a text: the median of its segments' means, so that one quoted passage in
    another language doesn't decide. Segments are equal and of SEGMENT to 2 * SEGMENT bytes."""
    k = max(1, len(logp) // SEGMENT)
    cuts = np.arange(k + 1) * len(logp) // k
    return -float(np.median(np.add.reduceat(logp, cuts[:-1], dtype=np.float64) / np.diff(cuts)))


_MODELS: dict[str, dict[str, KneserNey]] = {}
_WORDS = BoundedMemo(lambda w: xxhash.xxh3_64_intdigest(w), 120_000)


def _release() -> None:
    _MODELS.clear()
    _WORDS.clear()
    _Scratch.clear()


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its UTF-8 bytes."""
    words = raw.split()
    n = len(words)
    b = np.frombuffer(raw, np.uint8)
    word_chars = len(text) - int(np.count_nonzero(_SPACE[b]))
    symbols = int(np.count_nonzero(_SYMBOL[b]))
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
    repeat = 0
    if n >= 4:
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
        k = mix64(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix64(h[1:-1] * np.uint64(3) + mix64(h[2:])))
        s = np.sort(k)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            at = np.isin(k, twice)
            cover = np.zeros(n, bool)
            cover[:-2] |= at
            cover[1:-1] |= at
            cover[2:] |= at
            repeat = int(cover.sum())
    return n, word_chars, symbols, dup, repeat


STATS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("log_perplexity", T.DoubleType())]


def log_perplexities(names: list[str], raws: list[bytes], models: dict[str, KneserNey]) -> list[float]:
    """Of each text under its language's model; a text without bytes has 0."""
    out = [0.0] * len(raws)
    of: dict[str, list[int]] = {}
    for k, (name, raw) in enumerate(zip(names, raws, strict=True)):
        if raw:
            of.setdefault(name, []).append(k)
    for name, rows in of.items():
        codes = [trigram_codes(raws[k]) for k in rows]
        every = np.concatenate(codes)
        found = _Scratch.distinct(every)
        logp = _Scratch.spread(found, models[name].log_probability(found).astype(np.float32))[every]
        at = 0
        for k, c in zip(rows, codes, strict=True):
            out[k] = round(segment_median(logp[at : at + len(c)]), 4)
            at += len(c)
    return out


def _measured(df: DataFrame, models: dict[str, KneserNey], text: str, lang: str, drop_text: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(models)
    tag = uuid.uuid4().hex
    at, by = df.columns.index(text), df.columns.index(lang)
    kept = [k for k in range(len(df.columns)) if not drop_text or k != at]
    fields = [*(df.schema.fields[k] for k in kept), *STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _release)
        if tag not in _MODELS:
            _MODELS.clear()
            _MODELS[tag] = shared.value
        for batch in released(batches):
            texts = [x.as_py() or "" for x in batch.column(at)]
            raws = [t.encode() for t in texts]
            names = ["" if x is None else str(x) for x in batch.column(by).to_pylist()]
            counts = [base_counts(t, raw) for t, raw in zip(texts, raws, strict=True)]
            columns = list(zip(*counts, strict=True)) if counts else [()] * 5
            arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array(log_perplexities(names, raws, _MODELS[tag]), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *arrays], names=[f.name for f in fields])

    return small_batches(df).mapInArrow(run, T.StructType(fields))


def measure(df: DataFrame, models: DataFrame, text: str = "text", lang: str = "lang", drop_text: bool = True) -> DataFrame:
    """The rows of ``df`` with the five counts and log_perplexity: one scan a lot of models, no shuffle."""
    name = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    parts = []
    found = lots(models)
    for lot in found or [[]]:
        rows = models.where(F.col("lang").isin(lot)).collect() if lot else []
        some = {r["lang"]: KneserNey.of([bytes(p) for p in r["parts"]]) for r in rows}
        # Rows of a language without a model have no text; they go with the first lot.
        own = df if len(found) < 2 else df.where(name.isin(lot) if parts else ~name.isin([x for other in found[1:] for x in other]))
        parts.append(_measured(own, some, text, lang, drop_text))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NEW = [*(f.name for f in STATS), "base_failed", "band_low", "band_high", "kept"]


def judge(df: DataFrame, text: str = "text", lang: str = "lang", low: float = LOW, high: float = HIGH, models: DataFrame | None = None, drop_text: bool = True) -> DataFrame:
    """One row for each row of ``df``, with the five counts, log_perplexity, base_failed, the band and kept (and
    without the text unless ``drop_text`` is false). Raises if a new column's name is taken.

    base_failed: fewer than MIN_WORDS words, or more than half of them in repeated three-word
    windows. kept: not base_failed and within the band of the language."""
    if clash := set(NEW) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    models = train(df, text, lang) if models is None else models
    rows = measure(df, models, text, lang, drop_text).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = store(rows)
    name = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    # Exact percentiles of values rounded to 1e-4: a bounded number of distinct values, the same however tasks are dealt.
    counts = [f.name for f in STATS]
    quart = rows.where(~F.col("base_failed")).select(name.alias("__of"), *counts).distinct().groupBy("__of").agg(F.percentile("log_perplexity", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))
    bands = cut(quart.select("__of", (F.col("q")[0] - low * spread).alias("band_low"), (F.col("q")[1] + high * spread).alias("band_high")))
    out = rows.join(F.broadcast(bands) if bands.count() <= BROADCAST_BANDS else bands, name == F.col("__of"), "left")
    inside = F.col("log_perplexity").between(F.col("band_low"), F.col("band_high"))
    return out.drop("__of").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
