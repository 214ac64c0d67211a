"""LM scoring: stupid-backoff scores of each document by the n-gram counts of all others.

Documents are dealt to groups of about GROUP_BYTES of text by their key's hash. Each group explodes its
n-grams (orders 1 to ``order``) and sends its distinct hashes with their counts to the count table,
which is partitioned by the hash; each partition sums the counts, joins the sums to the requests by
merging sorted arrays, and sends back to the groups what other groups have. There each document's n-grams get their
counts, less the document's own, and the scores are summed per document.

A group asks once for an n-gram however many of its documents hold it, so a word that is in every
document costs one entry a group, and partitions are even. The hashes that a group sends to one range of
the table travel as one row, in packed form; rows are never more than distinct n-grams, whatever the size.
N-grams are told apart by 56 bits (two of the 3e8 different ones in 0.5 GB share them in less than one expected
case, one in 2,000 does at 100 TB). Texts are shuffled once. Nothing but two sums (bytes and words) reaches the driver.

score of a word = c(n-gram) / c(its first n - 1 words) for the longest n-gram with c > 0, times
ALPHA for each shorter step; a word that no other document has gets 1 / (words of others + 1).

Defined results: null and empty texts have no words and a null mean; rows that share a key (nulls too) are documents
of their own; an empty table gives an empty table; columns other than key and text are not looked at. A group
is held in a task's memory: GROUP_BYTES of text, or one text if that is longer.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import BoundedMemo, claim, mix64

ALPHA = 0.4
GROUP_BYTES, PARTITION_NGRAMS = 12 << 20, 3_000_000
_MEMO = BoundedMemo(lambda w: xxhash.xxh3_64_intdigest(w), 200_000)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII white space."""
    return text.encode().lower().split()


def ngram_hashes(text: str, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n-gram that ends at each word (0 where fewer words precede)."""
    words = words_of(text)
    h = np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))
    out = [mix64(h + np.uint64(1))]
    for n in range(2, order + 1):
        g = np.zeros(len(h), np.uint64)
        g[n - 1 :] = mix64(out[-1][n - 2 : -1] * _PRIME + h[n - 1 :] + np.uint64(n)) if len(h) >= n else 0
        out.append(g)
    return out


def packed(keys: np.ndarray) -> bytes:
    """Sorted distinct hashes: low bytes as they are, the rest as gaps in unary."""
    n, span = len(keys), int(keys[-1] - keys[0])
    low = min(range(1, 8), key=lambda k: n * k + ((span >> (8 * k)) + n) / 8)
    x = keys - keys[0]
    marks = np.zeros((span >> (8 * low)) + n, np.uint8)
    marks[(x >> np.uint64(8 * low)).astype(np.int64) + np.arange(n)] = 1
    head = np.array([keys[0], n, low], "<u8").tobytes()
    return head + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low]).tobytes() + np.packbits(marks).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    first, n, low = (int(v) for v in np.frombuffer(raw, "<u8", 3))
    x = np.zeros((n, 8), np.uint8)
    x[:, :low] = np.frombuffer(raw, np.uint8, n * low, 24).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, -1, 24 + n * low)))[:n] - np.arange(n)
    return x.reshape(-1).view("<u8") + (high.astype(np.uint64) << np.uint64(8 * low)) + np.uint64(first)


def packed_counts(counts: np.ndarray, usual: int) -> bytes:
    """Counts: a bit each for those that are not ``usual``, which follow in a byte each; those of 255 or more whole."""
    other = counts[counts != usual]
    large = other[other >= 255].astype("<u8")
    return np.packbits(counts != usual).tobytes() + np.minimum(other, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpacked_counts(raw: bytes, n: int, usual: int) -> np.ndarray:
    marks = -(-n // 8)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, marks), count=n))
    other = np.frombuffer(raw, np.uint8, len(at), marks).astype(np.int64)
    other[other == 255] = np.frombuffer(raw, "<u8", -1, marks + len(at))
    out = np.full(n, usual, np.int64)
    out[at] = other
    return out


def group_hashes(texts: list[str], order: int) -> tuple[list[int], np.ndarray]:
    """Number of words of each text, and 56 bits of the hashes of its n-grams, by text and then by order."""
    claim("lm", _MEMO.clear)
    sizes, every = [], [np.empty(0, np.uint64)]
    for t in texts:
        grams = ngram_hashes(t, order)
        sizes.append(len(grams[0]))
        every += [g[n:] for n, g in enumerate(grams)]
    return sizes, np.concatenate(every) >> np.uint64(8)


def text_scores(sizes: list[int], at: np.ndarray, totals: np.ndarray, words: int, order: int) -> list[tuple[int, float]]:
    """(number of words, sum of log10 scores) of each text; ``at`` says where each n-gram's total is, and a text's
    own counts are taken off."""
    out, done = [], 0
    for n_words in sizes:
        if not n_words:
            out.append((0, 0.0))
            continue
        others = []
        for n in range(1, order + 1):
            c = np.zeros(n_words, np.int64)
            if n_words >= n:
                own = at[done : done + n_words - n + 1]
                done += len(own)
                u, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
                c[n - 1 :] = totals[own] - (count[inverse] if len(u) < len(own) else 1)
            others.append(c)
        rest = max(words - n_words, 0)
        score = np.where(others[0] > 0, others[0] / max(rest, 1), 1 / (rest + 1))
        score = np.minimum(score, 1.0)
        for n in range(2, order + 1):
            c = others[n - 1]
            before = np.ones(n_words, np.int64)
            before[1:] = np.maximum(others[n - 2][:-1], 1)
            reach = np.arange(n_words) >= n - 1
            score = np.where(reach, np.where(c > 0, np.minimum(c / before, 1.0), ALPHA * score), score)
        out.append((n_words, float(np.log10(score).sum())))
    return out


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """(key, n_words, log10_score, mean_log10_score) of each row; the registered query takes order 3."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def sizes(batches):  # noqa: ANN001, ANN202
        b = w = 0
        for batch in batches:
            for cell in batch.column(0):
                raw = cell.as_py().encode()
                b, w = b + len(raw), w + len(raw.split())
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([w], pa.int64())], names=["b", "w"])

    size, words = docs.select("text").mapInArrow(sizes, "b long, w long").agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    groups = max(1, -(-size // GROUP_BYTES))
    buckets = max(1, -(-words * order // PARTITION_NGRAMS))
    # By key and text: rows that share a key (nulls, say) are spread like any others.
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("key", "text"), F.lit(groups)).cast("int"))

    def cells(keys: np.ndarray) -> tuple[list[int], list[int]]:
        """The buckets (ranges of the hash's upper half) that sorted hashes fall into, and where each starts and the last ends."""
        b = ((keys >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)
        at = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1]) if len(b) else np.empty(0, np.int64)
        return b[at].tolist(), [*at.tolist(), len(b)]

    def request(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(group_hashes(table.column("text").to_pylist(), order)[1], return_counts=True)
        b, at = cells(keys)
        g = table.column("g")[0].as_py()
        return pa.table(
            {
                "g": pa.array([g] * len(b), pa.int32()), "bucket": pa.array(b, pa.int64()),
                "hashes": pa.array([packed(keys[x:y]) for x, y in itertools.pairwise(at)], pa.binary()), "counts": pa.array([packed_counts(counts[x:y], 1) for x, y in itertools.pairwise(at)], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        hashes = [unpacked(x.as_py()) for x in table.column("hashes")]
        counts = np.concatenate([unpacked_counts(x.as_py(), len(h), 1) for x, h in zip(table.column("counts"), hashes, strict=True)])
        keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        elsewhere = np.bincount(inverse, counts, len(keys)).astype(np.int64)[inverse] - counts
        parts = np.split(elsewhere, np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table({"g": table.column("g"), "bucket": table.column("bucket"), "elsewhere": pa.array([packed_counts(p, 0) for p in parts], pa.binary())})

    def sum_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, every = group_hashes(texts.column("text").to_pylist(), order)
        keys, place, totals = np.unique(every, return_inverse=True, return_counts=True)
        del every
        b, at = cells(keys)
        where = dict(zip(b, itertools.pairwise(at), strict=True))
        for bucket, raw in zip(answers.column("bucket").to_pylist(), answers.column("elsewhere"), strict=True):
            x, y = where[bucket]
            totals[x:y] += unpacked_counts(raw.as_py(), y - x, 0)
        found = text_scores(sizes, place, totals, words, order)
        return pa.table({"key": texts.column("key"), "n_words": pa.array([n for n, _ in found], pa.int64()), "log10_score": pa.array([s for _, s in found], pa.float64())})

    requests = dealt.groupBy("g").applyInArrow(request, "g int, bucket long, hashes binary, counts binary")
    answers = requests.groupBy("bucket").applyInArrow(answer, "g int, bucket long, elsewhere binary")
    scored = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(sum_up, f"key {kind}, n_words long, log10_score double")
    return scored.select(F.col("key").alias(key), "n_words", "log10_score", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")).alias("mean_log10_score"))
