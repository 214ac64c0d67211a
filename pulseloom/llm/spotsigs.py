"""Document fingerprints: SpotSigs.

A spot signature starts at an anchor (a common word) and is the chain of the next CHAIN
content words. A document's fingerprint is the set of its signatures' 32-bit hashes, written
as sorted hexadecimal. Likeness is the Jaccard coefficient of two sets.

Comparing is pruned: two sets whose sizes have a ratio under the threshold cannot reach it,
so documents are partitioned by set length such that only equal or neighbouring partitions
can hold partners; a pair's Jaccard is bounded by its lengths before sets are intersected.

Anchors are the function words of ANCHORS, tokens without a letter or digit, and tokens that
follow a sentence's end. So texts without function words (tables, lists) have signatures too; a
text with words but no signature gets one, of its whole word sequence. Tokens are lower-cased
and stripped of punctuation at their ends.

Defined results: null and empty texts have the empty fingerprint. Likeness of equal fingerprints,
two empty ones included, is 1; of an empty and a non-empty one 0. Repeated rows each get a row;
extra columns pass through where the function says so. Whole texts are used.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import NULL_ID, BoundedMemo, claim, cut, mix64, shuffle_partitions, small_batches

#: Frequent function words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he in is it its not of on or that the they this to was were which with you "
    "auf auch aus bei das dem den der des die ein eine für im in ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "al como con de del el en es la las lo los más no para por que se su un una y".split()
)
CHAIN = 2
_EDGE = ".,;:!?()[]{}\"'`«»¡¿|*#$%&<>-_/\\"


def _word(token: str) -> int:
    """A word's hash with its lowest bits: 1 anchor, 2 sentence end, so that three cases need one lookup."""
    bare = token.lower().strip(_EDGE)
    h = xxhash.xxh3_64_intdigest(bare or token) & ~3
    return h | (1 if not bare or bare in ANCHORS else 0) | (2 if token[-1] in ".!?" else 0)


_MEMO = BoundedMemo(_word, 200_000)


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit signature hashes of a text."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(_MEMO.__getitem__, tokens), np.uint64, n)
    anchor = (h & np.uint64(1)).astype(bool)
    start = np.empty(n, bool)
    start[0], start[1:] = True, (h[:-1] & np.uint64(2)) > 0
    h = h >> np.uint64(2)
    content = np.flatnonzero(~anchor)
    # An anchor's chain starts after it; a sentence's first content word starts one itself.
    after = np.searchsorted(content, np.flatnonzero(anchor) + 1)
    first = np.searchsorted(content, np.flatnonzero(start & ~anchor))
    lead = np.concatenate([h[anchor], np.zeros(len(first), np.uint64)])
    at = np.concatenate([after, first])
    ok = at + CHAIN <= len(content)
    at, sig = at[ok], lead[ok]
    for k in range(CHAIN):
        sig = mix64(sig * np.uint64(0x9E3779B97F4A7C15) + h[content[at + k]])
    if not len(sig):
        sig = np.array([xxhash.xxh3_64_intdigest(" ".join(tokens))], np.uint64)
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def fingerprint(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def parse(fp: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fp), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 where their lengths alone rule out ``at_least``."""
    if not len(a) and not len(b):
        return 1.0
    small, large = sorted((len(a), len(b)))
    if small == 0 or small < at_least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with ``out``, the fingerprint of each whole text, and ``n_signatures``."""
    if clash := {out, "n_signatures"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    at = df.columns.index(text)

    def run(batches):  # noqa: ANN001, ANN202
        claim("spotsigs", _MEMO.clear)
        for batch in batches:
            sigs = [signatures(x.as_py() or "") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([fingerprint(s) for s in sigs], pa.string()), pa.array([len(s) for s in sigs], pa.int32())], names=[*batch.schema.names, out, "n_signatures"]
            )

    schema = df.withColumn(out, F.lit("")).withColumn("n_signatures", F.lit(0)).schema
    return small_batches(df).mapInArrow(run, schema)


def length_partition(n: int, threshold: float) -> int:
    """Partition of a set length: lengths whose ratio is at least ``threshold`` lie in equal or neighbouring ones."""
    return int(np.floor(np.log(max(n, 1)) / -np.log(threshold)))


def similar_pairs(prints: DataFrame, key: str = "doc_id", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of different fingerprints with a Jaccard of ``threshold`` or more as
    (left_id, right_id, likeness), each fingerprint stood for by its smallest key, and (key, class_id).

    Copies share a fingerprint and never become pairs. Of each set, only a prefix of its rarest
    signatures is indexed, per length partition: two sets over the threshold share one of them."""
    classes = cut(prints.where("n_signatures > 0").groupBy("fingerprint", "n_signatures").agg(F.min(key).alias("class_id")))
    members = prints.join(classes.select("fingerprint", "class_id"), "fingerprint", "left").select(key, F.coalesce("class_id", F.col(key)).alias("class_id"))

    def listed(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            fps, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [parse(x) for x in fps]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(s) for s in sets])), pa.array(np.concatenate(sets).astype(np.int64))], names=["class_id", "sig"])

    kind = classes.schema["class_id"].dataType.simpleString()
    every = classes.select("fingerprint", "class_id").mapInArrow(listed, f"class_id {kind}, sig long")
    rarity = every.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = every.join(rarity, "sig").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    n = F.size("sigs")
    prefix = n - F.ceil(n * F.lit(threshold)) + 1
    part = F.floor(F.log(n.cast("double")) / F.lit(-float(np.log(threshold)))).cast("int")
    indexed = ranked.select("class_id", n.alias("n"), part.alias("part"), F.explode(F.slice("sigs", F.lit(1), prefix.cast("int"))).alias("s")).select("class_id", "n", "part", F.col("s.sig").alias("sig"))
    left = indexed.select(F.col("class_id").alias("left_id"), F.col("n").alias("n_left"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = indexed.select(F.col("class_id").alias("right_id"), F.col("n").alias("n_right"), "sig", "part")
    close = F.least("n_left", "n_right") >= F.greatest("n_left", "n_right") * F.lit(threshold)
    candidates = left.join(right, ["sig", "part"]).where((F.col("left_id") < F.col("right_id")) & close).select("left_id", "right_id").distinct()
    fp = classes.select("class_id", "fingerprint")
    full = candidates.join(fp.toDF("left_id", "a"), "left_id").join(fp.toDF("right_id", "b"), "right_id")

    def verify(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = [jaccard(parse(a), parse(b), threshold) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.float64())], names=["left_id", "right_id", "likeness"])

    pairs = full.select("left_id", "right_id", "a", "b").mapInArrow(verify, f"left_id {kind}, right_id {kind}, likeness double").where(F.col("likeness") >= threshold)
    return pairs, members


def edited_text(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(df: DataFrame, fn, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: ANN001
    """``fn(ids, texts, following texts)`` -> arrays, over all rows in descending order of ``key`` (a null key is the
    smallest), where the row after the last is the first; rows that share a key are ordered by a hash of their texts.

    Rows are dealt to ranges of (key, hash), of which only the bounds come to the driver: approximate quantiles of
    the key, at most RANGES, and a key that fills several ranges is cut by the hash. A text is shuffled once;
    the first row of each range also goes, as a guest, to the range before it."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    n = docs.count()
    if not n:
        return spark.createDataFrame([], schema)
    ranges = max(1, min(RANGES, 4 * shuffle_partitions(spark), n // 16 or 1))
    at = [float(k) / ranges for k in range(1, ranges)]
    found = docs.agg(F.approx_percentile("id", F.array(*map(F.lit, at)), F.lit(20 * ranges)).alias("q")).first()["q"] if at else []
    cuts = sorted((i, -(1 << 63) + ((1 << 64) * k // times if times > 1 else 0)) for i, times in Counter(found).items() for k in range(times))
    # Ranges are numbered in descending order of the key, as the rows are read.
    bounds = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(m).alias("mark")) for i, m in cuts]) if cuts else None
    place = F.lit(len(cuts)) - F.size(F.filter(bounds, lambda c: c <= F.struct("id", "mark"))) if cuts else F.lit(0)
    placed = docs.withColumn("place", place.cast("int")).withColumn("name", F.concat_ws(":", F.col("id").cast("string"), F.col("mark").cast("string")))
    tops = {r["place"]: r["top"]["name"] for r in placed.groupBy("place").agg(F.max(F.struct("id", "mark", "name")).alias("top")).collect()}
    order = sorted(tops)
    before = {tops[p]: order[i - 1] for i, p in enumerate(order)}  # the first range's guest goes to the last range
    guest_of = F.try_element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("name"))
    both = placed.select("id", "text", "mark", F.explode(F.array(F.struct(F.col("place"), F.lit(False).alias("guest")), F.struct(guest_of.alias("place"), F.lit(True).alias("guest")))).alias("p"))
    dealt = both.where("p.place IS NOT NULL").select("id", "text", "p.place", "p.guest", "mark").repartition(min(ranges, shuffle_partitions(spark)), "place").sortWithinPartitions("place", "guest", F.desc("id"), F.desc("mark"))

    def run(batches):  # noqa: ANN001, ANN202
        claim("spotsigs", _MEMO.clear)
        held = None  # (place, id, text) that waits for what follows
        waiting = True
        for batch in batches:
            ids, texts, nexts = [], [], []
            for i, text, at, guest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                if held is not None and waiting and held[0] == at:
                    ids.append(held[1])
                    texts.append(held[2])
                    nexts.append(text)
                if guest:
                    waiting = False  # only the first guest row follows; ties of it are its range's own
                else:
                    held, waiting = (at, i, text), True
                if len(ids) >= 256:
                    yield fn(ids, texts, nexts)
                    ids, texts, nexts = [], [], []
            if ids:
                yield fn(ids, texts, nexts)

    return small_batches(dealt).mapInArrow(run, schema)


#: Most ranges, whose bounds come to the driver.
RANGES = 2_000


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def report(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        rows = []
        known: tuple[str, np.ndarray] | None = None
        for t, nxt in zip(texts, following, strict=True):
            own = known[1] if known is not None and known[0] is t else signatures(t)
            after = signatures(nxt)
            known = (nxt, after)
            e = edited_text(t, nxt)
            changed = signatures(e)
            rows.append((len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(own), fingerprint(changed), jaccard(own, changed), jaccard(own, after)))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        ids = [None if i == NULL_ID else i for i in ids]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=REPORT)

    REPORT = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = ("long", "long", "string", "string", "string", "double", "double")
    return with_following(df, report, ", ".join(f"`{c}` {k}" for c, k in zip(REPORT, kinds, strict=True)), key, text)
