"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint holds, for each of 64 bits, whether over half of its word shingles'
XXH64 values have it. Fingerprints at a Hamming distance of at most ``distance`` are linked,
and documents are grouped by connected components.

Links are found exactly. The bits are grouped into m partitions, correlated bits together. If
the partitions' thresholds t_i add up to distance - m + 1 (a threshold of -1 leaves a partition
out), any two linked fingerprints differ in at most t_i bits in some partition i. Which m,
and which unequal thresholds, is chosen by dynamic programming over estimated probes and
candidates, from bit and bit-pair counts of all fingerprints. Each fingerprint is filed under
its key in each partition used, and probes the higher keys within t_i bits; what meets is
verified on all 64 bits.

Copies share a fingerprint and take part once. Buckets beyond BUCKET fingerprints are cut into
slices whose pairs are checked block by block in different tasks. Within a bucket or
block, links are followed breadth first and what they connect is emitted as edges to its smallest id, never as
all pairs; that loses no connection, and the same documents give the same edges wherever they meet. Nothing but bit counts and one number a round reaches the driver.

Defined results: null or empty texts have fingerprint zero and are linked like any other; repeated
rows are grouped; a null key is the smallest, and comes back as null; an empty table gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import NULL_ID, cut, released, shuffle_partitions, small_batches
from pulseloom.llm.components import connected_components

BITS = 64
#: Fingerprints that one task compares at once; larger buckets are cut into slices.
BUCKET = 4096
#: Relative cost of a row that is filed or probed, and of a pair that is verified.
ROW_COST, PAIR_COST = 1.0, 0.004
#: Slicing rows that are broadcast to the filed rows; beyond, they are joined.
BROADCAST_BUCKETS = 100_000


def shingle_digests(text: str, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of the whole sequence where it has fewer words."""
    words = text.encode().lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(digests: np.ndarray) -> int:
    """The bits that over half of the digests have; none of no digests."""
    if not len(digests):
        return 0
    bits = np.unpackbits(digests.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(digests), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    return majority(shingle_digests(text, shingle, seed))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp): fp is the unsigned fingerprint's bits as a signed long."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for batch in released(batches):
            fps = np.array([fingerprint(x.as_py() or "", shingle, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return small_batches(df.select(F.col(key), F.col(text))).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bit i and bit j, for all i and j."""

    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            b = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(b), 1 << 20):
                total += b[at : at + (1 << 20)].T @ b[at : at + (1 << 20)]
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"])

    rows = classes.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"], r["j"]] = r["n"]
    return classes.count(), both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size; each bit joins the open group that it correlates with most."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    sizes = [BITS // m + (k < BITS % m) for k in range(m)]
    left, groups = set(range(BITS)), []
    for size in sizes:
        rest = sorted(left)
        seed = max(rest, key=lambda b: (corr[b, rest].max(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            b = max(sorted(left), key=lambda x: (corr[x, group].mean(), -x))
            group.append(b)
            left.discard(b)
        groups.append(sorted(group))
    return groups


@dataclass
class Plan:
    groups: list[list[int]]
    thresholds: list[int]
    cost: float


def plan(n: int, both: np.ndarray, distance: int, most: int = 8) -> Plan:
    """Partitions and thresholds of the lowest estimated cost. An empty table is planned as one row, as else all would be free."""
    n = max(n, 1)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: Plan | None = None
    for m in range(1, min(most, distance + 1) + 1):
        groups = group_bits(n, both, m)
        costs = []  # by group and threshold -1, 0, 1, ...
        for g in groups:
            at = np.zeros(len(g) + 1)
            at[0] = 1.0
            for b in g:
                at[1:] = at[1:] * (1 - differ[b]) + at[:-1] * differ[b]
                at[0] *= 1 - differ[b]
            within = np.cumsum(at)
            row = [0.0]
            for t in range(distance + 1):
                ball = sum(math.comb(len(g), k) for k in range(min(t, len(g)) + 1))
                row.append(ROW_COST * n * (1 + ball) / 2 + PAIR_COST * n * n / 2 * within[min(t, len(g))])
            costs.append(row)
        want = distance - m + 1 + m  # thresholds are counted from -1
        table = {0: (0.0, [])}
        for row in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t1, x in enumerate(row):
                    if s + t1 <= want and (s + t1 not in new or c + x < new[s + t1][0]):
                        new[s + t1] = (c + x, [*ts, t1 - 1])
            table = new
        if want in table and (best is None or table[want][0] < best.cost):
            best = Plan(groups, table[want][1], table[want][0])
    assert best is not None
    return best


def _keys(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of some bits, packed."""
    out = np.zeros(len(x), np.uint64)
    for k, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _flips(width: int, t: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(range(width), k)]


def filed(classes: DataFrame, chosen: Plan) -> DataFrame:
    """(part, bucket, fp, class_id, probe): each fingerprint under its own keys, and as a probe under higher ones."""
    flips = [_flips(len(g), t) if t > 0 else [] for g, t in zip(chosen.groups, chosen.thresholds, strict=True)]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            for part, (g, t) in enumerate(zip(chosen.groups, chosen.thresholds, strict=True)):
                if t < 0:
                    continue
                own = _keys(fp.view(np.uint64), g)
                yield _rows(part, own, fp, ids, False)
                for f in flips[part]:
                    other = own ^ np.uint64(f)
                    up = other > own
                    if up.any():
                        yield _rows(part, other[up], fp[up], ids[up], True)

    return classes.select("fp", "class_id").mapInArrow(run, "part int, bucket long, fp long, class_id long, probe boolean")


def _rows(part: int, keys: np.ndarray, fp: np.ndarray, ids: np.ndarray, probe: bool) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(keys.view(np.int64)), pa.array(fp), pa.array(ids), pa.array(np.full(n, probe))], names=["part", "bucket", "fp", "class_id", "probe"])


def star(ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect some ids: from the smallest to each other. Where the same ids meet in several buckets, these
    are the same edges, which ``distinct`` makes one."""
    low = int(ids.min())
    return [(low, x) for x in ids.tolist() if x != low]


def forest(fp: np.ndarray, ids: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges among filed rows, and of probes to filed rows, that connect what all links among them connect."""
    x, at = fp[~probe].view(np.uint64), ids[~probe]
    edges: list[tuple[int, int]] = []
    label = np.full(len(x), -1)
    rest = np.arange(len(x))
    if len(x) > 1 and len(x) <= 192:  # mostly unrelated: one comparison of all tells
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
        if int(near.sum()) == len(x):
            label, rest = np.arange(len(x)), rest[:0]
    c = 0
    while len(rest):
        label[rest[0]] = c
        queue, rest = [int(rest[0])], rest[1:]
        members = list(queue)
        while queue and len(rest):
            i = queue.pop()
            hit = np.bitwise_count(x[rest] ^ x[i]) <= distance
            if hit.any():
                found = rest[hit]
                label[found] = c
                members += found.tolist()
                queue += found.tolist()
                rest = rest[~hit]
        edges += star(at[members])
        c += 1
    if probe.any() and len(x):
        lowest = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, label, at)
        px, pid = fp[probe].view(np.uint64), ids[probe]
        step = max(1, (1 << 21) // len(x))
        for lo in range(0, len(px), step):
            r, k = np.nonzero(np.bitwise_count(px[lo : lo + step, None] ^ x[None, :]) <= distance)
            if len(r):  # one edge to each of the connected parts that a probe meets, to its smallest id
                _, first = np.unique(r * (c + len(x) + 1) + label[k], return_index=True)
                edges += [(int(pid[lo + r[q]]), int(lowest[label[k[q]]])) for q in first]
    return edges


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v): links between different fingerprints' class ids that connect what all links connect."""
    n, both = bit_counts(classes)
    rows = filed(classes, plan(n, both, distance))
    parts = shuffle_partitions(classes.sparkSession)
    sizes = rows.groupBy("part", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET)
    large = cut(sizes.select("part", "bucket", F.ceil(F.col("size") / BUCKET).cast("int").alias("slices")))
    if (k := large.count()) == 0:
        rows = rows.withColumn("block", F.lit(0))
    else:
        large = F.broadcast(large) if k <= BROADCAST_BUCKETS else large
        rows = rows.join(large, ["part", "bucket"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
        with_all = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.least(j, own) * F.col("slices") + F.greatest(j, own))
        rows = rows.withColumn("block", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(0))).otherwise(with_all))).drop("slices")
    dealt = rows.repartition(parts, "part", "bucket", "block").sortWithinPartitions("part", "bucket", "block", "fp", "probe")

    def run(batches):  # noqa: ANN001, ANN202
        held: list[tuple] = []  # arrays of the group at the end of what has been read
        name = None

        def ended():  # noqa: ANN202
            if held and sum(len(h[0]) for h in held) > 1:
                f, i, p = (np.concatenate(c) for c in zip(*held, strict=True))
                return forest(f, i, p, distance)
            return []

        for batch in batches:
            part, bucket, fp, ids, probe, block = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("part", "bucket", "fp", "class_id", "probe", "block"))
            fp, ids, probe = fp.astype(np.int64), ids.astype(np.int64), probe.astype(bool)
            turn = np.flatnonzero((part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
            out: list[tuple[int, int]] = []
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(fp)], strict=True):
                this = (part[a], bucket[a], block[a])
                if this != name:
                    out += ended()
                    held, name = [], this
                held.append((fp[a:b], ids[a:b], probe[a:b]))
            if out:
                yield _edges(out)
        if last := ended():
            yield _edges(last)

    return dealt.mapInArrow(run, "u long, v long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e.min(axis=1)), pa.array(e.max(axis=1))], names=["u", "v"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp, component_id): one row for each row of ``df``; component_id is the smallest key reachable by links.

    ``key`` must be an integer column."""
    kind = df.schema[key].dataType
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("key"), F.col(text).alias("text"))
    prints = cut(fingerprints(docs, "key", "text", shingle, seed))
    classes = cut(prints.groupBy("fp").agg(F.min("key").alias("class_id")))
    found = connected_components(links(classes, distance))
    named = classes.join(found, F.col("class_id") == F.col("node"), "left").select("fp", F.coalesce("component", "class_id").alias("component_id"))
    own = lambda c, t: F.nullif(c, F.lit(NULL_ID)).cast(t)
    return prints.join(named, "fp").select(own("key", kind).alias(key), "fp", own("component_id", "long").alias("component_id"))
