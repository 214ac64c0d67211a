"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash fingerprints of the shingles, searched by the generalised pigeonhole principle
(``simhash``): PRINTS independent fingerprints, each linked at DISTANCE or fewer differing bits. Of the pairs at
0.8 or more in the given tables one such fingerprint links 89 %; the README says what two do. What the links connect is then verified: within each connected part, texts are compared by
the exact Jaccard similarity of their shingles, breadth first, and edges to the smallest id of
what true links connect are emitted. Parts of more than BLOCK_BYTES of text are cut into slices whose pairs are compared
block by block in different tasks. A text is removed only if a chain of verified links leads to an earlier one.

Texts with the same words are one class and take part once. A document is a key and a text; documents are
ordered by key (null first), and those that share a key by a hash of their texts.

Defined results: words are lower-cased (A-Z) runs without ASCII white space; a text of fewer words than a
shingle is one shingle; null and empty texts are copies of each other; of rows that share key and text one
stays; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import MASK64, BoundedMemo, claim, cut, mix64, released, scratch_name, small_batches, store
from pulseloom.llm.components import connected_components
from pulseloom.llm.simhash import links as close_prints
from pulseloom.llm.simhash import majority, star

SHINGLE, LEAST = 5, 0.8
PRINTS, DISTANCE = 2, 11
#: Text of one slice of a connected part; a task compares two slices at once.
BLOCK_BYTES = 16 << 20
_MEMO = BoundedMemo(lambda w: xxhash.xxh3_64_intdigest(w), 100_000)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    h = np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1) if len(h) else 0
    out = mix64(h[:n] + np.uint64(1))
    for k in range(1, min(shingle, len(h))):
        out = mix64(out * _PRIME + h[k : k + n])
    return out


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(words, shingle))


def prints(hashes: np.ndarray, n: int = PRINTS) -> np.ndarray:
    """``n`` SimHash fingerprints, each over the hashes mixed anew."""
    return np.array([majority(mix64(hashes + np.uint64((k + 1) * int(_PRIME) & MASK64))) for k in range(n)], np.uint64)


def sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, d1, d2, size, prints): the text's mark, the digest of its words, its bytes, and its fingerprints."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for batch in released(batches):
            claim("near_copies", _MEMO.clear)
            digests, sizes, found = [], [], []
            for cell in batch.column(2):
                words = (cell.as_py() or "").encode().lower().split()
                joined = b" ".join(words)
                digests.append(xxhash.xxh3_128_digest(joined))
                sizes.append(len(joined))
                found.append(prints(shingles(words)))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * PRINTS, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64()), lists], names=["key", "mark", "d1", "d2", "size", "prints"])

    docs = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return small_batches(docs).mapInArrow(run, f"key {kind}, mark long, d1 long, d2 long, size long, prints array<long>")


def forest(sets: list[np.ndarray], ids: list[int], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges that connect what all pairs of a similarity of at least ``least`` connect."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    has = np.zeros(len(flat) + 1, bool)
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(sets))
    name = np.array(ids)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        members = list(queue)
        while queue and len(rest):
            i = queue.pop()
            own = flat[starts[i] : starts[i + 1]]
            near = rest[np.minimum(sizes[rest], sizes[i]) >= least * np.maximum(sizes[rest], sizes[i]) - 1e-9]
            has[own] = True
            both = np.array([np.count_nonzero(has[flat[starts[j] : starts[j + 1]]]) for j in near.tolist()], np.int64)
            has[own] = False
            found = near[both >= least * (sizes[near] + sizes[i] - both) - 1e-9] if len(near) else near
            members += found.tolist()
            queue += found.tolist()
            rest = np.setdiff1d(rest, found, assume_unique=True)
        edges += star(name[members])
    return edges


def verified(texts: DataFrame) -> DataFrame:
    """(u, v): edges of verified links among the texts (id, text, group, block) of each group and block."""

    def run(rows: pa.Table) -> pa.Table:
        claim("near_copies", _MEMO.clear)
        sets = [shingles((t or "").encode().lower().split()) for t in rows.column("text").to_pylist()]
        e = np.array(forest(sets, rows.column("id").to_pylist()), np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(e.min(axis=1)), "v": pa.array(e.max(axis=1))})

    return texts.groupBy("group", "block").applyInArrow(run, "u long, v long")


def candidates(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): edges that connect the ids of classes whose fingerprints are close, for any of the fingerprints."""
    out = None
    for k in range(PRINTS):
        own = classes.select("id", F.col("prints")[k].alias("fp"))
        heads = cut(own.groupBy("fp").agg(F.min("id").alias("class_id")))
        ties = own.join(heads, "fp").where("id <> class_id").select(F.col("class_id").alias("u"), F.col("id").alias("v"))
        edges = close_prints(heads, distance).unionByName(ties)
        out = edges if out is None else out.unionByName(edges)
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, first): one row for each row; first is the (key, mark) of the earliest document reachable by links.

    mark is the ``xxhash64`` of the text, which tells documents that share a key apart."""
    rows = store(sketches(df, key, text))
    classes = rows.groupBy("d1", "d2").agg(F.min(F.struct("key", "mark")).alias("rep"), F.min("size").alias("size"), F.min("prints").alias("prints"))
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()))
    groups = cut(connected_components(candidates(classes)).select(F.col("node").alias("id"), F.col("component").alias("group")))
    members = groups.join(classes.select("id", "size", "rep"), "id")
    slices = members.groupBy("group").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("slices"))
    dealt = members.join(slices, "group")
    own = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    with_all = F.transform(F.sequence(F.lit(0), F.greatest(F.col("slices"), F.lit(1)) - 1), lambda j: F.least(j, own) * F.col("slices") + F.greatest(j, own))
    dealt = dealt.withColumn("block", F.explode(with_all)).select("id", "group", "block", F.col("rep.key").alias("at"), F.col("rep.mark").alias("by"))
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts = docs.join(dealt, docs["key"].eqNullSafe(F.col("at")) & (F.xxhash64("text") == F.col("by"))).select("id", "text", "group", "block")
    found = connected_components(verified(texts))
    named = cut(classes.join(found, F.col("id") == F.col("node"), "left").select("d1", "d2", "rep", F.coalesce("component", "id").alias("component")))
    first = named.groupBy("component").agg(F.min("rep").alias("first"))
    return rows.join(named.join(first, "component").select("d1", "d2", "first"), ["d1", "d2"]).select(F.col("key").alias(key), "mark", "first")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each group of near copies: a row of its earliest document."""
    found = near_duplicates(df, key, text)
    at, mark, n = scratch_name("key"), scratch_name("mark"), scratch_name("n")
    own = F.struct(F.col(key), F.col("mark")) == F.col("first")
    counted = cut(found.groupBy(F.col(key).alias(at), F.col("mark").alias(mark)).agg(F.when(F.min(own), F.count("*")).otherwise(0).alias(n)).where(F.col(n) != 1))
    same = F.col(key).eqNullSafe(F.col(at)) & (F.xxhash64(text) == F.col(mark))
    kept = df.join(counted.where(F.col(n) == 0), same, "left_anti")
    twins = counted.where(F.col(n) > 1)
    if not twins.isEmpty():  # rows that share key and text
        again = kept.join(twins, same, "left_semi").withColumn(mark, F.xxhash64(text)).dropDuplicates([key, mark]).drop(mark)
        kept = kept.join(twins, same, "left_anti").unionByName(again)
    return kept.select(*df.columns)
