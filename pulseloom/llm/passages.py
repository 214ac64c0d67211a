"""Suffix-array dedup: remove bytes covered by a LENGTH-byte string that also starts earlier.

Earlier means a smaller document id, or the same document and a smaller offset. Strings are judged on
the input, matches never cross documents, overlaps count.

Windows of LENGTH bytes are dealt by content so that equal windows meet: each window belongs to its
anchor, the GRAM bytes in it of the smallest hash (leftmost on ties), and consecutive windows with the
same anchor form a segment. Equal windows have equal anchors at equal offsets. So

1. every text is cut to segments, about one for 35 bytes, of which only hashes are shuffled, by anchor.
   Segments repeated within a task's batch are settled there, so a hot passage costs a row a batch;
2. anchors with one segment are done. Of segments that repeat exactly, all but the first are removed;
3. for anchors with different segments, the bytes are fetched. What cannot match is trimmed: left and
   right of the anchor, a segment matches no further than its neighbours in sorted order do. Equal
   trimmed strings collapse to the first. The remaining different ones are suffix-sorted together, by linear
   grouping construction, in chunks of whole anchors: windows that are equal are adjacent in the suffix
   order. All but the first of each run are removed.

Texts are shuffled once (the exchange is reused), nothing is collected or broadcast.

Defined results: null and empty texts have no bytes; rows that share an id and a text count as one document
(each row gets the result), and rows that share an id only are documents of their own, ordered by a hash of
their texts; a null id is the smallest; an empty table gives an empty table; only the id and the text are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import documents, mix64, released, shuffle_partitions, small_batches, store
from pulseloom.llm.suffixes import suffix_order

LENGTH, GRAM = 100, 32
#: Bytes that are hashed at once, and bytes and strings that are suffix-sorted at once (whole anchors).
PIECE, CHUNK, ROWS = 1 << 19, 48_000, 20_000
#: Rows of a batch of documents: a worker holds a batch's texts and its segments' bytes.
DOCUMENTS = 2_000
_POSITION = np.uint64(24)  # bits of a position in a piece; the rest are the hash's
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLIER = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        both = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            p = np.full(max(n, 2 * PIECE), base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[0] = (both[0], both[1])
    return _POWERS[0]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each position on, by doubling."""
    h, width = _TABLE[b], 1
    while width < GRAM:
        x = h[:-width] * np.uint64(0xD6E8FEB86659FD93)
        h = (x ^ (x >> np.uint64(32))) + h[width:] * np.uint64(0x9FB21C651E98DF25)
        width *= 2
    return mix64(h)


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text's place, start, windows, anchor offset, anchor hash, segment hash) of all segments.

    Long texts are hashed in overlapping pieces, short ones together; that changes nothing."""
    out: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []  # (place, offset of the piece, bytes)
    size = 0
    for k, raw in enumerate(texts):
        for off in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
            piece = raw[off : off + PIECE + LENGTH - 1]
            held.append((k, off, piece))
            size += len(piece)
            if size >= PIECE:
                out.append(_cut(held))
                held, size = [], 0
    if held:
        out.append(_cut(held))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _cut(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    lengths = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    grams = gram_hashes(b)
    low = (np.uint64(1) << _POSITION) - np.uint64(1)
    m = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < want:
        m = np.minimum(m[: len(m) - (want - width)], m[want - width :])
    anchor = (m & low).astype(np.int64)  # of the window that starts at each position
    first = np.zeros(len(anchor), bool)
    valid = np.zeros(len(anchor) + 1, bool)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        valid[s : e - LENGTH + 1] = True
    first[0] = True
    first[1:] = anchor[1:] != anchor[:-1]
    first[starts] = True
    first |= valid[:-1] & ~np.concatenate([[False], valid[:-2]])
    at = np.flatnonzero(first | (np.diff(valid[:].astype(np.int8), prepend=0)[: len(anchor)] != 0))
    until = np.append(at[1:], len(anchor))
    keep = valid[at]
    at, until = at[keep], until[keep]
    a = anchor[at]
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * up[: len(b)], out=total[1:])
    seg = mix64((total[until + LENGTH - 1] - total[at]) * down[at] + (until - at).astype(np.uint64))
    owner = np.searchsorted(ends, at, side="right")
    place, offset = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    return place[owner], at - starts[owner] + offset[owner], until - at, a - at, grams[a], seg


def _pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << 16) | (windows << 8) | offset


def segment_rows(docs: DataFrame) -> DataFrame:
    """(key, seg, doc, at, settled): a row for each segment; settled ones repeat an earlier one of their batch."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place, start, windows, offset, key, seg = segments([x.as_py().encode() for x in batch.column(1)])
            if not len(place):
                continue
            doc = ids[place]
            order = np.lexsort((start, doc, seg, key))
            doc, key, seg, at = doc[order], key[order], seg[order], _pack(start, windows, offset)[order]
            once = _once(key, seg, doc, at)  # rows that share an id and a text
            doc, key, seg, at = doc[once], key[once], seg[once], at[once]
            settled = np.zeros(len(doc), bool)
            settled[1:] = (key[1:] == key[:-1]) & (seg[1:] == seg[:-1])
            key = np.where(settled, mix64(doc.view(np.uint64)), key)
            yield _batch(key=key.view(np.int64), seg=seg.view(np.int64), doc=doc, at=at, settled=settled)

    return small_batches(docs, DOCUMENTS).mapInArrow(run, "key long, seg long, doc long, at long, settled boolean")


def _once(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _runs(batches, names: list[str], by: str, rows: int):  # noqa: ANN001, ANN202
    """Tables of whole runs of ``by`` (sorted input), of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).select(names)
        keys = table.column(by).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n = table.num_rows - cut
        else:
            held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).select(names)
        if table.num_rows:
            yield table


def settle(rows: DataFrame) -> DataFrame:
    """(doc, at, key, removed): exact repeats of segments (removed), and segments whose anchor has others (not yet)."""
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "seg", "doc", "at")

    def run(batches):  # noqa: ANN001, ANN202
        for table in _runs(batches, ["key", "seg", "doc", "at", "settled"], "key", 100_000):
            key, seg, doc, at, settled = (table.column(c).to_numpy() for c in ("key", "seg", "doc", "at", "settled"))
            once = settled | _once(key, seg, doc, at)
            key, seg, doc, at, settled = key[once], seg[once], doc[once], at[once], settled[once]
            repeat = settled.copy()
            live = np.flatnonzero(~settled)
            k, s = key[live], seg[live]
            again = np.zeros(len(live), bool)
            again[1:] = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
            repeat[live[again]] = True
            kept = live[~again]
            k = key[kept]
            shared = np.zeros(len(kept), bool)
            if len(kept) > 1:
                same = k[1:] == k[:-1]
                shared[1:] |= same
                shared[:-1] |= same
            out = np.concatenate([np.flatnonzero(repeat), kept[shared]])
            removed = np.zeros(len(out), bool)
            removed[: int(repeat.sum())] = True
            if len(out):
                yield _batch(doc=doc[out], at=at[out], key=key[out], removed=removed)

    return dealt.mapInArrow(run, "doc long, at long, key long, removed boolean")


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, doc, at, bytes) of segments (doc, at, key)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("at", "key")).alias("list"))
    joined = docs.join(lists, "doc").select("doc", "text", "list")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            at, key = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            done, out = 0, []
            for cell, n in zip(batch.column(1), counts.tolist(), strict=True):
                raw = cell.as_py().encode()
                for x in at[done : done + n].tolist():
                    s = x >> 16
                    out.append(raw[s : s + ((x >> 8) & 255) + LENGTH - 1])
                done += n
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            for lo in range(0, len(out), 20_000):
                hi = lo + 20_000
                yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi]), pa.array(doc[lo:hi]), pa.array(at[lo:hi]), pa.array(out[lo:hi], pa.binary())], names=["key", "doc", "at", "bytes"])

    return joined.mapInArrow(run, "key long, doc long, at long, bytes binary")


def _longest_common(m: np.ndarray, length: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row of a byte matrix, the most leading bytes that it shares with another row of its key."""
    words = np.ascontiguousarray(m).view(">u8")
    order = np.lexsort((*(words[:, c] for c in range(words.shape[1] - 1, -1, -1)), key))
    differ = m[order[1:]] != m[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    common = np.minimum(common, np.minimum(length[order[1:]], length[order[:-1]]))
    common[key[order[1:]] != key[order[:-1]]] = 0
    best = np.zeros(len(key), np.int64)
    best[order[1:]] = common
    best[order[:-1]] = np.maximum(best[order[:-1]], common)
    return best


def _sides(flat: np.ndarray, start: np.ndarray, stop: np.ndarray, width: int, backwards: bool) -> np.ndarray:
    """Rows of ``width`` bytes from ``start`` on (or before ``start``, backwards), zero beyond ``stop``."""
    step = np.arange(width)
    at = start[:, None] + (-1 - step if backwards else step)
    ok = at >= stop[:, None] if backwards else at < stop[:, None]
    return np.where(ok, flat[np.clip(at, 0, max(len(flat) - 1, 0))], 0).astype(np.uint8)


def trim(key: np.ndarray, at: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each segment that can equal a window of another segment of its anchor."""
    windows, offset = (at >> 8) & 255, at & 255
    flat = np.frombuffer(b"".join(blobs), np.uint8)
    ends = np.cumsum([len(b) for b in blobs])
    starts = np.concatenate([[0], ends[:-1]])
    width = 72  # LENGTH - GRAM, rounded up to whole words
    left = _longest_common(_sides(flat, starts + offset, starts, width, True), offset, key)
    right = _longest_common(_sides(flat, starts + offset + GRAM, ends, width, False), ends - starts - offset - GRAM, key)
    return np.maximum(0, offset - left), np.minimum(windows - 1, right - (LENGTH - GRAM) + offset)


def repeated_windows(strings: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(string's place, first window, windows) of the windows that equal a window of a smaller (doc, start),
    found in the suffix order of the strings' concatenation."""
    text = b"".join(strings)
    lengths = np.array([len(s) for s in strings])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owner = np.repeat(np.arange(len(strings)), lengths)
    inside = np.arange(len(text)) - begins[owner]
    is_window = inside <= lengths[owner] - LENGTH
    order = np.array(suffix_order(text))
    order = order[is_window[order]]
    b = np.frombuffer(text, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(b, LENGTH)[order]
    turn = np.ones(len(order), np.int64)
    turn[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    run = np.cumsum(turn)
    own = owner[order]
    where = start[own] + inside[order]
    ranked = np.lexsort((where, doc[own], run))
    later = np.zeros(len(ranked), bool)
    later[1:] = run[ranked[1:]] == run[ranked[:-1]]
    gone = np.zeros(len(text) + 1, bool)
    gone[order[ranked[later]]] = True
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
    out = []
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k = int(owner[a])
        while a < z:  # a run may go on in the next string
            stop = min(z, int(ends[k]))
            out.append((k, int(inside[a]), stop - a))
            a, k = stop, k + 1
    return out


def settle_bytes(rows: DataFrame) -> DataFrame:
    """(doc, start, windows) to remove, of segments with their bytes."""
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key")

    def run(batches):  # noqa: ANN001, ANN202
        for table in _runs(batches, ["key", "doc", "at", "bytes"], "key", ROWS):
            key, doc, at = (table.column(c).to_numpy() for c in ("key", "doc", "at"))
            blobs = table.column("bytes").to_pylist()
            lo, hi = trim(key, at, blobs)
            starts = (at >> 16) + lo
            some = np.flatnonzero(lo <= hi)
            out: list[tuple[int, int, int]] = []
            first: dict[tuple[int, bytes], tuple[int, int, int]] = {}  # of each anchor's trimmed strings
            for i, k, d, s, a, n in zip(some.tolist(), key[some].tolist(), doc[some].tolist(), starts[some].tolist(), lo[some].tolist(), (hi - lo + 1)[some].tolist(), strict=True):
                name, this = (k, blobs[i][a : a + n + LENGTH - 1]), (d, s, n)
                if (seen := first.get(name)) is None:
                    first[name] = this
                elif this == seen:  # a row that shares its id and text with another
                    continue
                elif this < seen:
                    out.append(seen)
                    first[name] = this
                else:
                    out.append(this)
            names = list(first)  # an anchor's strings are together, as the rows were sorted
            held: list[tuple[int, bytes]] = []
            size = 0
            for j, (k, raw) in enumerate(names):
                if size >= CHUNK and k != held[-1][0]:
                    out += _sorted_out(held, first)
                    held, size = [], 0
                alone = (j == 0 or names[j - 1][0] != k) and (j + 1 == len(names) or names[j + 1][0] != k)
                if not alone:  # a single string of its anchor repeats nothing
                    held.append((k, raw))
                    size += len(raw)
            if held:
                out += _sorted_out(held, first)
            if out:
                x = np.array(out, np.int64)
                yield _batch(doc=x[:, 0], start=x[:, 1], windows=x[:, 2])

    return dealt.mapInArrow(run, "doc long, start long, windows long")


def _sorted_out(held: list[tuple[int, bytes]], first: dict) -> list[tuple[int, int, int]]:
    where = [first[h] for h in held]
    doc, start = np.array([w[0] for w in where], np.int64), np.array([w[1] for w in where], np.int64)
    return [(where[k][0], where[k][1] + a, n) for k, a, n in repeated_windows([raw for _, raw in held], doc, start)]


def remove_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, removed, kept): removed is the array of maximal removed runs (start, stop) in bytes, kept
    the remaining bytes (removing may cut a character's bytes apart)."""
    named = documents(df, key, text)
    docs = named.select("doc", "text")
    found = store(settle(segment_rows(docs)))
    exact = found.where("removed").select("doc", F.shiftright("at", 16).alias("start"), F.shiftright("at", 8).bitwiseAND(F.lit(255)).alias("windows"))
    rest = settle_bytes(fetch(docs, found.where("NOT removed").select("doc", "at", "key")))
    spans = exact.unionByName(rest).groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    joined = named.join(spans, "doc", "left").select("key", "text", "spans")
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in released(batches):
            sizes, removed, kept = [], [], []
            for cell, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = cell.as_py().encode()
                sizes.append(len(raw))
                if not spans.is_valid or not len(spans.values):
                    removed.append([])
                    kept.append(raw)
                    continue
                start = spans.values.field(0).to_numpy(zero_copy_only=False)
                stop = start + spans.values.field(1).to_numpy(zero_copy_only=False) + LENGTH - 1
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
                a, z = start[new].tolist(), np.minimum(stop[np.append(new[1:], len(stop)) - 1], len(raw)).tolist()
                removed.append([{"start": x, "stop": y} for x, y in zip(a, z, strict=True)])
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *z], [*a, len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, arrow), pa.array(kept, pa.binary())], names=["key", "n_bytes", "removed", "kept"])

    kind = df.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary").withColumnRenamed("key", key)
