"""Substring dedup by hashing units: lines, paragraphs, lines cut further at sentence ends, or lines and sentences.

Each unit is normalised (lower case, white space collapsed), hashed to 128 bits and grouped over
all documents; the occurrence of the smallest (document, offset) stays, all others are removed.
Spans are offsets into the original text.

A document is a key and a text: rows that share both are one document, whose row counts once and is
returned as often as it occurs; rows that share a key only (a null key is one like any other, and the
smallest) are documents of their own, ordered by a hash of their texts.

Units are hashed once and stored. Of units that repeat within a batch, all but the first are settled
there, so a line that every document holds costs a row a batch. First occurrences come from a
group-by that is combined in each task before the shuffle; the rest is joined to the
repeated digests only, an ordinary join whose hot keys adaptive execution splits. Each
document's spans are as many as its own units, and texts are shuffled once.

Defined results: null and empty texts have no units and stay as they are; units of fewer than
``least_words`` words are never removed (whole lines of any length are, where the unit is ``BOTH``); an
empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import released, scratch_name, small_batches, store

#: What separates units; a unit keeps its end mark but not the separator.
SEPARATORS = {"line": re.compile(r"\n+"), "paragraph": re.compile(r"\n[ \t]*\n\s*"), "sentence": re.compile(r"(?<=[.!?])[ \t]+|\n+")}
LEAST_WORDS = 6
#: Whole lines of any length, and their sentences of LEAST_WORDS or more as a finer unit.
BOTH = "lines_and_sentences"
#: Unit rows of one batch that leaves a worker.
UNIT_ROWS = 50_000


def units_of(text: str, unit: str = "sentence", least_words: int = LEAST_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, normal form) of the units that can be removed."""
    if unit == BOTH:
        found = {(a, b): n for u, least in (("line", 1), ("sentence", least_words)) for a, b, n in units_of(text, u, least)}
        return [(a, b, n) for (a, b), n in sorted(found.items())]
    out, at = [], 0
    for start, end in [*(m.span() for m in SEPARATORS[unit].finditer(text)), (len(text), len(text))]:
        words = text[at:start].lower().split()
        if len(words) >= least_words:
            out.append((at, start, " ".join(words)))
        at = end
    return out


def hashed_units(df: DataFrame, key: str, text: str, unit: str, least_words: int) -> DataFrame:
    """(d1, d2, key, mark, start, stop, settled) for each unit of each document; mark tells a key's texts apart,
    and settled units repeat an earlier one of their batch."""
    kind = df.schema[key].dataType.simpleString()

    def rows(keys, ids, marks, starts, stops, digests):  # noqa: ANN001, ANN202
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        row, mark, start = np.array(ids), np.array(marks, np.int64), np.array(starts, np.int32)
        rank = keys.dictionary_encode()  # ranks of the batch's keys: nulls first, then ascending
        known = rank.dictionary.drop_null()
        place = np.empty(len(known) + 1, np.int64)
        place[pa.compute.sort_indices(known).to_numpy()] = np.arange(len(known))
        place[-1] = -1
        codes = place[rank.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)][row]
        order = np.lexsort((start, mark, codes, d[:, 1], d[:, 0]))
        same = (d[order[1:]] == d[order[:-1]]).all(axis=1)
        settled = np.zeros(len(row), bool)
        # A row that repeats the same unit of the same document (a repeated row) is dropped below.
        twin = same & (codes[order[1:]] == codes[order[:-1]]) & (mark[order[1:]] == mark[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
        lead = np.concatenate([[0], np.cumsum(~same)])
        run_start = np.flatnonzero(np.concatenate([[True], ~same]))
        head = order[run_start[lead]]
        later = (codes[order] != codes[head]) | (mark[order] != mark[head]) | (start[order] != start[head])
        settled[order] = later
        keep = np.ones(len(row), bool)
        keep[order[1:][twin]] = False
        at = np.flatnonzero(keep)
        for lo in range(0, len(at), UNIT_ROWS):
            k = at[lo : lo + UNIT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[k, 0]), pa.array(d[k, 1]), keys.take(pa.array(row[k])), pa.array(mark[k]), pa.array(start[k]), pa.array(np.array(stops, np.int32)[k]), pa.array(settled[k])],
                names=["d1", "d2", "key", "mark", "start", "stop", "settled"],
            )

    def run(batches):  # noqa: ANN001, ANN202
        for batch in released(batches):
            ids, marks, digests, starts, stops = [], [], [], [], []
            for k, (cell, mark) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                for a, b, normal in units_of(cell.as_py() or "", unit, least_words):
                    ids.append(k)
                    marks.append(mark)
                    starts.append(a)
                    stops.append(b)
                    digests.append(xxhash.xxh3_128_digest(normal))
            if ids:
                yield from rows(batch.column(0), ids, marks, starts, stops, digests)

    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return small_batches(docs).mapInArrow(run, f"d1 long, d2 long, key {kind}, mark long, start int, stop int, settled boolean")


def repeated_units(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, mark, start, stop) of all occurrences but the first of each unit; mark is the text's ``xxhash64``."""
    units = store(hashed_units(df, key, text, unit, least_words))
    open_ = units.where("NOT settled").drop("settled")
    where = F.struct("key", "mark", "start")
    first = open_.groupBy("d1", "d2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").select("d1", "d2", "first")
    later = open_.join(first, ["d1", "d2"]).where(where != F.col("first")).select("key", "mark", "start", "stop")
    return units.where("settled").select("key", "mark", "start", "stop").unionByName(later)


def merged(spans: list[dict]) -> list[dict]:
    """Sorted spans, without those that lie in a larger one (a sentence of a removed line)."""
    out: list[dict] = []
    for s in spans:
        if out and s["start"] < out[-1]["stop"]:
            out[-1] = {"start": out[-1]["start"], "stop": max(s["stop"], out[-1]["stop"])}
        else:
            out.append(s)
    return out


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", least_words: int = LEAST_WORDS, keep_text: bool = True) -> DataFrame:
    """``df`` with ``removed`` (array of (start, stop) in the original text, sorted) and ``kept_text``;
    without the original text unless ``keep_text``. Raises if a new column's name is taken."""
    if clash := {"removed", "kept_text"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    by, mark = scratch_name("key"), scratch_name("mark")
    spans = repeated_units(df, key, text, unit, least_words).groupBy("key", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("removed"))
    spans = spans.select(F.col("key").alias(by), F.col("mark").alias(mark), "removed")
    joined = df.join(spans, F.col(key).eqNullSafe(F.col(by)) & (F.xxhash64(text) == F.col(mark)), "left").select(*df.columns, "removed")
    joined = joined.withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:int,stop:int>>")))
    at, last = joined.columns.index(text), len(joined.columns) - 1
    rest = [f for k, f in enumerate(joined.schema.fields) if keep_text or k != at]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in released(batches):
            out, outer = [], []
            for cell, spans in zip(batch.column(at), batch.column(last), strict=True):
                spans, t = merged(spans.as_py()), cell.as_py()
                outer.append(spans)
                if spans:
                    parts, done = [], 0
                    for s in spans:
                        parts.append(t[done : s["start"]])
                        done = s["stop"]
                    t = "".join([*parts, t[done:]])
                out.append(t)
            columns = [pa.array(outer, c.type) if k == last else c for k, c in enumerate(batch.columns) if keep_text or k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], names=[*(f.name for f in rest), "kept_text"])

    return small_batches(joined).mapInArrow(run, T.StructType([*rest, T.StructField("kept_text", T.StringType())]))
