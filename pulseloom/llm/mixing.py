"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are summed to cells (source, language, topic). The cells' token weights are raked
to target marginals of each dimension in turn until the largest relative deviation is under a
tolerance. Each document is then drawn with the probability ``scale * weight / tokens`` of its
cell, where ``scale`` makes the largest probability 1: the expected token mix is the raked one.

Only DataFrame functions run. The cells are as many as there are combinations of the
dimensions' values; they stay a DataFrame, whose lineage is cut at every round. Each round is
three window sums over cells, not documents. The cells' rates are broadcast to the documents
where their counted number is under BROADCAST_CELLS; beyond it, an ordinary join takes over,
which adaptive execution splits where a source is hot. The draw depends
on the document's id and a seed only, so a lost executor's tasks give the same rows again.

Raises if a new column's name (but ``topic``, which is taken as given) is there already.

Defined results: null or empty values of a dimension form cells of their own (''), a null
text has no tokens, and documents of cells without tokens have probability 0; rows that
share an id share their draw. An empty table gives an empty table.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import cut, scratch_name

DIMENSIONS = ("source", "lang", "topic")
#: Cells that are broadcast to the documents (under 10 MB); more are joined by a shuffle.
BROADCAST_CELLS = 50_000


def token_estimate(text: Column) -> Column:
    """Words of a text: runs without space, tab, newline, vertical tab, form feed, carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """The form of a text, which stands in for a topic: shouting, table, record or prose by length."""
    t, n = F.coalesce(text, F.lit("")), F.length(text)
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("!! ")), "shouting")
        .when(F.contains(t, F.lit("Licensed under")) | F.contains(t, F.lit("License")), "licensed")
        .when(n < 1000, "short prose")
        .when(n < 8000, "prose")
        .otherwise("long prose")
    )


def uniform_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def tempered_targets(cells: DataFrame, dimension: str, temperature: float) -> DataFrame:
    """(dimension, target): shares proportional to tokens ** temperature."""
    return cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").select(dimension, F.pow("t", F.lit(temperature)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-9, rounds: int = 50) -> DataFrame:
    """``cells`` (dimensions and ``tokens``) with ``weight``: tokens raked to the targets' marginals.

    ``targets``: for each dimension a DataFrame (dimension, target) of positive shares, which need
    not sum to 1. Values without a target get weight 0. Stops when every marginal is within
    ``tolerance`` of its share, or after ``rounds`` (targets that the cells cannot meet)."""
    names = list(targets)
    w = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for d in names:
        share = targets[d].select(d, (F.col("target") / F.sum("target").over(Window.partitionBy(F.lit(1)))).alias(f"share_{d}"))
        w = w.join(share, d, "inner")
    w = cut(w)
    if w.isEmpty():
        return cells.withColumn("weight", F.lit(0.0))
    total = float(w.agg(F.sum("tokens")).first()[0])
    for _ in range(rounds):
        off = None
        for d in names:
            ratio = F.col(f"share_{d}") * total / F.sum("weight").over(Window.partitionBy(d))
            w = w.withColumn("ratio", ratio).withColumn("weight", F.col("weight") * F.col("ratio")).withColumn(f"off_{d}", F.abs(F.col("ratio") - 1)).drop("ratio")
            off = F.col(f"off_{d}") if off is None else F.greatest(off, F.col(f"off_{d}"))
        w = cut(w)
        if (worst := w.agg(F.max(off)).first()[0]) < tolerance:
            break
    else:
        warnings.warn(f"raking stopped after {rounds} rounds, {worst:.2g} from its targets", stacklevel=2)
    return cells.join(w.select(*names, "weight"), names, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    temperature: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    seed: int = 7,
    tolerance: float = 1e-6,
    rounds: int = 50,
) -> DataFrame:
    """Every row of ``df`` with ``topic`` (where it has none), ``n_tokens``, ``weight`` (the raked share of
    its cell's tokens), ``probability``, ``draw`` and ``selected`` (draw < probability).

    Targets are given, or tempered: shares proportional to tokens ** temperature of each dimension."""
    if clash := {"n_tokens", "weight", "probability", "draw", "selected"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist")
    temperature = temperature or {"source": 0.8, "lang": 0.8, "topic": 0.9}
    docs = df if "topic" in df.columns else df.withColumn("topic", topic_of(F.col(text)))
    docs = docs.withColumn("n_tokens", token_estimate(F.col(text)))
    plain = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS}
    cells = cut(docs.groupBy(*[plain[d].alias(d) for d in DIMENSIONS]).agg(F.sum("n_tokens").alias("tokens")))
    targets = targets or {d: tempered_targets(cells, d, temperature[d]) for d in DIMENSIONS}
    raked = cut(rake(cells, targets, tolerance, rounds).withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)))
    top = raked.agg(F.max("rate"), F.sum("weight"), F.count("*")).first()
    top_rate, total = float(top[0] or 1.0) or 1.0, float(top[1] or 1.0) or 1.0
    names = {d: scratch_name(d) for d in DIMENSIONS}
    rates = raked.select(
        *[F.col(d).alias(names[d]) for d in DIMENSIONS], (F.col("weight") / F.lit(total)).alias("weight"), (F.col("rate") / F.lit(top_rate)).alias("probability")
    )
    if top[2] <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    joined = docs.join(rates, [plain[d] == F.col(names[d]) for d in DIMENSIONS], "left")
    joined = joined.withColumn("draw", uniform_draw(F.col(key), seed))
    return joined.select(*docs.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("probability", F.lit(0.0)).alias("probability"), "draw").withColumn(
        "selected", F.col("draw") < F.col("probability")
    )
