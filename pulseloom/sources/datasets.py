"""Data sets: named loaders, checksums of files, archives, and metadata of nested containers."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, loader: Callable[..., DataFrame]) -> None:
    LOADERS[name] = loader


def load(spark: SparkSession, name: str, **options) -> DataFrame:  # noqa: ANN003
    """A registered data set by name."""
    if name not in LOADERS:
        raise ValueError(f"no data set {name}; there are {sorted(LOADERS)}")
    return LOADERS[name](spark, **options)


def _granger_pair(spark: SparkSession, length: int = 30_000, seed: int = 0) -> DataFrame:
    from pulseloom.operators.generators import PAIR, autoregressive

    return autoregressive(spark, PAIR, length, seed)


def _granger_triple(spark: SparkSession, length: int = 30_000, direct: bool = False, seed: int = 0) -> DataFrame:
    from pulseloom.operators.generators import driven_triple

    return driven_triple(spark, length, direct, seed)


register("granger_pair", _granger_pair)
register("granger_triple", _granger_triple)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of files, through Spark's binary reader."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def intact(spark: SparkSession, path: str, md5: str) -> bool:
    return not checksums(spark, path).where(F.col("md5") == md5).isEmpty()


def unzip(archive: str, folder: str) -> list[str]:
    """Extracts an archive that lies inside ``folder`` only; returns the names."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        for n in z.namelist():
            if not (root / n).resolve().is_relative_to(root):
                raise ValueError(f"{n} leaves the folder")
        z.extractall(root)
        return z.namelist()


def flatten_attributes(child: DataFrame, parents: list[DataFrame], key: str = "object_id", child_first: bool = True) -> DataFrame:
    """(key, attributes): attribute maps of objects and of their parents (same key) as one map; the child's win, or the parents'."""
    out = child.select(key, F.col("attributes"))
    for p in parents:
        other = p.select(key, F.col("attributes").alias("more"))
        joined = out.join(other, key, "left").withColumn("more", F.coalesce("more", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
        strong, weak = ("attributes", "more") if child_first else ("more", "attributes")
        rest = F.map_filter(F.col(weak), lambda k, _, s=strong: ~F.map_contains_key(F.col(s), k))
        out = joined.select(key, F.map_concat(rest, F.col(strong)).alias("attributes"))
    return out


def objects_of(containers: DataFrame, kind: str, key: str = "object_id") -> DataFrame:
    """All objects of a kind in nested containers (children: array of structs with kind and key), each once."""
    return containers.select(F.explode("children").alias("c")).where(F.col("c.kind") == kind).select("c.*").dropDuplicates([key])
