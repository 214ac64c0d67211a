"""Mapping a function over arguments: in this process, or as Spark tasks with the results in the arguments' order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import SparkSession


class SingleProcess:
    def execute(self, handler: Callable, args: Iterable, **kwargs) -> list:  # noqa: ANN003
        return [handler(a, **kwargs) for a in args]


class SparkExecutor:
    """Each argument is a task's row; the function and arguments are pickled."""

    def __init__(self, spark: SparkSession, max_tasks: int | None = None) -> None:
        self.spark, self.max_tasks = spark, max_tasks

    def execute(self, handler: Callable, args: Iterable, **kwargs) -> list:  # noqa: ANN003
        rows = [(i, bytearray(pickle.dumps(a))) for i, a in enumerate(args)]
        if not rows:
            return []

        def run(parts):  # noqa: ANN001, ANN202
            for pdf in parts:
                yield pd.DataFrame({"i": pdf["i"], "out": [pickle.dumps(handler(pickle.loads(a), **kwargs)) for a in pdf["a"]]})

        df = self.spark.createDataFrame(rows, "i long, a binary").repartition(min(len(rows), self.max_tasks or len(rows)), "i")
        return [pickle.loads(r["out"]) for r in df.mapInPandas(run, "i long, out binary").orderBy("i").collect()]
