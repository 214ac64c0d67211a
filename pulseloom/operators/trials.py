"""Trials: a trial is a value of ``trial_id``; taking trials is a filter, counting them an aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trials:
    """Rows of trials (spikes or samples), with ``trial_id``."""

    rows: DataFrame

    def count(self) -> int:
        return self.rows.select("trial_id").distinct().count()

    def take(self, ids: list | None = None) -> Trials:
        """Some trials; none named means all."""
        return Trials(self.rows.where(F.col("trial_id").isin(ids))) if ids else self

    def trial(self, trial_id) -> DataFrame:  # noqa: ANN001
        return self.rows.where(F.col("trial_id") == trial_id)

    def sizes(self, element: str = "train_id") -> DataFrame:
        """(trial_id, n): trains or channels of each trial."""
        return self.rows.groupBy("trial_id").agg(F.countDistinct(element).alias("n"))

    def of_element(self, element_id, element: str = "train_id") -> DataFrame:  # noqa: ANN001
        """One train or channel in all trials."""
        return self.rows.where(F.col(element) == element_id)
