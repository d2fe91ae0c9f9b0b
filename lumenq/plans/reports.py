"""Reports kept as tables in the shared folder: fresh for an hour, then stale but usable until made anew."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenq.session import shared_dir

FRESH_S = 3600


class Reports:
    def __init__(self, spark: SparkSession, fresh_s: float = FRESH_S, clock: Callable[[], float] = time.time):
        self.spark, self.fresh_s, self.clock = spark, fresh_s, clock
        self.kept: dict[str, tuple[float, str]] = {}

    def get(self, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """(report, whether it is stale). A report that can't be made anew is given stale, if there is one."""
        at, path = self.kept.get(key, (None, ""))
        if at is not None and self.clock() - at < self.fresh_s:
            return self.spark.read.parquet(path), False
        try:
            new = shared_dir(self.spark, "report")
            build().write.parquet(new)
        except Exception:
            if at is None:
                raise
            return self.spark.read.parquet(path), True
        self.kept[key] = (self.clock(), new)
        return self.spark.read.parquet(new), False

    def drop(self, key: str) -> None:
        self.kept.pop(key, None)
