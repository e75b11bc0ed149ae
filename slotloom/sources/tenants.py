"""Tenants: a folder of event logs for each, under one root."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from slotloom.schema import EVENTS, Limits, ScheduleError
from slotloom.sources.events import append_log, fold, read_log, valid_prefix


class Tenants:
    """Logs by tenant name. Names keep letters, digits, ``_`` and ``-`` alone; a new name makes a log, up to the limit."""

    def __init__(self, spark: SparkSession, root: str, limits: Limits = Limits()):
        self.spark, self.root, self.limits = spark, root.rstrip("/"), limits

    def path(self, name: str) -> str:
        if len(name.encode()) > self.limits.tenant_bytes:
            raise ScheduleError("LimitExceeded", "tenant name too long")
        kept = re.sub("[^A-Za-z0-9_-]", "", name)
        if not kept:
            raise ScheduleError("LimitExceeded", "empty tenant name")
        return f"{self.root}/{kept}"

    def _listed(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def log(self, name: str) -> DataFrame:
        path = self.path(name)
        if path.rsplit("/", 1)[1] not in self._listed():
            if len(self._listed()) >= self.limits.tenants:
                raise ScheduleError("LimitExceeded", "too many tenants")
            append_log(self.spark.createDataFrame([], EVENTS), path)
        return read_log(self.spark, path)

    def append(self, name: str, events: DataFrame) -> None:
        self.log(name)
        append_log(events, self.path(name))

    def state(self, name: str, now: int):
        return fold(valid_prefix(self.log(name)), now)
