"""Keeping materialized views fresh: a log of changes for each table, and what is due."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists
from . import versions


class DeltaLog:
    """Changes of tables (op I, U or D and the row), kept as files: a folder for each table and
    position, so a change is there as a whole or not at all, and stays over sessions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, table: str, changes: DataFrame) -> int:
        """The position that the changes get: one after the last."""
        at = self.last(table) + 1
        changes.write.parquet(f"{self.path}/{table}/lsn={at}")
        return at

    def last(self, table: str) -> int:
        """The last position, or zero."""
        return max(self._positions(table), default=0)

    def _positions(self, table: str) -> list[int]:
        folder = f"{self.path}/{table}"
        if not exists(self.spark, folder):
            return []
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        return [int(f.getPath().getName().removeprefix("lsn=")) for f in found if f.getPath().getName().startswith("lsn=")]

    def since(self, table: str, position: int = 0) -> DataFrame | None:
        """Changes after a position, with theirs (``lsn``); None if there are none."""
        if not any(p > position for p in self._positions(table)):
            return None
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("lsn") > position)

    def forget(self, table: str, position: int) -> None:
        """Drops changes up to a position, once every view has them."""
        for p in self._positions(table):
            if p <= position:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/lsn={p}")
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class View:
    """A view's source table, how it is refreshed in full and by changes, and its options."""

    table: str
    full: Callable[[], DataFrame]
    incremental: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    options: dict[str, str] = field(default_factory=dict)
    position: int = 0
    refreshed: float = 0.0
    data: DataFrame | None = None


class Scheduler:
    """Refreshes views that are stale.

    Options of a view: ``auto_refresh`` (false: only when asked), ``staleness_threshold_seconds``
    (300), ``priority`` (0; higher first, then the stalest), ``lazy_update`` (true: only views that
    were asked for since their last refresh)."""

    def __init__(self, log: DeltaLog, clock: Callable[[], float] = time.time):
        self.log, self.clock = log, clock
        self.views: dict[str, View] = {}
        self.asked: set[str] = set()

    def add(self, name: str, view: View) -> None:
        self.views[name] = view
        self.refresh(name)

    def refresh(self, name: str, force_full: bool = False) -> str:
        """``full``, ``incremental`` or ``none``, whichever was done."""
        v, last = self.views[name], self.log.last(self.views[name].table)
        how = "full"
        if v.data is not None and not force_full:
            changes = self.log.since(v.table, v.position)
            if changes is None:
                how = "none"
            elif v.incremental and versions.refresh_choice(changes.count(), v.data.count()) == "incremental":
                how = "incremental"
                v.data = v.incremental(v.data, changes.drop("lsn"))
        if how == "full":
            v.data = v.full()
        v.position, v.refreshed = last, self.clock()
        self.asked.discard(name)
        return how

    def read(self, name: str) -> DataFrame:
        self.asked.add(name)
        return self.views[name].data

    def due(self) -> list[str]:
        """Views to refresh now, in order."""
        now, out = self.clock(), []
        for name, v in self.views.items():
            stale = now - v.refreshed
            if v.options.get("auto_refresh", "false").lower() != "true" or stale < float(v.options.get("staleness_threshold_seconds", 300)):
                continue
            if v.options.get("lazy_update", "false").lower() == "true" and name not in self.asked:
                continue
            if self.log.last(v.table) > v.position:
                out.append((-int(v.options.get("priority", 0)), -stale, name))
        return [name for *_, name in sorted(out)]

    def run(self) -> dict[str, str]:
        return {name: self.refresh(name) for name in self.due()}
