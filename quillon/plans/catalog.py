"""Every named query of the engine with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import programs
from .engine import Engine
from .statements import STATEMENTS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that registers the tables it names and runs the statement."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN|,)\s+{t}\b", sql, re.IGNORECASE)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.register_dir(sf_dir, used)
        return engine.sql(sql)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: statement(s) for k, (s, _) in STATEMENTS.items()} | programs.QUERIES
ORACLES: dict[str, str] = {k: d or s for k, (s, d) in STATEMENTS.items()} | programs.ORACLES
