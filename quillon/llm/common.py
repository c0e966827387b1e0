"""Helpers shared by the training-data operators.

Intermediate tables are written as Parquet under the folder that the session
names in ``spark.checkpoint.dir``: every executor can read them, they survive
the loss of an executor and they cut lineage.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, written  # noqa: F401

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Only A-Z change; other letters keep their case.
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def discard(df: DataFrame) -> None:
    """Delete a written table that no later plan reads: what was made of it is written too."""
    drop_path(df.sparkSession, df._quillon_path)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run):
    """``run`` over batches, after which the worker gives freed memory back to the system: workers
    live on from task to task, and what one stage needed isn't there for the next one's JVM."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return whole


#: The place of a row in its file.
ROW = ["_q_file", "_q_row"]


def identified(docs: DataFrame) -> DataFrame:
    """Adds the place of each row in its file: a key that repeated rows don't share.

    The key is the same in every scan of the table, so verdicts on it can be
    joined back without moving the text along with the measures.  Rows that
    don't come from files are written first, so a table is to be identified once."""
    if ROW[0] in docs.columns:
        return docs
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(meta["file_path"]).alias(ROW[0]), meta["row_index"].alias(ROW[1]))
    except AnalysisException:
        return identified(written(docs, "rows"))


def named(docs: DataFrame) -> list:
    """The table's own columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def sharded(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int, carry: bool = False) -> DataFrame:
    """doc_id, text (null: empty) and shard of every row, and with ``carry`` the whole other
    columns as one struct, ``more``; shards hold about ``shard_bytes`` of text, whatever
    ids and texts repeat."""
    rest = [c for c in named(docs) if docs.select(c).columns[0] not in (id_col, text_col)]
    more = [F.struct(*rest, F.lit(None).cast("int").alias("_q_none")).alias("more")] if carry else []
    df = identified(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more, *ROW)
    size = df.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = max(partitions(docs.sparkSession), math.ceil(size / shard_bytes))
    return df.withColumn("shard", F.pmod(F.xxhash64(*ROW), F.lit(shards)).cast("int")).drop(*ROW)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text (null: empty), under fixed names."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer over an array of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(batches: Iterator) -> Iterator[tuple]:
    """The rows of Arrow batches, one at a time, few Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)
