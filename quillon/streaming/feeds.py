"""Change feeds and streaming maintenance with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import versions
from ..sources.shared import exists


@dataclass
class Subscription:
    """What a logical subscription changes on the way."""

    tables: list[str] | None = None
    where: str | None = None
    rename: dict[str, str] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    cast: dict[str, str] = field(default_factory=dict)


def change_stream(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int = 100) -> DataFrame:
    """A change log's files as a stream; each batch is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def changes(df: DataFrame, since=None, until=None, tables: list[str] | None = None, lsn: str = "lsn") -> DataFrame:
    """The part of a log after a position, up to one, of some tables."""
    if since is not None:
        df = df.where(F.col(lsn) > since)
    if until is not None:
        df = df.where(F.col(lsn) <= until)
    return df.where(F.col("table_name").isin(tables)) if tables else df


def subscribed(df: DataFrame, sub: Subscription) -> DataFrame:
    """Table filter, row filter, casts, renames, drops: for streams and tables alike."""
    if sub.tables:
        df = df.where(F.col("table_name").isin(sub.tables))
    if sub.where:
        df = df.where(sub.where)
    df = df.withColumns({c: F.col(c).cast(k) for c, k in sub.cast.items()})
    return df.withColumnsRenamed(sub.rename).drop(*sub.drop)


def _timed(df: DataFrame, ts: str, late: str) -> tuple[DataFrame, str]:
    """Watermarks need an instant: a time without zone is taken as one, and given back as it was."""
    kind = dict(df.dtypes)[ts]
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return (df.withWatermark(ts, late) if df.isStreaming else df), kind


def windowed(df: DataFrame, ts: str, size: str, slide: str | None = None, late: str = "1 hour", keys: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) over tumbling or sliding windows; late rows beyond the watermark go."""
    df, kind = _timed(df, ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.groupBy(w, *(keys or [])).agg(F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else []))
    return out.select(F.col("window.start").cast(kind).alias("start"), F.col("window.end").cast(kind).alias("end"), *(keys or []), "n", *(["total"] if value else []))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    df, kind = _timed(df, ts, late)
    out = df.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").cast(kind).alias("start"), F.col("session_window.end").cast(kind).alias("end"), *keys, "n")


def maintained_view(stream: DataFrame, path: str, keys: list[str], value: str, checkpoint: str) -> StreamingQuery:
    """A view of counts and sums by key kept up to date by a change stream.

    Each batch merges into the last version and writes the next, named by batch, so
    a batch that is repeated after a failure gives the same version."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{path}/v={number}"
        if number or exists(spark, before):  # only the first batch has no version before it
            view = spark.read.parquet(before)
        else:
            view = batch.limit(0).select(*keys, F.lit(0).cast("long").alias("n"), F.col(value).alias("total"))
        versions.merged_aggregate(view, batch, keys, value).write.mode("overwrite").parquet(f"{path}/v={number + 1}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything there is now, in bounded batches, then stop."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collected(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """A stream's result as a table, once it has read what there is."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(path)
    last = {}

    def keep(batch: DataFrame, number: int) -> None:
        last["path"] = f"{path}/v={number}"
        batch.write.mode("overwrite").parquet(last["path"])

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(last["path"])
