"""Relational operators that Spark has no direct spelling for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, written

MAX_LEVELS, MAX_ROWS = 1000, 5_000_000


def order_of(spec) -> Column:
    """Nulls are the least: first when ascending, last when descending.  ``-name`` descends."""
    if isinstance(spec, Column):
        return spec
    return F.desc_nulls_last(spec[1:]) if spec.startswith("-") else F.asc_nulls_first(spec)


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*map(order_of, order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*map(order_of, order))
    return (out.offset(offset) if offset else out).limit(limit)


def after(df: DataFrame, keys: list[str], values: list) -> DataFrame:
    """Keyset pagination: rows beyond ``values`` by the row comparison (a, b) > (x, y),
    with three-valued logic, as a chain that predicates can be pushed down from."""
    cond = None
    for k in reversed(range(len(keys))):
        c = F.col(keys[k]) > F.lit(values[k])
        cond = c if cond is None else c | ((F.col(keys[k]) == F.lit(values[k])) & cond)
    return df.where(cond)


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """Inclusive; empty if the step leads away; a step of zero is an error."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "generate_series")


def unnest(spark: SparkSession, *arrays: list) -> DataFrame:
    """The elements of all arrays, one after the other."""
    return spark.createDataFrame([(x,) for a in arrays for x in a], "unnest " + ("string" if any(isinstance(x, str) for a in arrays for x in a) else "bigint"))


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_levels: int = MAX_LEVELS, max_rows: int = MAX_ROWS) -> DataFrame:
    """WITH RECURSIVE on the last level's new rows; rows seen before are dropped, so cycles end.

    Each level is checkpointed where the session says, so plans stay short."""
    everything = fresh = checkpointed(seed)
    total = fresh.count()
    for _ in range(max_levels):
        fresh = checkpointed(step(fresh).toDF(*seed.columns).distinct().subtract(everything))
        n = fresh.count()
        if not n:
            return everything
        total += n
        if total > max_rows:
            raise RuntimeError(f"recursive query made more than {max_rows} rows")
        everything = everything.union(fresh)
    return everything


# --- windows with the reference's own rules ------------------------------------


def rows_window(partition: list[str], order: list) -> Window:
    """The reference's default frame counts rows: peers are not included."""
    return Window.partitionBy(*partition).orderBy(*map(order_of, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole_window(partition: list[str], order: list) -> Window:
    return Window.partitionBy(*partition).orderBy(*map(order_of, order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def ntile_even(n: int, partition: list[str], order: list) -> Column:
    """Buckets of ceil(rows / n) rows; the last may stay empty."""
    w = Window.partitionBy(*partition)
    rank = F.row_number().over(w.orderBy(*map(order_of, order)))
    return (F.floor((rank - 1) / F.ceil(F.count(F.lit(1)).over(w) / n)) + 1).cast("long")


# --- data modification as new versions of a table ------------------------------


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """INSERT ... ON CONFLICT: source rows replace target rows of the same key, or are left out."""
    if update:
        return target.join(source.select(*keys), keys, "left_anti").select(*target.columns).unionByName(source)
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(*source.columns))


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({k: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def numbered(df: DataFrame, column: str, order: list, start: int = 1, step: int = 1) -> DataFrame:
    """Sequence values without a single-task window: rows are numbered within ranges, which are
    offset by the counts of those before.

    Ranges are written first, so that counts and values are of the same ones; what is broadcast
    is a number a range."""
    ranged = df.repartitionByRange(*map(order_of, order)).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("_range").count()
    base = sizes.withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*map(order_of, order)))
    return ranged.withColumn("_inner", inner).join(F.broadcast(base), "_range").withColumn(column, F.lit(start) + step * (F.col("_base") + F.col("_inner") - 1)).drop("_range", "_base", "_inner")


# --- large joins ---------------------------------------------------------------

BROADCAST_BYTES = 64 << 20


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast the right side only if Spark's own estimate of its size is within the limit."""
    size = right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return left.join(F.broadcast(right) if int(str(size)) <= limit else right, on, how)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """For hot keys on the left: its rows are dealt over salts, the right's repeated for each."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the right side's rows are repeated: only joins that keep left rows are right")
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
