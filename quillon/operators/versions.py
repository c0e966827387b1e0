"""Versioned tables: an append-only log of row versions, branches and their merges.

A log has the key columns, ``ts``, ``op`` (I, U, D) and the row's columns; a ``seq``
column, if there is one, orders changes of one time.  Without it the last of a time is a
deletion if there is one, or else the one with the largest values: always the same.  A snapshot
is the last version at or before a time, by one aggregation: no window or sort is
needed, and partial aggregates keep the shuffle to a row for each key and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(log: DataFrame, keys: list[str], ts, column: str = "ts", horizon=None) -> DataFrame:
    """Rows as they were at a time, transaction or change number."""
    if horizon is not None and ts < horizon:
        raise ValueError("the snapshot is older than what garbage collection kept")
    rest = [c for c in log.columns if c not in keys]
    last = log.where(F.col(column) <= F.lit(ts)).groupBy(*keys).agg(F.max_by(F.struct(*rest), _order(log, keys, column)).alias("v"))
    return last.select(*keys, "v.*").where("op <> 'D'").select(*[c for c in log.columns if c not in (column, "op", "seq")])


def _order(log: DataFrame, keys: list[str], column: str) -> Column:
    """What tells the last of a key's changes; columns that can't be compared have no say."""
    ties = [F.col("seq")] if "seq" in log.columns else [F.col("op") == "D"]
    kinds = dict(log.dtypes)
    return F.struct(column, *ties, *(c for c in log.columns if c not in (*keys, column, "op", "seq") and "map<" not in kinds[c] and kinds[c] != "variant"))


def versions_between(log: DataFrame, start, end, column: str = "ts") -> DataFrame:
    return log.where(F.col(column).between(F.lit(start), F.lit(end)))


def vacuum(log: DataFrame, keys: list[str], horizon, column: str = "ts") -> DataFrame:
    """Without versions that no snapshot at or after the horizon can see."""
    last = log.where(F.col(column) <= F.lit(horizon)).groupBy(*keys).agg(F.max(column).alias("_last"))
    kept = log.join(last, keys, "left")
    return kept.where(F.col("_last").isNull() | (F.col(column) > F.col("_last")) | ((F.col(column) == F.col("_last")) & (F.col("op") != "D"))).drop("_last")


def branch_read(parent: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The parent's rows under the branch's own changes (with ``op``)."""
    own = delta.where("op <> 'D'").select(*parent.columns)
    return parent.join(delta.select(*keys), keys, "left_anti").select(*parent.columns).unionByName(own)


class MergeConflict(ValueError):
    """Both sides changed a row and differ."""


def three_way_merge(base: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], strategy: str = "auto") -> DataFrame:
    """The merge of source into target.  On conflict: auto and theirs take the source, ours
    the target, manual raises."""
    rest = [c for c in base.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    df = side(base, "b").join(side(source, "s"), keys, "full").join(side(target, "t"), keys, "full")
    by_source, by_target = ~F.col("s").eqNullSafe(F.col("b")), ~F.col("t").eqNullSafe(F.col("b"))
    conflict = by_source & by_target & ~F.col("s").eqNullSafe(F.col("t"))
    if strategy == "manual" and df.where(conflict).limit(1).count():
        raise MergeConflict("rows were changed on both branches")
    prefer_target = conflict if strategy == "ours" else F.lit(False)
    merged = F.when(by_source & ~prefer_target, F.col("s")).otherwise(F.col("t"))
    return df.select(*keys, merged.alias("v")).where("v IS NOT NULL").select(*keys, "v.*").select(*base.columns)


def conflicts(base: DataFrame, source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in base.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    df = side(base, "b").join(side(source, "s"), keys, "full").join(side(target, "t"), keys, "full")
    return df.where(~F.col("s").eqNullSafe(F.col("b")) & ~F.col("t").eqNullSafe(F.col("b")) & ~F.col("s").eqNullSafe(F.col("t"))).select(*keys)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# --- materialized views ------------------------------------------------------------


def refresh_choice(deltas: int, base_rows: int) -> str:
    """Incremental at a millisecond a change if under half of ten milliseconds a base row."""
    return "incremental" if deltas * 1.0 < 0.5 * base_rows * 10.0 else "full"


def merged_aggregate(view: DataFrame, deltas: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A view of ``n`` and ``total`` by key after changes with ``value``: op I or D, or U, whose
    value before is ``old_<value>``, and whose key before is ``old_<key>`` if there is such a column.

    Counts and sums are mergeable, so only changed keys are touched.  An update without the
    value before is an error."""
    plain = deltas.where("op IN ('I', 'D')").select(*keys, F.when(F.col("op") == "D", -1).otherwise(1).alias("_n"), F.col(value).alias("_v"))
    if f"old_{value}" in deltas.columns:
        updates = deltas.where("op = 'U'")
        old = [F.col(f"old_{k}").alias(k) if f"old_{k}" in deltas.columns else F.col(k) for k in keys]
        plain = plain.unionByName(updates.select(*keys, F.lit(1).alias("_n"), F.col(value).alias("_v"))).unionByName(updates.select(*old, F.lit(-1).alias("_n"), F.col(f"old_{value}").alias("_v")))
    else:
        known = F.when(F.col("op") == "U", F.raise_error(F.lit(f"an update needs old_{value}")).cast("int")).otherwise(F.when(F.col("op") == "D", -1).otherwise(1))
        plain = deltas.select(*keys, known.alias("_n"), F.col(value).alias("_v"))
    change = plain.groupBy(*keys).agg(F.sum("_n").alias("dn"), F.sum(F.col("_n") * F.col("_v")).alias("dt"))
    df = view.join(change, keys, "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.select(*keys, (z("n") + z("dn")).alias("n"), (z("total") + z("dt")).alias("total")).where("n > 0")


def merged_filter(view: DataFrame, deltas: DataFrame, keys: list[str], where: str) -> DataFrame:
    """A filtered view after changes: touched keys are taken anew."""
    fresh = deltas.where("op <> 'D'").where(where).select(*view.columns)
    return view.join(deltas.select(*keys).distinct(), keys, "left_anti").select(*view.columns).unionByName(fresh)


def merged_join(view: DataFrame, left: DataFrame, right: DataFrame, left_deltas: DataFrame, on: list[str], left_keys: list[str], right_deltas: DataFrame | None = None, right_keys: list[str] | None = None) -> DataFrame:
    """A join's view after changes of the tables, given as they were before: only rows of changed
    keys are joined again.  The view has both tables' keys."""
    fresh = left_deltas.where("op <> 'D'").select(*left.columns)
    after = view.join(left_deltas.select(*left_keys).distinct(), left_keys, "left_anti").select(*view.columns).unionByName(fresh.join(right, on).select(*view.columns))
    if right_deltas is None:
        return after
    now = left.join(left_deltas.select(*left_keys).distinct(), left_keys, "left_anti").select(*left.columns).unionByName(fresh)
    other = right_deltas.where("op <> 'D'").select(*right.columns).join(now, on).select(*view.columns)
    return after.join(right_deltas.select(*right_keys).distinct(), right_keys, "left_anti").select(*view.columns).unionByName(other)


def merged_extremes(view: DataFrame, deltas: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A view of ``low``, ``high`` and ``mean`` by key: extremes don't merge over deletions, so the
    changed keys alone are taken anew from the table as it is after the changes."""
    touched = deltas.select(*keys).distinct()
    fresh = base.join(touched, keys, "left_semi").groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return view.join(touched, keys, "left_anti").select(*keys, "low", "high", "mean").unionByName(fresh)


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of one table only, or of another type, with the type on either side."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    rows = [(c, left.get(c), right.get(c)) for c in dict.fromkeys([*left, *right]) if left.get(c) != right.get(c)]
    return a.sparkSession.createDataFrame(rows, "column_name string, left_type string, right_type string")


def sampled_diff(a: DataFrame, b: DataFrame, keys: list[str], one_in: int = 100) -> DataFrame:
    """As ``diff``, of the rows whose key's hash is divisible by ``one_in``: alike on both sides."""
    some = lambda df: df.where(F.pmod(F.xxhash64(*keys), F.lit(one_in)) == 0)
    return diff(some(a), some(b))
