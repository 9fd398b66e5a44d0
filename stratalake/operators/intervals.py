"""Interval scans, containment and as-of joins, resampling."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stratalake.functions.scalar import overlaps


def overlap_scan(df: DataFrame, start: str, end: str, t0, t1) -> DataFrame:
    """Rows whose closed interval [start, end] (end null: a point) meets [t0, t1]."""
    return df.where(overlaps(F.col(start), F.coalesce(F.col(end), F.col(start)), t0, t1))


def asof(points: DataFrame, samples: DataFrame, by: list[str], on: str, values: list[str], forward: bool = False) -> DataFrame:
    """points with the values of the sample of the same key last at or before (forward: first at or after) them.

    One shuffle on the key: both sides are stacked, ordered, and the last sample is carried along. Of samples at one
    time the greatest struct counts.
    """
    kept = [c for c in points.columns if c not in by and c != on]
    s = samples.groupBy(*by, on).agg(F.max(F.struct(*values)).alias("_s")).select(*by, on, "_s", F.lit(None).cast(points.select(F.struct(F.lit(1), *kept)).schema[0].dataType).alias("_p"))
    p = points.select(*by, on, F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.struct(F.lit(1), *kept).alias("_p"))
    is_point = F.col("_p").isNotNull().cast("int")
    if forward:
        w = Window.partitionBy(*by).orderBy(F.desc(on), is_point).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*by).orderBy(F.asc(on), is_point).rowsBetween(Window.unboundedPreceding, 0)
    both = s.union(p).withColumn("_l", F.last("_s", ignorenulls=True).over(w)).where("_p is not null")
    return both.select(*by, on, *(F.col(f"_p.{c}").alias(c) for c in kept), *(F.col(f"_l.{v}").alias(v) for v in values))


def containing(points: DataFrame, spans: DataFrame, by: list[str], on: str, start: str, end: str, slack=0) -> DataFrame:
    """points with the span of their key that starts last at or before them and reaches them (spans that don't overlap)."""
    s = spans.select(*by, F.col(start).alias(on), F.col(start).alias("_start"), F.col(end).alias("_end"))
    found = asof(points, s, by, on, ["_start", "_end"])
    return found.where(F.col(on) <= F.col("_end") + F.lit(slack)).withColumnsRenamed({"_start": start, "_end": end})


def range_join(left: DataFrame, right: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str], width: int, how: str = "inner") -> DataFrame:
    """Overlap join of closed intervals: each side is cut into buckets of `width` and joined on key and bucket, so no
    side is compared with all of the other. For inner joins a pair counts in the bucket where its overlap begins.

    how: inner, or left_anti (rows of left that meet nothing).
    """
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    r = right.withColumn("_b", buckets(*b))
    if how == "inner":
        l = left.withColumn("_b", buckets(*a))  # noqa: E741
        first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)
        return l.join(r, [*by, "_b"]).where(overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])) & (F.col("_b") == first)).drop("_b")
    keyed = left.withColumn("_row", F.monotonically_increasing_id())
    l = keyed.withColumn("_b", buckets(*a)).alias("l")  # noqa: E741
    meets = l.join(r.alias("r"), [*(F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "_b"]), overlaps(F.col(f"l.{a[0]}"), F.col(f"l.{a[1]}"), F.col(f"r.{b[0]}"), F.col(f"r.{b[1]}"))], "left_anti")
    n = F.floor(F.col(a[1]) / width) - F.floor(F.col(a[0]) / width) + 1
    # a row survives if it survives in all its buckets
    return meets.groupBy(*left.columns, "_row").count().where(F.col("count") == n).drop("_row", "count")


def timeline(df: DataFrame, by: list[str], on: str, step: int) -> DataFrame:
    """Regular times of each key, multiples of step from its first sample to its last."""
    r = df.groupBy(*by).agg(F.min(on).alias("_a"), F.max(on).alias("_b"))
    first, last = F.ceil(F.col("_a") / step), F.floor(F.col("_b") / step)
    return r.where(first <= last).select(*by, F.explode(F.sequence(first, last)).alias("_k")).select(*by, (F.col("_k") * step).alias(on))


def resample(df: DataFrame, by: list[str], on: str, value: str, step: int, how: str = "nearest") -> DataFrame:
    """Values at regular times: of the nearest sample (the earlier one at a tie), or linear between neighbours."""
    s = df.select(*by, on, F.col(on).alias("_t"), F.col(value).alias("_v"))
    t = timeline(df, by, on, step)
    before = asof(t, s, by, on, ["_t", "_v"]).withColumnsRenamed({"_t": "_t0", "_v": "_v0"})
    both = asof(before, s, by, on, ["_t", "_v"], forward=True)
    back, ahead = F.col(on) - F.col("_t0"), F.col("_t") - F.col(on)
    if how == "nearest":
        got = F.when(back <= ahead, F.col("_v0")).otherwise(F.col("_v"))
    else:
        got = F.when(F.col("_t") == F.col("_t0"), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v") - F.col("_v0")) * (back / (back + ahead)))
    return both.select(*by, on, got.alias(value))


def anchored_windows(df: DataFrame, by: list[str], on: str, length: int, hop: int) -> DataFrame:
    """Sliding windows of each key from its first time on, while a window's middle lies before the last time."""
    r = df.groupBy(*by).agg(F.min(on).alias("_a"), F.max(on).alias("_b"))
    n = F.greatest(F.floor((F.col("_b") - F.lit(length // 2) - F.col("_a")) / hop), F.lit(0))
    return r.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("_k"), "_a").select(
        *by, (F.col("_a") + F.col("_k") * hop).alias("t0"), (F.col("_a") + F.col("_k") * hop + length).alias("t1"))


def window_members(df: DataFrame, by: list[str], on: str, length: int, hop: int, least: int = 1) -> DataFrame:
    """Rows with the start of each anchored window [t0, t0 + length) they are in; windows of under `least` rows go.

    A row's windows follow from its distance to the first time: no range join is needed.
    """
    r = df.groupBy(*by).agg(F.min(on).alias("_a"), F.max(on).alias("_b"))
    last = F.greatest(F.floor((F.col("_b") - F.lit(length // 2) - F.col("_a")) / hop), F.lit(0)).cast("long")
    d = F.col(on) - F.col("_a")
    hi = F.least(F.floor(d / hop), last).cast("long")
    lo = F.greatest(F.floor((d - length) / hop) + 1, F.lit(0)).cast("long")
    rows = df.join(r, by).withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    rows = rows.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("t0", F.col("_a") + F.col("_k") * hop).drop("_a", "_b", "_lo", "_hi", "_k")
    if least <= 1:
        return rows
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "t0"))).where(F.col("_n") >= least).drop("_n")


def last_keyframe(df: DataFrame, by: list[str], on: Column, key: Column, value: str, name: str) -> DataFrame:
    """Adds the value of the last row at or before each row for which `key` holds."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(key, F.col(value)), ignorenulls=True).over(w))
