"""Gaps and islands: runs, merged segments, sessions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stratalake.functions.quantiles import quantiles


def _islands(df: DataFrame, by: list[str], order: list, opens: Column) -> DataFrame:
    """Numbers runs: a row for which `opens` holds, or is unknown, starts a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce(opens, F.lit(True)).cast("int"))
    return flagged.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, by: list[str], on: str, gap, tie: list[str] | None = None) -> DataFrame:
    """Rows with the number of their run: a step of more than `gap` parts runs."""
    order = [on, *(tie or [])]
    w = Window.partitionBy(*by).orderBy(*order)
    return _islands(df, by, order, F.col(on) - F.lag(on).over(w) > gap)


def spans_of_runs(df: DataFrame, by: list[str], on: str, gap, tie: list[str] | None = None) -> DataFrame:
    """First and last time and number of rows of each run."""
    return runs(df, by, on, gap, tie).groupBy(*by, "island").agg(F.min(on).alias("t0"), F.max(on).alias("t1"), F.count(F.lit(1)).alias("n"))


def merge_spans(df: DataFrame, by: list[str], t0: str, t1: str, gap: Column | int = 0, strict: bool = False) -> DataFrame:
    """Rows with the number of their merged span: the start lies within `gap` of the furthest end so far (strict: before it)."""
    w = Window.partitionBy(*by).orderBy(t0, t1)
    reach = F.max(t1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    apart = F.col(t0) >= reach + gap if strict else F.col(t0) > reach + gap
    return _islands(df, by, [t0, t1], apart)


def segments(df: DataFrame, by: list[str], t0: str, t1: str, score: str, lift: float = 0.55) -> DataFrame:
    """Segments of rows that score above median + lift * (top - median) of all rows, merged over gaps of up to the
    median length plus one: t0, t1, peak, mean, n of each."""
    length = quantiles(df.select((F.col(t1) - F.col(t0)).alias("_d")), "_d", {"_d": 0.5}).select(F.floor("_d").alias("_len"))
    cut = quantiles(df, score, {"_m": 0.5}).select("_m").join(df.agg(F.max(score).alias("_top")), F.lit(True)).join(length, F.lit(True))
    high = df.join(F.broadcast(cut), F.lit(True)).where(F.col(score) > F.col("_m") + lift * (F.col("_top") - F.col("_m")))
    merged = merge_spans(high, by, t0, t1, F.col("_len") + 1)
    return merged.groupBy(*by, "island").agg(F.min(t0).alias("t0"), F.max(t1).alias("t1"), F.max(score).alias("peak"), F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))


def stretches(df: DataFrame, by: list[str], order: str, change: Column) -> DataFrame:
    """Contiguous stretches between rows where `change` (against the row before) holds: first, last, n."""
    return _islands(df, by, [order], change).groupBy(*by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
