"""Ranks that allow abstaining, rank fusion, top-k, greedy suppression."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


#: Rows of one bucket of a global order on average, and the most buckets.
BUCKET_ROWS, BUCKETS = 200_000, 4096


def quantile_buckets(df: DataFrame, score: str) -> tuple[int, int, Column]:
    """How many rows have a score, the number of buckets, and each row's bucket: BUCKET_ROWS rows on average, a better
    score in no lower bucket, equal scores in one. Quantiles are found in one pass."""
    shares = ", ".join(f"{k / BUCKETS!r}D" for k in range(1, BUCKETS))
    n, at = df.agg(F.count(score), F.expr(f"percentile_approx(`{score}`, array({shares}), {10 * BUCKETS})")).first()
    wanted = min(BUCKETS, -(-n // BUCKET_ROWS))
    bounds = sorted({float(at[k * BUCKETS // wanted - 1]) for k in range(1, wanted)}) if wanted > 1 else []
    if not bounds:
        return n, 1, F.lit(0)
    # how many bounds are below the score, by halving
    array, steps = F.array(*map(F.lit, bounds)), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when((a + s <= len(bounds)) & (F.get(array, F.least(a + s, F.lit(len(bounds))) - 1) < F.col(score).cast("double")), a + s).otherwise(a))
    return n, len(bounds) + 1, bucket


def within_budget(df: DataFrame, order: str, cost: str, budget: int, name: str) -> DataFrame:
    """Adds the running sum of costs over all rows, largest order first (equal ones together, those without one last),
    and keeps the rows where it is within the budget.

    Sums of whole buckets of the order come first; rows are ordered only inside the buckets where the running sum can be
    within the budget, one task for each. Null costs count nothing; where no cost is known yet there is no sum.
    """
    _, count, bucket = quantile_buckets(df, order)
    dealt = df.withColumn("_bucket", F.when(F.col(order).isNotNull(), bucket).otherwise(-1))
    sums = {r[0]: r[1:] for r in dealt.groupBy("_bucket").agg(F.sum(cost), F.sum(F.least(F.col(cost), F.lit(0)))).collect()}  # BUCKETS + 1 rows at most
    before, above, wanted = None, {}, []
    for b in range(count - 1, -2, -1):
        total, least = sums.get(b, (None, None))
        above[b] = before
        if total is not None:
            before = total + (before or 0)
        if before is not None and (above[b] or 0) + (least or 0) <= budget:
            wanted.append(b)
    within = F.sum(cost).over(Window.partitionBy("_bucket").orderBy(F.desc(order)))
    sooner = F.get(F.array(*(F.lit(above[b]) for b in range(-1, count))), F.col("_bucket") + 1)
    used = F.coalesce(within + sooner, within, sooner)
    return dealt.where(F.col("_bucket").isin(wanted)).withColumn(name, used).where(F.col(name) <= budget).drop("_bucket")


def global_places(df: DataFrame, score: str, tie: str, name: str) -> DataFrame:
    """Adds 0-based places in the order of a score, best first, over all rows without one task that sees them all; rows
    without a score get the middle place of those known (0 if none is).

    Quantiles of the score, found in one pass, deal rows into buckets; a row's place is its place in its bucket plus the
    rows of better buckets, of which there are BUCKETS at most, counted in a second pass if there are several. Equal
    scores share a bucket. Checkpoint rows that are costly to compute.
    """
    n, count, bucket = quantile_buckets(df, score)
    better = F.lit(0)
    if count > 1:
        sizes = dict(df.where(F.col(score).isNotNull()).groupBy(bucket.alias("b")).count().collect())  # BUCKETS rows at most
        above = [sum(sizes.get(j, 0) for j in range(i + 1, count)) for i in range(count)]
        better = F.get(F.array(*map(F.lit, above)), F.col("_bucket"))
    # rows without a score are spread, as their order doesn't matter
    dealt = df.withColumn("_bucket", F.when(F.col(score).isNotNull(), bucket).otherwise(-1 - F.pmod(F.xxhash64(tie), F.lit(BUCKETS)).cast("int")))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc(score), tie)) - 1
    return dealt.withColumn(name, F.when(F.col("_bucket") >= 0, (place + better).cast("double")).otherwise(max(0.0, (n - 1) / 2))).drop("_bucket")


def ranks(df: DataFrame, score: str, tie: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds 0-based ranks, best first. A null score abstains: it gets the middle rank of those known (0 if none is)."""
    if not by:
        return global_places(df, score, tie, name)
    w = Window.partitionBy(*by)
    known = F.count(score).over(w)
    r = F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), tie)) - 1
    return df.withColumn(name, F.when(F.col(score).isNotNull(), r.cast("double")).otherwise(F.greatest(F.lit(0.0), (known - 1) / 2)))


def fuse(df: DataFrame, scores: dict[str, float], tie: str, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """Adds rrf: the weighted sum of 1 / (k + rank + 1) over the named scores."""
    total = F.lit(0.0)
    for s, weight in scores.items():
        df = ranks(df, s, tie, f"rank_{s}", by)
        total = total + weight / (k + F.col(f"rank_{s}") + 1)
    return df.withColumn("rrf", total)


def top_per(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def rank01(df: DataFrame, by: list[str], score: str, tie: str, name: str) -> DataFrame:
    """Ordinal rank over number of rows inside each key, from 1/n to 1."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.row_number().over(w.orderBy(score, tie)) / F.count(F.lit(1)).over(w))


def suppress(df: DataFrame, by: list[str], t0: str, t1: str, score: str, k: int | None) -> DataFrame:
    """Greedy, best first: a row goes if its span overlaps or touches a kept one of the same key; then the best k of all,
    or all without k, in no order.

    A kept span suppresses within its key alone, and at most k of a key can be among the k best of all, so a key's fold
    stops there.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, t0, t1], ascending=[False, True, True])
        starts: list = []
        ends: list = []  # kept spans are apart, so the neighbours of a place decide
        kept = []
        for i, (a, b) in enumerate(zip(pdf[t0].tolist(), pdf[t1].tolist())):
            at = bisect_right(starts, b)
            if not at or ends[at - 1] < a:
                starts.insert(at, a)
                ends.insert(at, b)
                kept.append(i)
                if len(kept) == k:
                    break
        return pdf.iloc[kept]

    found = df.groupBy(*by).applyInPandas(one, df.schema)
    return found if k is None else found.orderBy(F.desc(score), *by, t0).limit(k)
