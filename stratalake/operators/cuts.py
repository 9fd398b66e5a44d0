"""Thresholds read off the data: two-group split, widest gap, quantile."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.functions.quantiles import order_values, quantiles

BINS = 64


def split(df: DataFrame, column: str, anchor: float | None = None) -> DataFrame:
    """One row, `cut`: halfway between the means of the two groups that a histogram of BINS equal bins separates best
    (first maximum of between-group variance), or null where there is one group only.

    Two passes over the column; what is ordered is the histogram, BINS rows at most. One group: fewer than two values,
    a range of 1e-5 or less, a gap of the means no wider than both deviations together, or, given an anchor, the nearer
    mean at least the gap away from it.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    width = (F.col("hi") - F.col("lo")) / BINS
    binned = v.join(F.broadcast(r), F.lit(True)).where(F.col("hi") - F.col("lo") > 1e-5)
    binned = binned.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).alias("bin"), (F.col("lo")).alias("lo"), width.alias("w")).agg(F.count(F.lit(1)).alias("c"))
    binned = binned.withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * F.col("w"))
    upto, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = binned.select("mid", F.sum("c").over(upto).alias("w0"), F.sum(F.col("c") * F.col("mid")).over(upto).alias("s0"), F.sum("c").over(whole).alias("w"), F.sum(F.col("c") * F.col("mid")).over(whole).alias("s"))
    t = t.where("w0 < w").withColumn("between", F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), F.lit(2)))
    best = t.agg(F.max_by("mid", F.struct(F.round("between", 6), -F.col("mid"))).alias("at"))
    low, high = F.when(F.col("v") <= F.col("at"), F.col("v")), F.when(F.col("v") > F.col("at"), F.col("v"))
    g = v.join(F.broadcast(best), F.lit(True)).agg(*(f(x).alias(f"{k}_{name}") for name, x in (("lo", low), ("hi", high)) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    gap = F.col("m_hi") - F.col("m_lo")
    ok = gap > F.col("s_lo") + F.col("s_hi")
    if anchor is not None:
        ok = ok & (F.least(F.abs(F.col("m_lo") - anchor), F.abs(F.col("m_hi") - anchor)) < gap)
    return g.select(F.when(ok, (F.col("m_lo") + F.col("m_hi")) / 2).alias("cut"))


def split_per(df: DataFrame, by: list[str], column: str, few: bool = False) -> DataFrame:
    """by, cut: `split` of each key's own values; keys that show one group only are left out. Null and NaN values don't count.

    A key's histogram is summed in the tasks that read its values before BINS rows a key and task are shuffled, so a key
    with very many rows is no task of its own. The statistics of keys are joined as rows; few: the keys are a stated set, so
    that these are broadcast and no value is shuffled.
    """
    met = F.broadcast if few else lambda x: x
    v = df.select(*by, F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    r = v.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi - lo > 1e-5")
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    t = v.join(met(r), by).groupBy(*by, bin_.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
    t = t.withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / BINS)
    w = Window.partitionBy(*by).orderBy("bin")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select(*by, "mid", F.sum("c").over(upto).alias("w0"), F.sum(F.col("c") * F.col("mid")).over(upto).alias("s0"), F.sum("c").over(whole).alias("w"), F.sum(F.col("c") * F.col("mid")).over(whole).alias("s")).where("w0 < w")
    t = t.withColumn("between", F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), F.lit(2)))
    best = t.groupBy(*by).agg(F.max_by("mid", F.struct(F.round("between", 6), -F.col("mid"))).alias("at"))
    low, high = F.when(F.col("v") <= F.col("at"), F.col("v")), F.when(F.col("v") > F.col("at"), F.col("v"))
    g = v.join(met(best), by).groupBy(*by).agg(*(f(x).alias(f"{k}_{name}") for name, x in (("lo", low), ("hi", high)) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    return g.where(F.col("m_hi") - F.col("m_lo") > F.col("s_lo") + F.col("s_hi")).select(*by, ((F.col("m_lo") + F.col("m_hi")) / 2).alias("cut"))


def _numbers(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")


def _gap_between(v: DataFrame, ends: DataFrame) -> DataFrame:
    """One row, `cut`: the middle of the widest gap (the first of equal ones) between neighbouring distinct values from
    a to b, both in the one row of ends; neighbours are found in range buckets, whose borders are joined by their ends."""
    inner = v.join(F.broadcast(ends), F.lit(True)).where((F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b")))
    bucket = F.least(F.floor(F.try_divide(F.col("v") - F.col("a"), F.col("b") - F.col("a")) * 1024), F.lit(1023))
    inner = inner.select("v", F.coalesce(bucket, F.lit(0)).alias("k")).distinct()
    inside = inner.select("v", F.lead("v").over(Window.partitionBy("k").orderBy("v")).alias("next")).where("next is not null")
    borders = inner.groupBy("k").agg(F.min("v").alias("first"), F.max("v").alias("v"))  # 1024 rows at most
    across = borders.select("v", F.lead("first").over(Window.orderBy("k")).alias("next")).where("next is not null")
    best = inside.union(across).agg(F.max_by(F.struct("v", "next"), F.struct(F.col("next") - F.col("v"), -F.col("v"))).alias("g"))
    return best.select(((F.col("g.v") + F.col("g.next")) / 2).alias("cut"))


def widest_gap(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, least: int = 8) -> DataFrame:
    """One row, `cut`: the middle of the widest gap between neighbouring distinct values within two quantiles; null
    for fewer than `least` values."""
    v = _numbers(df, column)
    return _gap_between(v, quantiles(v, "v", {"a": low, "b": high}).where(F.col("n") >= least))


def fit_cut(df: DataFrame, column: str, mode: str = "knee", q: float = 99.0) -> DataFrame:
    """One row: n, cut, separation, frac_below.

    knee: the middle of the widest gap between the values at places floor(n / 20) and floor(19 n / 20) - 1 of the order
    (their value if they are all equal). quantile: the q-th percentile. otsu: the upper edge of the histogram bin after
    which the between-class variance is largest, of n / 8 bins, but 16 at least and 256 at most. separation is the gap of
    the means on both sides over the deviation of all values (0 with one side only), frac_below the share of values up
    to the cut, both to three places. Fewer than eight values, or for otsu one value only: the cut and what follows are
    null.
    """
    v, n = _numbers(df, column), F.col("n")
    if mode == "quantile":
        cut = quantiles(v, "v", {"cut": q / 100}).select("cut")
    elif mode == "knee":
        ends = order_values(v, "v", {"a": (0.05, F.floor(F.lit(0.05) * n)), "b": (0.95, F.floor(F.lit(0.95) * n) - 1)})
        cut = ends.join(F.broadcast(_gap_between(v, ends)), F.lit(True)).select(F.coalesce("cut", "a").alias("cut"))
    elif mode == "otsu":
        r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.least(F.lit(256), F.greatest(F.lit(16), F.floor(F.count("v") / 8))).alias("bins"))
        bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
        h = v.join(F.broadcast(r), F.lit(True)).where("hi > lo").groupBy(bin_.alias("bin"), "lo", "hi", "bins").agg(F.count(F.lit(1)).alias("c"))  # 256 rows at most
        upto, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        h = h.select("bin", "lo", "hi", "bins", *(F.sum(x).over(w).cast("double").alias(k + side) for k, x in (("w", F.col("c")), ("s", F.col("c") * F.col("bin"))) for side, w in (("0", upto), ("1", whole))))
        between = F.pow(F.col("s1") * F.col("w0") - F.col("s0") * F.col("w1"), F.lit(2)) / (F.col("w0") * (F.col("w1") - F.col("w0")))
        edge = F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.col("bins")
        cut = h.where("w0 < w1").agg(F.max_by(edge, F.struct(between, -F.col("bin"))).alias("cut"))
    else:
        raise ValueError(f"no mode {mode!r}: knee, quantile or otsu")
    below = F.col("v") <= F.col("cut")
    met = v.join(F.broadcast(cut), F.lit(True), "left")
    said = met.agg(F.count("v").alias("n"), F.max("cut").alias("cut"), F.stddev_pop("v").alias("dev"), F.avg(F.when(below, F.col("v"))).alias("lower"), F.avg(F.when(~below, F.col("v"))).alias("upper"), F.count(F.when(below, 1)).alias("under"))
    ok = (n >= 8) & F.col("cut").isNotNull()
    return said.select("n", F.when(ok, F.col("cut")).alias("cut"), F.when(ok, F.round(F.coalesce((F.col("upper") - F.col("lower")) / (F.col("dev") + 1e-12), F.lit(0.0)), 3)).alias("separation"), F.when(ok, F.round(F.col("under") / n, 3)).alias("frac_below"))


def floor_at(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows at or above a quantile (linear interpolation) of the column."""
    cut = quantiles(df, column, {"_cut": q}).select("_cut")
    return df.join(F.broadcast(cut), F.col(column) >= F.col("_cut")).drop("_cut")
