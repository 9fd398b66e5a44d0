"""Exact quantiles and order statistics of any number of values, over all rows or for each key."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

#: Rank accuracy of the sketch, and how many of its steps the values looked at reach to either side of the one sought.
ACCURACY, MARGIN = 20_000, 4


def order_values(df: DataFrame, column: str, places: dict[str, tuple[float, Column]], by: list[str] | tuple = ()) -> DataFrame:
    """One row (one for each key): n, and for each name the value at a 0-based place of the ascending order. A place is
    given by its share of the rows, roughly, and its exact number in terms of n.

    A sketch bounds each value sought from both sides; what lies outside these bounds is only counted, and what lies
    inside (2 * MARGIN / ACCURACY of the rows for each share) is counted by value. So no task holds all distinct values.
    Up to ACCURACY rows of a key lie inside. Nulls and NaN are left out; without rows n is 0 and values are null.
    """
    v = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    shares = sorted({s for s, _ in places.values()})
    step = MARGIN / ACCURACY
    sketched = [x for s in shares for x in (max(0.0, s - step), min(1.0, s + step))]
    near = v.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by))).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", sketched, ACCURACY).alias("_at"))
    whole = F.col("n") <= ACCURACY
    bounds = [(F.when(whole, F.col("_lo")).otherwise(F.col("_at")[2 * i]), F.when(whole, F.col("_hi")).otherwise(F.col("_at")[2 * i + 1])) for i in range(len(shares))]
    if by:
        same = F.lit(True)
        for i, k in enumerate(by):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        met = v.join(near, same)
    else:
        met = v.join(F.broadcast(near), F.lit(True))  # one row
    x, part, inside = F.col("_v"), F.lit(0), F.lit(False)
    for low, high in bounds:
        part = part + (x >= low).cast("int") + (x > high).cast("int")
        inside = inside | x.between(low, high)
    # parts of the order are numbered upwards; each is inside or outside as a whole
    counts = met.groupBy(*by, part.alias("_part"), F.when(inside, x).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"))
    upto = Window.partitionBy(*by).orderBy("_part", "_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_end", F.sum("_c").over(upto))
    found = [F.max(F.when((place >= F.col("_end") - F.col("_c")) & (place < F.col("_end")), F.col("_v"))).alias(name) for name, (_, place) in places.items()]
    return placed.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *found)


def quantiles(df: DataFrame, column: str, shares: dict[str, float], by: list[str] | tuple = ()) -> DataFrame:
    """One row (one for each key): n, and the named quantiles, interpolated linearly between neighbouring values."""
    places = {}
    at = {name: F.lit(float(s)) * (F.col("n") - 1) for name, s in shares.items()}
    for name, s in shares.items():
        places[f"_a_{name}"], places[f"_b_{name}"] = (s, F.floor(at[name])), (s, F.ceil(at[name]))
    def value(name: str) -> Column:
        a, b, p = F.col(f"_a_{name}"), F.col(f"_b_{name}"), at[name]
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)
    return order_values(df, column, places, by).select(*by, "n", *(value(name).alias(name) for name in shares))
