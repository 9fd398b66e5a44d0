"""Column expressions shared by operators: time, vectors, intervals, wording."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stratalake.functions.quantiles import quantiles

#: Upper bounds of the median magnitude of an epoch for seconds, milliseconds and microseconds; nanoseconds beyond.
EPOCH_BOUNDS = ((1e11, "s", 10**9), (1e14, "ms", 10**6), (1e17, "us", 10**3))


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_unit(df: DataFrame, column: str) -> DataFrame:
    """One row: median magnitude of an epoch column, its unit, and the factor to nanoseconds."""
    m = F.col("median_abs")
    unit, factor = F.lit("ns"), F.lit(1)
    for bound, name, k in reversed(EPOCH_BOUNDS):
        unit, factor = F.when(m < bound, name).otherwise(unit), F.when(m < bound, k).otherwise(factor)
    return quantiles(df.select(F.abs(F.col(column)).alias("_abs")), "_abs", {"median_abs": 0.5}).select("median_abs", unit.alias("unit"), factor.cast("long").alias("to_ns"))


def overlaps(a0: Column, a1: Column, b0, b1) -> Column:
    """Closed intervals that share a point."""
    return (a1 >= b0) & (a0 <= b1)


def crosses(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open intervals that share more than an end."""
    return (a0 < b1) & (b0 < a1)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return shared / (F.greatest(a1, b1) - F.least(a0, b0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    # the norm is a list beside the vector: inside the lambda of a transform it would be computed for each element, and a
    # lambda inside another that uses its variable can't be merged into the argument of a Python function
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def ago(seconds: Column) -> Column:
    """Wording of an age."""
    said = lambda per, name: F.concat(F.round(seconds / per).cast("long").cast("string"), F.lit(f" {name} ago"))
    return F.when(seconds < 90, said(1, "seconds")).when(seconds < 5400, said(60, "minutes")).when(seconds < 172800, said(3600, "hours")).otherwise(said(86400, "days"))


def plain_name(c: Column) -> Column:
    """A name in lower case, without article, punctuation and plural s."""
    c = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "))
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), "^(the|a|an|my) ", "")
    return F.regexp_replace(c, "([^s])s$", "$1")
