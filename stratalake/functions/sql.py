"""Functions for SQL text: register(spark) makes them known to a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from stratalake.operators.sequence import align_path

#: Bodies in SQL: Catalyst inlines these.
EXPRESSIONS = {
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "vec_dot(a, b) / sqrt(vec_dot(a, a) * vec_dot(b, b))",
    "span_iou(a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE) RETURNS DOUBLE": "greatest(0D, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0))",
    "spans_overlap(a0 BIGINT, a1 BIGINT, b0 BIGINT, b1 BIGINT) RETURNS BOOLEAN": "a1 >= b0 AND a0 <= b1",
}


def vec_mean(v: pd.Series) -> list:
    """Element-wise mean of a group (of bounded size; mean_vector in operators.vectors is the scalable form)."""
    known = [x for x in v if x is not None]
    return np.mean(known, axis=0).tolist() if known else None


@udtf(returnType="i int, j int, distance double")
class DtwPath:
    """Path of the global alignment of two sequences of vectors; nothing if one is empty."""

    def eval(self, a: list, b: list):
        if a and b:
            x, y = (np.array(s, float) / np.maximum(np.linalg.norm(np.array(s, float), axis=1, keepdims=True), 1e-300) for s in (a, b))
            cost = 1 - x @ y.T
            for i, j in align_path(cost):
                yield i, j, float(cost[i, j])


def register(spark: SparkSession) -> None:
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("vec_mean", pandas_udf(vec_mean, "array<double>"))
    spark.udtf.register("dtw_path", DtwPath)
